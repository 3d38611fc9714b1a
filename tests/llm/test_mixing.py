import pandas as pd
import pytest
from pyspark.sql import functions as F

from grainstore.llm import mixing as M


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, "word " * (5 + i % 40), [" Wiki", "WIKI", "qa-export", "small", "other", None][i % 6] if i % 50 else "small", ["en", "KO", None][i % 3]) for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("tokens", F.lit("clash"))


def _targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_weight double, max_repeats int")


def test_shares_meet_their_targets(spark, documents):
    mix = M.mix_sources(documents, _targets(spark, [("wiki", 0.5, 2), ("qa_export", 0.3, 2), ("small", 0.2, 3)]))
    shares = {r.source: r for r in mix.shares.collect()}
    assert all(abs(r.share - r.target_weight) < 0.01 for r in shares.values()), shares
    assert all(r.most_copies <= r.max_repeats for r in shares.values())
    rows = mix.documents.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and {r.source for r in rows} == {"wiki", "qa_export", "small"}
    count = M.token_counter(M.MixConfig().ranks)
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert all(r.tokens == count(texts[r.doc_id]) for r in rows[:50])


def test_a_small_source_is_repeated_up_to_its_cap(spark, documents):
    mix = M.mix_sources(documents, _targets(spark, [("wiki", 0.3, 1), ("small", 0.7, 2)]))
    shares = {r.source: r for r in mix.shares.collect()}
    assert shares["small"].most_copies == 2 and abs(shares["small"].share - 0.7) < 0.02


def test_nothing_to_mix(spark, documents):
    mix = M.mix_sources(documents, _targets(spark, [("absent", 1.0, None), (None, 1.0, 1)]))
    assert mix.documents.count() == 0 and [(r.source, r.share) for r in mix.shares.collect()] == [("absent", 0.0)]
    empty = M.mix_sources(documents.where("false"), _targets(spark, [("wiki", 1.0, 2)]))
    assert empty.documents.count() == 0 and empty.shares.first().share == 0.0
    odd = spark.createDataFrame([(None, "x", "wiki", None), (1, None, "wiki", None), (2, "", "wiki", None), (3, "hi", "wiki", None), (3, "hi", "wiki", None)], "doc_id long, text string, source string, lang string")
    assert [(r.doc_id, r.copies) for r in M.mix_sources(odd, _targets(spark, [("wiki", None, None), ("b", 1.0, 1)])).documents.collect()] == []
    assert M.mix_sources(odd, _targets(spark, [("wiki", 1.0, 2)])).documents.first().doc_id == 3


def test_raking_fits_the_other_marginals_too():
    cells = pd.DataFrame([("a", "en", "p", 1000), ("a", "ko", "p", 3000), ("b", "en", "p", 3000), ("b", "ko", "p", 1000)], columns=["source", "language", "topic", "tokens"])
    rates, whole = M.rake(cells, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 2}, 4000, 50)
    got = cells.assign(x=rates * cells.tokens)
    assert whole == 4000 and got.groupby("source").x.sum().round(3).tolist() == [2000, 2000] and got.groupby("language").x.sum().round(3).tolist() == [2000, 2000]
    rates, whole = M.rake(cells, {"a": 0.9, "b": 0.1}, {"a": 1, "b": 1}, None, 50)
    assert abs(whole - 4000 / 0.9) < 1e-6 and rates.max() <= 1
