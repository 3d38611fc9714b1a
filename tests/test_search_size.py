"""What the searching queries write down on the way: it must not grow with questions times lines."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from grainstore.operators import search as S
from grainstore.plans import search_queries
from grainstore.session import scratch_space

WORDS = [f"word{i}" for i in range(24)]


def _rows(seed, repos=30, files=8, lines=60):
    rng = random.Random(seed)
    for r in range(repos):
        for f in range(files):
            text = "\n".join(" ".join(rng.sample(WORDS, 6)) for _ in range(lines))
            path = f"app/{rng.choice(WORDS)}/file{f}.py"
            yield f"c{r}-{f}", f"repo{r:02}", path, "python", 1, lines, text
            yield f"d{r}-{f}", f"repo{r:02}", path, "python", lines, lines + 1, text.split("\n")[-1] + "\r\nword0 Word1"


CODE = "chunk_id string, repo_id string, path string, lang string, start_line int, end_line int, text string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(list(_rows(1)), CODE).repartition(6).write.parquet(f"{d}/code_chunks.parquet")
    rng = random.Random(2)
    cases = [(i, f"n{i}", " ".join(rng.sample(WORDS, 5)), "app/x.py") for i in range(60)]
    spark.createDataFrame(cases, "item_id long, name string, question string, expected_top_path string").write.parquet(f"{d}/eval_cases.parquet")
    spark.createDataFrame([("t1", "d1", "a.pdf", 1, "word1 page")], "chunk_id string, doc_id string, filename string, page int, text string").write.parquet(f"{d}/text_chunks.parquet")
    return d


def _shuffled(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def _written(spark, d, name):
    """MB that a query shuffles."""
    before = _shuffled(spark)
    with scratch_space(spark):
        queries()[name](spark, d).write.format("noop").mode("overwrite").save()
    return sum(n for k, n in _shuffled(spark).items() if k not in before) / 1e6


def test_keyword_lines_shuffles_no_line_per_question(spark, tables):
    assert _written(spark, tables, "keyword_lines") < 1


def test_line_counts_are_those_of_the_lines(spark, tables):
    code, asked = spark.read.parquet(f"{tables}/code_chunks.parquet").where("repo_id < 'repo04'"), S.understood(
        spark.createDataFrame([(1, "word1 Word1 'word0 word'"), (2, "word2 word3"), (3, None), (4, "missing")], "question_id long, question string"))
    full = S.keyword_lines(code, asked).groupBy("question_id", "repo_id", "path").agg(
        F.count("*"), F.min("line"), F.max("line"), F.sum(F.size("matched_keywords")))
    for block in (5000, 2):
        got = S.keyword_line_counts(code, asked, S.SearchConfig(block=block))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, full.collect()))
    assert S.keyword_line_counts(code, asked.where("question_id = 3")).count() == 0


def test_keyword_limits_shuffles_no_line_per_question(spark, tables):
    assert _written(spark, tables, "keyword_limits") < 4


def test_hits_are_the_first_of_all_hits(spark, tables):
    code = spark.read.parquet(f"{tables}/code_chunks.parquet").withColumn("repo_id", F.when(F.col("repo_id") != "repo07", F.col("repo_id")))
    rare = spark.createDataFrame([("x1", f"repo{i:02}", "app/Rareword.py", "python", 1, 1, "only Rareword") for i in range(3, 28)], CODE)
    code = code.unionByName(rare).repartition(7)
    asked = S.understood(spark.createDataFrame([(1, "word1 word2"), (2, "Rareword"), (3, "rareword word5 word6"), (4, "file3"), (5, "단어 검색"), (6, None)], "question_id long, question string"))
    index = S.path_index(code)
    for block in (5000, 2):
        with scratch_space(spark):
            repos = index.select("repo_id").distinct().count()
            columns = ["question_id", "source", "repo_id", "path", "line", "text", "matched_keywords", "ord"]
            want = S.keyword_hits(S.keyword_lines(code, asked), S.path_hits(index, asked), repos).select(columns).collect()
            got = S.lexical_hits(code, index, asked, S.SearchConfig(block=block)).select(columns).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 400


@pytest.mark.parametrize("limits", [(2, 5), (1, 3), (3, 100)])
def test_what_a_task_leaves_out_is_not_in_the_answer(limits):
    rng = random.Random(5)
    for _ in range(200):
        hits = [(rng.randrange(3), S._ordered(rng.choice([None, "a", "b", "c", "d"])), rng.randrange(12)) for _ in range(rng.randrange(80))]

        def best(rows):
            out = set()
            for q in range(3):
                mine = []
                for repo in sorted({r for p, r, _ in rows if p == q}):
                    mine += [(q, repo, k) for k in sorted({k for p, r, k in rows if p == q and r == repo})[: limits[0]]]
                out |= set(mine[: limits[1]])
            return out

        kept = set()
        for part in (hits[::2], hits[1::2]):
            first = S._First(3, *limits)
            for q, repo, k in part:
                if not first.beyond(repo):
                    first.add(q, repo, k)
            kept |= {(q, S._ordered(repo), k) for q, repo, k, _ in first.rows()}
        assert best(kept) == best(hits)


def test_rerank_shuffles_no_line_per_question(spark, tables):
    assert _written(spark, tables, "rerank") < 4


def test_eval_top1_shuffles_no_line_per_question(spark, tables):
    assert _written(spark, tables, "eval_top1") < 4


def test_interval_antijoin_shuffles_no_line_per_question(spark, tables):
    assert _written(spark, tables, "interval_antijoin") < 4


def test_merge_hits_shuffles_no_line_per_question(spark, tables):
    assert _written(spark, tables, "merge_hits") < 4


def test_score_hits_shuffles_no_line_per_question(spark, tables):
    assert _written(spark, tables, "score_hits") < 4


def test_hybrid_search_shuffles_no_line_per_question(spark, tables):
    assert _written(spark, tables, "hybrid_search") < 8


@pytest.fixture(scope="module")
def long_file(spark, tables, tmp_path_factory):
    """One file of 400 chunks in which all questions have lines."""
    d = str(tmp_path_factory.mktemp("long"))
    rng = random.Random(3)
    rows = [
        (f"c{i}", "repo00", "app/long.py", "python", 40 * i + 1, 40 * i + 41, "\n".join(" ".join(rng.choices(WORDS, k=2)) + f" {rng.getrandbits(160):x}" for _ in range(41)))
        for i in range(400)
    ]
    spark.createDataFrame(rows + rows[:20], CODE).repartition(6).write.parquet(f"{d}/code_chunks.parquet")
    spark.read.parquet(f"{tables}/eval_cases.parquet").write.parquet(f"{d}/eval_cases.parquet")
    return d


def test_interval_antijoin_shuffles_no_chunk_per_question(spark, long_file):
    assert _written(spark, long_file, "interval_antijoin") < 20


def test_the_nearest_chunks_of_a_task_come_once():
    rows = [(q, f"c{i:02}", "r", "p", float(i % 3)) for i in range(40) for q in (1, 2)]
    pdf = pd.DataFrame(rows + rows[:10], columns=["question_id", "chunk_id", "repo_id", "path", "distance"])
    (got,) = search_queries._least(15)(iter([pdf[:30], pdf[30:70], pdf[70:]]))
    want = sorted({(q, d, c) for q, c, _, _, d in rows})
    assert sorted(got[["question_id", "distance", "chunk_id"]].itertuples(index=False, name=None)) == [x for q in (1, 2) for x in [y for y in want if y[0] == q][:15]]
    assert list(search_queries._least(15)(iter([]))) == []


def test_merge_hits_shuffles_no_chunk_per_question(spark, long_file):
    assert _written(spark, long_file, "merge_hits") < 20


def test_rerank_shuffles_no_chunk_per_question(spark, long_file):
    assert _written(spark, long_file, "rerank") < 20


def test_score_hits_shuffles_no_chunk_per_question(spark, long_file):
    assert _written(spark, long_file, "score_hits") < 20


def test_eval_top1_shuffles_no_chunk_per_question(spark, long_file):
    assert _written(spark, long_file, "eval_top1") < 20


@pytest.fixture(scope="module")
def long_lines(spark, tables, tmp_path_factory):
    """150 lines of 4,000 characters in which nearly all questions have a word; a file of each repository has two texts for one line."""
    d = str(tmp_path_factory.mktemp("lines"))
    rng = random.Random(4)
    line = lambda i: f"  {' '.join(rng.sample(WORDS, 8))} {rng.getrandbits(16000):x}"
    rows = [(f"c{i}", f"repo{i // 50}", f"app/{WORDS[i % 7]}/file{i}.py", "python", 5, 5, line(i)) for i in range(150)]
    rows += [(f"x{i}", f"repo{i}", f"app/{WORDS[50 * i % 7]}/file{50 * i}.py", "python", 4, 6, f"a\r\n{line(i)}\r\nb") for i in range(3)]
    spark.createDataFrame(rows + rows[:20], CODE).repartition(6).write.parquet(f"{d}/code_chunks.parquet")
    spark.read.parquet(f"{tables}/eval_cases.parquet").write.parquet(f"{d}/eval_cases.parquet")
    return d


def test_scores_of_marks_are_those_of_texts(spark, long_lines):
    code = spark.read.parquet(f"{long_lines}/code_chunks.parquet").withColumn("repo_id", F.when(F.col("repo_id") != "repo1", F.col("repo_id")))
    asked = S.understood(spark.createDataFrame(
        [(1, "word1 Word1 'word3 word'"), (2, "directory structure of word5 word_x"), (3, '"word2" `word4` FILE3 app/word2'), (4, None), (5, "missing")], "question_id long, question string"))
    index = S.path_index(code)
    columns = ["question_id", "rank", "source", "repo_id", "path", "line", "matched_keywords", "score"]
    for block in (5000, 2):
        with scratch_space(spark):
            by = {}
            for marks in (False, True):
                found = S.lexical_hits(code, index, asked, S.SearchConfig(block=block), texts=not marks, marks=marks)
                assert found.where("source = 'keyword' and text is not null").isEmpty() == marks
                by[marks] = sorted(map(str, S.score_hits(S.merge_hits(found, found.where("false")), asked).select(columns).collect()))
        assert by[True] == by[False] and len(by[True]) > 200


def test_eval_top1_shuffles_no_text_per_question(spark, long_lines):
    assert _written(spark, long_lines, "eval_top1") < 4


def test_rerank_shuffles_no_text_per_question(spark, long_lines):
    assert _written(spark, long_lines, "rerank") < 4


def test_score_hits_shuffles_no_text_per_question(spark, long_lines):
    assert _written(spark, long_lines, "score_hits") < 4


@pytest.fixture(scope="module")
def many_tasks(spark, tables, tmp_path_factory):
    """The code in 32 files that a task each reads; every task has hits of every question."""
    d = str(tmp_path_factory.mktemp("tasks"))
    spark.createDataFrame(list(_rows(1)), CODE).repartition(32).write.parquet(f"{d}/code_chunks.parquet")
    spark.read.parquet(f"{tables}/eval_cases.parquet").write.parquet(f"{d}/eval_cases.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    yield d
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rerank_shuffles_what_tasks_keep_once(spark, many_tasks):
    assert _written(spark, many_tasks, "rerank") < 3


@pytest.fixture(scope="module")
def many_paths(spark, many_tasks, tmp_path_factory):
    """150 repositories with so many paths that the first few fill the total of most questions."""
    d = str(tmp_path_factory.mktemp("paths"))
    rng = random.Random(6)
    rows = []
    for i in range(6000):
        text = "\n".join(" ".join(rng.sample(WORDS, 6)) for _ in range(4))
        rows.append((f"c{i}", f"repo{i % 150:03}", f"app/{'/'.join(rng.sample(WORDS, 4))}.py", "python", 1, 4, text))
    spark.createDataFrame(rows, CODE).repartition(32).write.parquet(f"{d}/code_chunks.parquet")
    spark.read.parquet(f"{many_tasks}/eval_cases.parquet").write.parquet(f"{d}/eval_cases.parquet")
    return d


def test_score_hits_keeps_no_line_behind_the_paths(spark, many_paths):
    assert _written(spark, many_paths, "score_hits") < 3.5


def test_lines_before_the_last_path_are_kept(spark, many_paths):
    code = spark.read.parquet(f"{many_paths}/code_chunks.parquet").withColumn("repo_id", F.when(F.col("repo_id") != "repo002", F.col("repo_id")))
    asked = S.understood(spark.createDataFrame([(1, "word1 word2 word3"), (2, "word4 Word5 word6 word7"), (3, "missing word8"), (4, "nothing")], "question_id long, question string"))
    index = S.path_index(code)
    columns = ["question_id", "source", "repo_id", "path", "line", "text", "matched_keywords", "ord"]
    for some in (asked, asked.where("question_id < 3")):  # without and with an edge for each question
        for block in (5000, 1):
            with scratch_space(spark):
                want = S.keyword_hits(S.keyword_lines(code, some), S.path_hits(index, some), index.select("repo_id").distinct().count()).select(columns).collect()
                got = S.lexical_hits(code, index, some, S.SearchConfig(block=block)).select(columns).collect()
            assert sorted(map(str, got)) == sorted(map(str, want)) and {r.source for r in want} == {"keyword", "path"}
