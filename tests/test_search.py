import numpy as np
import pytest
from pyspark.sql import functions as F

from grainstore.functions import text as T
from grainstore.operators import search as S


def _score(spark, kind, hit, question, words, hints):
    cols = {k: F.lit(v) for k, v in hit.items() if k != "matched"}
    cols["matched"] = F.array(*[F.lit(m) for m in hit["matched"]]) if hit["matched"] is not None else F.lit(None).cast("array<string>")
    arr = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    return spark.range(1).select(T.hit_score(cols, F.lit(question), F.lit(kind), arr(words), arr(hints)).alias("s")).first().s


def test_scores_of_the_worked_example(spark):
    question = "AuthController /api/login java"
    near = {"source": "vector", "path": "auth/controller/AuthController.java", "text": "class AuthController login", "matched": None, "distance": 0.24, "is_code": True}
    far = {"source": "vector", "path": "x/y.py", "text": "nothing", "matched": None, "distance": 0.18, "is_code": True}
    words = ["AuthController", "/api/login", "login"]
    # (1.6 - 0.24) * 1.2 + 2 * 0.45 + min(2, 0.85 * (4 * 0.6 + 1.2 of the name only if asked)) + 1.0 + 0.2
    assert _score(spark, "general", near, "AuthController java controller", words, ["AuthController"]) == pytest.approx(1.632 + 0.9 + min(2, 0.85 * 4 * 0.6) + 1.2, abs=1e-3)
    assert _score(spark, "general", far, question, words, ["AuthController"]) == pytest.approx(1.904, abs=1e-4)
    three = {**near, "path": "auth/AuthController.java", "text": "AuthController login"}
    assert _score(spark, "general", three, "auth AuthController java?", words, ["AuthController"]) == pytest.approx(5.262, abs=1e-4)


def _ranked(spark, rows):
    """(source, kind, path, start, end, score) in rank order."""
    full = [(1, i + 1, s, k, p, a, b, float(sc), 0.5, f"text{i}", None, 0, "r", f"c{i}", "f", None, "general") for i, (s, k, p, a, b, sc) in enumerate(rows)]
    return spark.createDataFrame(
        full,
        "question_id long, position int, source string, kind string, path string, start_line int, end_line int, score double, distance double, text string, "
        "matched_keywords array<string>, line int, repo_id string, chunk_id string, filename string, page int, qtype string",
    )


def test_adjacent_code_is_one_hit(spark):
    rows = [("vector", "code", "a", 10, 20, 3), ("vector", "code", "a", 21, 30, 5), ("vector", "code", "b", 1, 5, 2), ("vector", "code", "a", 1, 4, 1)]
    out = S.coalesce_adjacent(_ranked(spark, rows)).orderBy("position").collect()
    assert [(r.path, r.start_line, r.end_line) for r in out] == [("a", 10, 30), ("b", 1, 5), ("a", 1, 4)]
    assert out[0].score == 5 and out[0].text == "text0\ntext1"


def test_an_earlier_chunk_moves_the_end_back(spark):
    out = S.coalesce_adjacent(_ranked(spark, [("vector", "code", "a", 200, 449, 2), ("vector", "code", "a", 1, 250, 1)])).collect()
    assert [(r.start_line, r.end_line) for r in out] == [(200, 250)]


def test_documents_and_lines_are_not_joined(spark):
    rows = [("vector", "doc", None, None, None, 2), ("vector", "doc", None, None, None, 1), ("keyword", None, "a", None, None, 1)]
    assert S.coalesce_adjacent(_ranked(spark, rows)).count() == 3


def test_the_budget_ends_the_context_at_the_first_long_line(spark):
    rows = [("keyword", None, "a", None, None, 3), ("keyword", None, "b", None, None, 2), ("keyword", None, "c", None, None, 1)]
    df = _ranked(spark, rows).withColumns({"matched_keywords": F.array(F.lit("k")), "text": F.when(F.col("position") == 2, F.repeat(F.lit("x"), 600)).otherwise("y")})
    assert [r.position for r in S.context_lines(df, 1000).orderBy("position").collect()] == [1, 2, 3]
    assert [r.position for r in S.context_lines(df, 200).orderBy("position").collect()] == [1]
    assert S.context_lines(df, 10).count() == 0
    text = S.context(S.context_lines(df, 200)).first().context
    assert text.startswith("[참고 발췌]\n- (kind=keyword, score=3.0, path=a, line=0, keywords=k) y") and len(text) <= 200


def _scored(spark, rows, qtype="general"):
    full = [(1, i + 1, s, qtype, float(sc), f"p{i}") for i, (s, sc) in enumerate(rows)]
    return spark.createDataFrame(full, "question_id long, rank int, source string, qtype string, score double, path string")


def _order(df):
    return [(r.source, r.score) for r in df.orderBy("position").collect()]


def test_diversify(spark):
    mixed = [("keyword", 2), ("path", 9), ("vector", 3), ("path", 8)]
    assert _order(S.diversify(_scored(spark, mixed, "structure"), 3)) == [("path", 9), ("path", 8), ("vector", 3)]
    assert _order(S.diversify(_scored(spark, mixed), 3)) == [("path", 9), ("vector", 3), ("keyword", 2)]
    assert _order(S.diversify(_scored(spark, mixed), 2)) == [("vector", 3), ("keyword", 2)]
    assert S.diversify(_scored(spark, mixed), 0).count() == 0


def test_a_lone_path_hit_comes_twice(spark):
    only = [("path", 5), ("path", 4)]
    assert _order(S.diversify(_scored(spark, only), 12)) == [("path", 5), ("path", 5)]
    assert _order(S.diversify(_scored(spark, only), 1)) == [("path", 5)]


def test_ties_go_by_rank(spark):
    out = S.diversify(_scored(spark, [("keyword", 1), ("vector", 1), ("keyword", 1)]), 3).orderBy("position").collect()
    assert [r.rank for r in out] == [1, 2, 3]


def _corpus(spark):
    return spark.createDataFrame(
        [
            ("r1", "alarm/service/alarm_service_impl.java", 1, 3, "class AlarmServiceImpl {\n  void send() {}\n}", "c1"),
            ("r1", "other/Thing.java", 1, 1, "// nothing here", "c2"),
            ("r2", "auth/controller/AuthController.java", 5, 6, "class AuthController {\r\n  login()", "c3"),
            ("r2", "notes.txt", 1, 1, "AuthController is no source file here", "c4"),
            ("r2", None, 1, 1, "AuthController", "c5"),
            ("r2", "x.py", None, 2, None, "c6"),
        ],
        "repo_id string, path string, start_line int, end_line int, text string, chunk_id string",
    )


def test_lines_and_paths(spark):
    asked = S.understood(spark.createDataFrame([(1, "AuthController login"), (2, "AlarmServiceImpl"), (3, None)], "question_id long, question string"))
    lines = S.keyword_lines(_corpus(spark), asked).collect()
    assert sorted((r.question_id, r.path, r.line, tuple(r.matched_keywords)) for r in lines) == [
        (1, "auth/controller/AuthController.java", 5, ("AuthController",)),
        (1, "auth/controller/AuthController.java", 6, ("login",)),
        (2, "alarm/service/alarm_service_impl.java", 1, ("AlarmServiceImpl",)),
    ]
    hits = S.path_hits(S.path_index(_corpus(spark)), asked).collect()
    found = {(r.question_id, r.path) for r in hits}
    assert (2, "alarm/service/alarm_service_impl.java") in found  # a camel keyword, a snake file
    assert (1, "auth/controller/AuthController.java") in found
    assert (2, "other/Thing.java") not in found


def test_a_substring_counts_only_where_no_path_has_a_token(spark):
    index = S.path_index(spark.createDataFrame([("r1", "a/login.py"), ("r1", "b/loginpage.py"), ("r2", "c/loginpage.py")], "repo_id string, path string"))
    asked = S.understood(spark.createDataFrame([(1, "login")], "question_id long, question string"))
    assert {(r.repo_id, r.path) for r in S.path_hits(index, asked).collect()} == {("r1", "a/login.py"), ("r2", "c/loginpage.py")}


def test_merge_drops_what_lines_cover(spark):
    def h(**k):
        return {"question_id": 1, "repo_id": "r", "matched_keywords": ["k"], **k}

    schema = "question_id long, source string, kind string, repo_id string, path string, line int, text string, matched_keywords array<string>, chunk_id string, start_line int, end_line int, distance double"
    names = [c.split()[0] for c in schema.split(", ")]
    make = lambda rows: S.hits(
        spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema).withColumn("ord", F.struct(F.col("path").alias("a"), F.lit("").alias("b"), F.coalesce("line", F.lit(0)).cast("long").alias("c"), F.lit(0.0).alias("d"))))
    lexical = make([h(source="keyword", path="a", line=12, text="t"), h(source="path", path="a", line=0, text="a"), h(source="path", path="b", line=0, text="b"), h(source="path", path="z", line=0, text="z")])
    vectors = make([
        h(source="vector", kind="code", path="a", start_line=10, end_line=20, chunk_id="covered", distance=0.1),
        h(source="vector", kind="code", path="b", start_line=10, end_line=20, chunk_id="free", distance=0.2),
        h(source="vector", kind="doc", path=None, chunk_id="doc", distance=0.3),
    ])
    out = S.merge_hits(lexical, vectors).orderBy("rank").collect()
    assert [(r.source, r.path, r.chunk_id) for r in out] == [("keyword", "a", None), ("vector", "b", "free"), ("vector", None, "doc"), ("path", "z", None)]


def test_vector_topk_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x[7] = x[3]  # a tie
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "key long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in (3, 50)], "question_id long, embedding array<double>")
    got = {(r.question_id, r.key) for r in S.vector_topk(rows, queries, 5).collect()}
    want = {(q, int(k)) for q in (3, 50) for k in np.lexsort((np.arange(300), np.round(((x - x[q]) ** 2).sum(1), 9)))[:5]}
    assert got == want
    assert S.vector_topk(rows, queries.where("false"), 5).count() == 0


def test_dedupe_keeps_the_nearest(spark):
    rows = [(1, "c1", 0.3), (1, "c1", 0.1), (1, None, 0.2), (1, None, 0.4)]
    df = S.hits(spark.createDataFrame(rows, "question_id long, chunk_id string, distance double").withColumn("kind", F.lit("doc")))
    assert sorted(r.distance for r in S.vector_dedupe(df, 9).collect()) == [0.1, 0.2]
    assert S.vector_dedupe(df, 1).count() == 1


def test_the_whole_way_on_small_and_empty_tables(spark):
    docs = spark.createDataFrame([("t1", "d1", "a.pdf", 1, "AuthController login page")], "chunk_id string, doc_id string, filename string, page int, text string")
    questions = spark.createDataFrame([(1, "AuthController login"), (2, None)], "question_id long, question string")
    out = S.hybrid_search(_corpus(spark), docs, questions).orderBy("question_id", "position").collect()
    assert {r.question_id for r in out} == {1}
    assert out[0].path == "auth/controller/AuthController.java"
    assert S.hybrid_search(_corpus(spark).where("false"), docs.where("false"), questions).count() == 0
