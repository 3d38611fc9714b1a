import pytest
from pyspark.sql import functions as F

from grainstore.functions import text as T


def _one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "question, expected",
    [
        ("AuthController에서 /api/login 처리 위치 알려줘", ["AuthController", "/api/login", "login", "api", "처리"]),
        ("`AuthController`에서 /api/login 처리 위치 알려줘", ["`AuthController`", "AuthController", "/api/login", "login", "api", "처리"]),
        ("find UserService", ["UserService", "find"]),
        ("", []),
        (None, []),
    ],
)
def test_keywords(spark, question, expected):
    assert _one(spark, question, T.keywords) == expected


def test_symbol_hints_and_types(spark):
    assert _one(spark, "AuthController에서 /api/login 처리 위치 알려줘", lambda q: T.symbol_hints(T.keywords(q))) == ["AuthController"]
    assert _one(spark, "AuthController에서 /api/login 처리 위치 알려줘", T.question_type) == "general"
    assert _one(spark, "stack overflow?", T.question_type) == "structure"  # by substring
    assert _one(spark, None, T.question_type) == "general"


@pytest.mark.parametrize("kind, repos, limit", [("structure", 3, 18), ("structure", 6, 24), ("general", 3, 12), ("structure", 0, 12)])
def test_rerank_limit(spark, kind, repos, limit):
    assert spark.range(1).select(T.rerank_limit(F.lit(kind), F.lit(repos)).alias("n")).first().n == limit


def test_tokens_of_paths_and_keywords(spark):
    path = _one(spark, "alarm/service/alarm_service_impl.java", T.search_tokens)
    assert set(path) == {"alarm", "service", "impl", "alarmserviceimpl", "java", "alarmservicealarmserviceimpljava"}
    assert set(_one(spark, "AlarmServiceImpl", T.search_tokens)) == {"alarm", "service", "impl", "alarmserviceimpl"}
    assert _one(spark, "처리", T.search_tokens) == []
    assert {"http", "server", "impl"} <= set(_one(spark, "HTTPServerImpl", T.search_tokens))


def test_a_keyword_without_tokens_matches_every_path(spark):
    match = lambda k: spark.range(1).select(T.matches_path(F.lit(k), F.lit("a/b.py"), T.search_tokens(F.lit("a/b.py"))).alias("m")).first().m
    assert match("처리") and not match("zebra")


def test_normalized(spark):
    assert _one(spark, "　 a  b\t\tc\n\n\n\nd \n", T.normalized) == "a b c\n\nd"
    assert _one(spark, None, T.normalized) == ""


def test_phrases_are_read_in_one_pass(spark):
    bonus = lambda q, t: spark.range(1).select(T.phrase_bonus(F.lit(q), F.lit(t)).alias("b")).first().b
    assert bonus("'one' and \"two\" and `three`", "ONE two three") == 1.5
    assert bonus("no quotes", "no quotes") == 0.0
