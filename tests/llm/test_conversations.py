import pytest
from pyspark.sql import functions as F

from grainstore.llm.conversations import ConversationConfig, conversation_segments, conversations, judged_threads

T = "2024-01-01 00:00:0"
ROWS = [
    (1, 1, "user", "q", None, T + "0"), (2, 1, "assistant", "a", None, T + "1"),
    (3, 2, "assistant", "a", None, T + "0"),
    (4, 3, "user", "q", None, T + "0"),
    (5, 4, "user", " ", None, T + "0"),
    (6, 6, "robot", "x", None, T + "0"),
    (7, 7, "user", "q", None, "9999-12-31 23:59:00"), (8, 7, "ai", None, '{"answer": "late"}', "9999-12-31 23:59:30"),
    (9, 8, "user", "q", None, "no time"), (10, 8, "assistant", "a", None, T + "0"),
    (11, 9, "user", "q", None, "2024-01-01T09:00:00+09:00"), (12, 9, "assistant", "a", None, "2024-06-01 00:00:00"),
    (13, 10, "user", "q", None, "2023-01-01 00:00:00"), (14, 10, "assistant", "a", None, "2023-01-01 00:00:00"),
    (2, 1, "assistant", "a", None, T + "1"), (15, None, "user", "q", None, T + "0"), (16, 1, "system", "s", None, T + "0"),
]
WANT = {2: "broken", 3: "missing_reply", 4: "empty", 5: "empty", 6: "broken"}


def _turns(spark, rows):
    df = spark.createDataFrame(rows, "id long, thread_id long, role string, content string, payload_json string, created_at string")
    return df.withColumn("loaded_at", F.lit("2024-07-01").cast("timestamp"))


def _judged(spark, path, config):
    threads = spark.createDataFrame([(i, "t") for i in [*range(1, 11), 1]], "id long, reason string")
    segments = conversation_segments(spark, path, config)
    reasons = {r.thread_id: r.reason for r in judged_threads(segments, threads).collect()}
    return segments, threads, reasons


@pytest.mark.parametrize("files", [None, 1])
def test_late_extreme_and_unreadable_times_lose_nothing(spark, tmp_path, files):
    path = str(tmp_path / "turns.parquet")
    for i in range(0, len(ROWS), 3):  # many files, so with one a batch some turns come after the watermark has passed
        _turns(spark, ROWS[i : i + 3]).coalesce(1).write.mode("append").parquet(path)
    segments, threads, reasons = _judged(spark, path, ConversationConfig(files_per_batch=files, lateness="1 hour"))
    assert {k: v for k, v in reasons.items() if v} == WANT
    rows = conversations(segments, threads, spark.read.parquet(path)).collect()
    seven = sorted((r.position, r.turn_id, r.role, r.text) for r in rows if r.thread_id == 7)
    assert seven == [(1, 7, "user", "q"), (2, 8, "assistant", "late")]
    assert {r.thread_id for r in rows} == {1, 7, 8, 9, 10} and sum(r.thread_id == 1 for r in rows) == 2


def test_no_turns(spark, tmp_path):
    path = str(tmp_path / "turns.parquet")
    _turns(spark, []).write.parquet(path)
    _, _, reasons = _judged(spark, path, ConversationConfig())
    assert set(reasons.values()) == {"empty"}
