"""Problem 1: ordered conversations out of message rows, through keyed streaming state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from grainstore.llm.turns import event_time, is_blank, role_of, turn_text
from grainstore.session import scratch, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CONTROL = -(2**62)
_END = "9000-01-01 00:00:00"
#: Latest event time of a turn; later ones share its window, where they are still ordered by their own times.
_LAST = "8000-01-01 00:00:00Z"


@dataclass(frozen=True)
class ConversationConfig:
    """``segment``: length of the event-time window that is one state entry of a thread. ``lateness``: how far event
    times may come out of order before a window closes. ``files_per_batch``: files of one micro-batch (None: all)."""

    segment: str = "1 hour"
    lateness: str = "30 days"
    files_per_batch: int | None = None


def _segment_columns(turns: Column) -> dict[str, Column]:
    """What one closed segment says of its thread; ``turns`` is its ordered array of (ts, id, role)."""
    role = F.transform(turns, lambda t: t["role"])
    pairs = F.arrays_zip(
        F.slice(role, F.lit(1), F.greatest(F.size(role) - 1, F.lit(0))).alias("a"),
        F.slice(role, F.lit(2), F.greatest(F.size(role) - 1, F.lit(0))).alias("b"),
    )
    return {
        "first_role": F.element_at(role, 1),
        "last_role": F.element_at(role, -1),
        "unknown_role": F.exists(role, lambda r: r == "unknown"),
        "double_assistant": F.exists(pairs, lambda p: (p["a"] == "assistant") & (p["b"] == "assistant")),
        "unanswered": F.exists(pairs, lambda p: (p["a"] == "user") & (p["b"] != "assistant")),
    }


def _counted(turns: DataFrame) -> DataFrame:
    """(thread_id, id, role, ts, at) of the turns that count; ``at`` is the event time that windows go by."""
    text = turn_text(F.col("content"), F.col("payload_json"))
    ts = event_time(F.col("created_at"))
    rows = turns.select("thread_id", "id", role_of(F.col("role")).alias("role"), ts.alias("ts"), (~is_blank(text)).alias("counts"))
    rows = rows.withColumn("at", F.when(F.col("thread_id") == _CONTROL, F.col("ts")).otherwise(F.least("ts", F.lit(_LAST).cast("timestamp"))))
    return rows.where(F.col("thread_id").isNotNull() & F.col("counts") & (F.col("role") != "system"))


def _segments(rows: DataFrame, config: ConversationConfig) -> DataFrame:
    return (
        rows.groupBy("thread_id", F.window("at", config.segment))
        .agg(F.sort_array(F.collect_set(F.struct("ts", "id", "role"))).alias("turns"))
        .select("thread_id", F.col("window.start").alias("segment"), "turns")
        .withColumns(_segment_columns(F.col("turns")))
    )


def conversation_segments(spark: SparkSession, turns_path: str, config: ConversationConfig = ConversationConfig()) -> DataFrame:
    """Closed and validated segments of all threads, as emitted by a streaming query over the table at ``turns_path``.

    Keyed state: one entry per thread and event-time window, holding the (time, id, role) of the turns that count; a
    redelivered turn is kept once. The watermark trails the latest event by ``lateness``; late arrivals are buffered
    until it passes a window's end (closure), and the end of the input closes whatever is left (timeout: a control
    row moves the watermark to the end of time, where its own window never closes). Turns later than that are counted by
    a listener over all batches, and the segments they belong to are made anew from all their turns. Unreadable times
    come first, times after the year 8000 last. Texts stay in the table and are joined by id, so state stays small; a
    thread with a third of all rows is spread over its windows. Null thread ids belong to no thread.
    """
    schema = spark.read.parquet(turns_path).select("id", "thread_id", "role", "content", "payload_json", "created_at").schema
    control, out, ckpt = (scratch(spark, f"conversations-{x}") for x in ("control", "segments", "state"))
    spark.createDataFrame([], schema).write.parquet(control)
    folder, _, name = turns_path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema)
    if config.files_per_batch:
        reader = reader.option("maxFilesPerTrigger", config.files_per_batch)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(turns_path)
    single = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    source = reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(turns_path)
    stream = _counted(source.unionByName(spark.readStream.schema(schema).parquet(control)))
    rows = _segments(stream.withWatermark("at", config.lateness), config)
    late = _LateRows()
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.streams.addListener(late)
    try:
        for closing in (False, True, True):  # a watermark takes effect in the batch after the one that raised it
            if closing:
                end = [(0, _CONTROL, "user", "end", None, _END)]
                spark.createDataFrame(end, schema).coalesce(1).write.mode("append").parquet(control)
            q = rows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", ckpt).trigger(availableNow=True).start(out)
            late.query = q.id
            q.awaitTermination()
            late.rows += sum(x.numRowsDroppedByWatermark for prog in q.recentProgress for x in prog.stateOperators)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(late)
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    closed = spark.read.schema(rows.schema).parquet(out)
    return _corrected(closed, _counted(spark.read.schema(schema).parquet(turns_path)), config) if late.rows else closed


class _LateRows(StreamingQueryListener):
    """Counts the rows that all batches of a query drop as late."""

    def __init__(self):
        self.rows, self.query = 0, None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if self.query is None or event.progress.id == self.query:
            self.rows += sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryTerminated(self, event) -> None:
        pass


def _corrected(closed: DataFrame, rows: DataFrame, config: ConversationConfig) -> DataFrame:
    """Segments with those that turns came too late for made anew from all their turns; no row is lost to lateness."""
    held = closed.select("thread_id", F.explode("turns").alias("t")).select("thread_id", F.col("t.id").alias("id"))
    segment = F.window("at", config.segment)["start"].alias("segment")
    missed = rows.join(held, ["thread_id", "id"], "left_anti").select("thread_id", segment).distinct()
    keyed = rows.select("*", segment)
    again = _segments(keyed.join(missed, ["thread_id", "segment"], "left_semi").drop("segment"), config)
    return written(closed.join(missed, ["thread_id", "segment"], "left_anti").unionByName(again.select(closed.columns)), "segments")


def judged_threads(segments: DataFrame, threads: DataFrame) -> DataFrame:
    """(thread_id, reason) for each id in ``threads``; a null reason marks a whole conversation.

    ``empty``: no turn counts. Else ``broken``: an unknown role, an assistant's turn first, or two in a row. Else
    ``missing_reply``: a user turn without an assistant turn directly after it. Segments are stitched by their first
    and last roles only, one small row per thread and window.
    """
    w = Window.partitionBy("thread_id").orderBy("segment")
    stitched = (
        segments.drop("turns")
        .withColumns({"before": F.lag("last_role").over(w), "after": F.lead("first_role").over(w)})
        .groupBy("thread_id")
        .agg(
            F.bool_or(
                F.col("unknown_role") | F.col("double_assistant")
                | ((F.col("first_role") == "assistant") & F.coalesce(F.col("before") == "assistant", F.lit(True)))
            ).alias("broken"),
            F.bool_or(F.col("unanswered") | ((F.col("last_role") == "user") & F.coalesce(F.col("after") != "assistant", F.lit(True)))).alias("open"),
        )
    )
    known = threads.where(F.col("id").isNotNull()).select(F.col("id").alias("thread_id")).distinct()
    return known.join(stitched, "thread_id", "left").select(
        "thread_id",
        F.when(F.col("broken").isNull(), "empty").when(F.col("broken"), "broken").when(F.col("open"), "missing_reply").alias("reason"),
    )


def conversations(segments: DataFrame, threads: DataFrame, turns: DataFrame) -> DataFrame:
    """The whole conversations, one row per turn: (thread_id, position, turn_id, role, text), positions from 1.

    A conversation of any length is never gathered into one row or task.
    """
    w = Window.partitionBy("thread_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    whole = judged_threads(segments, threads).where(F.col("reason").isNull()).select("thread_id")
    placed = (
        segments.select("thread_id", "segment", F.size("turns").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
        .drop("n")
        .join(segments.select("thread_id", "segment", "turns"), ["thread_id", "segment"])
        .join(whole, "thread_id", "left_semi")
        .select("thread_id", "before", F.posexplode("turns").alias("i", "turn"))
        .select("thread_id", (F.col("before") + F.col("i") + 1).alias("position"), F.col("turn.id").alias("turn_id"), F.col("turn.role").alias("role"))
    )
    loaded = F.coalesce("loaded_at", F.lit("1970-01-01").cast("timestamp"))
    text = turn_text(F.col("content"), F.col("payload_json"))
    texts = turns.groupBy(F.col("id").alias("turn_id"), "thread_id").agg(F.max_by(text, F.when(text.isNotNull(), F.struct(loaded, text))).alias("text"))
    return placed.join(texts, ["turn_id", "thread_id"]).select("thread_id", "position", "turn_id", "role", "text")
