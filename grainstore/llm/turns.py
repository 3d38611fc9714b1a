"""Terms shared by the operators on chat turns: text, blankness, roles and order of a thread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainstore.functions.instants import instant

#: Role spellings, compared without regard to case and outer spaces (fixed values).
USER_ROLES = ("user", "human", "사용자")
ASSISTANT_ROLES = ("assistant", "ai", "bot", "어시스턴트")
SYSTEM_ROLES = ("system",)

#: Keys of a payload that may hold the answer, in order (fixed values).
ANSWER_KEYS = ("answer_markdown", "answer", "text")


def is_blank(text: Column) -> Column:
    """Null, or without any letter or digit."""
    return text.isNull() | ~text.rlike(r"[\p{L}\p{N}]")


def payload_answer(payload: Column) -> Column:
    """The first answer in a well-formed JSON payload; null where the payload is malformed or has none."""
    found = [F.get_json_object(payload, f"$.{k}") for k in ANSWER_KEYS]
    return F.coalesce(*[F.when(~is_blank(x), x) for x in found], F.lit(None).cast("string"))


def turn_text(content: Column, payload: Column) -> Column:
    """``content``; where that is blank, the answer in the payload."""
    return F.when(~is_blank(content), content).otherwise(payload_answer(payload))


def role_of(role: Column) -> Column:
    """user, assistant, system or unknown."""
    r = F.lower(F.regexp_replace(F.coalesce(role, F.lit("")), r"(?U)^\s+|\s+$", ""))
    return (
        F.when(r.isin(*USER_ROLES), "user")
        .when(r.isin(*ASSISTANT_ROLES), "assistant")
        .when(r.isin(*SYSTEM_ROLES), "system")
        .otherwise("unknown")
    )


def event_time(created_at: Column) -> Column:
    """The instant of a turn; an unreadable time sorts before all others."""
    return F.coalesce(instant(created_at), F.lit("1970-01-01 00:00:00Z").cast("timestamp"))


def ordered_lag(rows: DataFrame, key: str, at: str, tie: str, columns: list[str], segment: str = "day") -> DataFrame:
    """``rows`` with ``prev`` (a struct of ``columns`` of the row before it in its ``key``; null for the first).

    A key may hold a third of all rows, so its rows aren't ordered in one task: they are ordered within segments of
    time, and a second, far smaller window over the segments' last rows hands each segment's first row its
    predecessor. Rows need a non-null ``key`` and ``at``.
    """
    from pyspark.sql import Window as W

    seg = F.date_trunc(segment, at)
    here = F.struct(*columns)
    w = W.partitionBy(key, "_seg").orderBy(at, tie)
    inner = rows.withColumn("_seg", seg).withColumns({"prev": F.lag(here).over(w), "_first": F.row_number().over(w) == 1})
    tails = (
        rows.withColumn("_seg", seg)
        .groupBy(key, "_seg")
        .agg(F.max_by(here, F.struct(at, tie)).alias("_tail"))
        .withColumn("_before", F.lag("_tail").over(W.partitionBy(key).orderBy("_seg")))
        .where(F.col("_before").isNotNull())
        .select(key, "_seg", F.lit(True).alias("_first"), "_before")
    )
    out = inner.join(tails, [key, "_seg", "_first"], "left")
    return out.withColumn("prev", F.coalesce("prev", "_before")).drop("_seg", "_first", "_before")
