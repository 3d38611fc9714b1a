"""References to records that do not exist: direct findings, then a fixpoint down the foreign-key graph."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainstore.functions.instants import instant
from grainstore.session import written


@dataclass(frozen=True)
class Edge:
    """Field ``column`` of ``source`` holds keys (``key``) of ``target``; with ``kind``, only in rows of that kind."""

    source: str
    column: str
    target: str
    key: str
    kind: str | None = None


#: The foreign keys of the metadata tables.
EDGES = (
    Edge("uploads", "target_id", "project_docs", "doc_id", "doc"),
    Edge("uploads", "target_id", "project_repos", "repo_id", "code"),
    Edge("threads", "project_id", "projects", "id"),
    Edge("turns", "thread_id", "threads", "id"),
    Edge("project_docs", "project_id", "projects", "id"),
)


def _rows(tables: dict[str, DataFrame], edge: Edge) -> DataFrame:
    """(row_id, ref, at, own_key) of an edge's non-null references; a redelivered row comes once."""
    df = tables[edge.source]
    if edge.kind is not None:
        df = df.where(F.lower(F.trim("kind")) == edge.kind)
    own = next((e.key for e in EDGES if e.target == edge.source), "id")
    return (
        df.where(F.col(edge.column).isNotNull())
        .select(
            F.col("id").alias("row_id"),
            F.col(edge.column).cast("string").alias("ref"),
            instant(F.col("created_at")).alias("at"),
            F.col(own).cast("string").alias("own_key"),
        )
        .distinct()
    )


def direct_orphans(tables: dict[str, DataFrame], deletion_log: DataFrame, edges: tuple[Edge, ...] = EDGES) -> DataFrame:
    """One row per faulty reference: (src_table, row_id, ref, own_key, at, reason).

    ``deleted``: the key is not in its target but in the deletion log under the target's name. ``missing``: in
    neither. ``late``: it is there, but its earliest ``created_at`` lies after the row's. A key that was deleted and
    exists again is no fault. Null references are none; an unreadable time is never late. A kind that names no
    table refers to nothing and is ``missing``.

    Targets and deleted keys are reduced to one row per key before the join, so it cannot multiply rows; the side
    that may be hot (many rows with one key) is the streamed one, which adaptive execution splits when skewed.
    """
    out = []
    for edge in edges:
        target = (
            tables[edge.target]
            .groupBy(F.col(edge.key).cast("string").alias("ref"))
            .agg(F.min(instant(F.col("created_at"))).alias("since"))
            .where(F.col("ref").isNotNull())
            .withColumn("there", F.lit(True))
        )
        gone = (
            deletion_log.where(F.col("table_name") == edge.target)
            .select(F.col("record_key").alias("ref"), F.lit(True).alias("gone"))
            .distinct()
        )
        out.append(
            _rows(tables, edge)
            .join(target, "ref", "left")
            .withColumn(
                "state",
                F.when(F.col("there").isNull(), "absent").when(F.col("since") > F.col("at"), "late"),
            )
            .where(F.col("state").isNotNull())
            .join(gone, "ref", "left")
            .select(
                F.lit(edge.source).alias("src_table"),
                "row_id",
                "ref",
                "own_key",
                "at",
                F.when(F.col("state") == "late", "late").when(F.col("gone"), "deleted").otherwise("missing").alias("reason"),
            )
        )
    kinds = {}
    for e in edges:
        if e.kind is not None:
            kinds.setdefault((e.source, e.column), []).append(e.kind)
    for (source, column), known in kinds.items():
        kind = F.coalesce(F.lower(F.trim("kind")), F.lit(""))
        out.append(
            tables[source]
            .where(F.col(column).isNotNull() & ~kind.isin(known))
            .select(
                F.lit(source).alias("src_table"),
                F.col("id").alias("row_id"),
                F.col(column).cast("string").alias("ref"),
                F.col("id").cast("string").alias("own_key"),
                instant(F.col("created_at")).alias("at"),
                F.lit("missing").alias("reason"),
            )
            .distinct()
        )
    return reduce(DataFrame.unionByName, out)


def orphan_cascade(tables: dict[str, DataFrame], deletion_log: DataFrame, edges: tuple[Edge, ...] = EDGES) -> DataFrame:
    """Direct and inherited orphans: the columns of ``direct_orphans`` plus ``origin`` and ``depth``.

    A record is orphaned when each of its rows is. Rows that refer to an orphaned record and are not orphans
    themselves inherit that (reason ``inherited``). Each round semi-joins the children of the last round's finds along
    the edges whose target had any; the loop ends when a round finds none, however deep the chain (a cyclic graph cannot
    run on, since a row is found once). Each round's finds are written to the shared folder, so lineage stays flat.
    """
    found = written(
        direct_orphans(tables, deletion_log, edges).withColumns({"origin": F.lit("direct"), "depth": F.lit(0)}), "orphans"
    )
    frontier, depth = found, 0
    while True:
        depth += 1
        # names of tables, few of them
        hit = {r[0] for r in frontier.select("src_table").distinct().collect()}
        live = [e for e in edges if e.target in hit]
        if not live:
            break
        finds = []
        for edge in live:
            bad = frontier.where(F.col("src_table") == edge.target).select(F.col("own_key").alias("ref")).distinct()
            sound = (
                tables[edge.target]
                .select(F.col("id").alias("row_id"), F.col(edge.key).cast("string").alias("ref"))
                .join(bad, "ref", "left_semi")
                .join(found.where(F.col("src_table") == edge.target).select("row_id"), "row_id", "left_anti")
                .select("ref")
            )
            finds.append(
                _rows(tables, edge)
                .join(bad.join(sound, "ref", "left_anti"), "ref", "left_semi")
                .select(F.lit(edge.source).alias("src_table"), "row_id", "ref", "own_key", "at", F.lit("inherited").alias("reason"))
            )
        fresh = reduce(DataFrame.unionByName, finds).join(
            found.select("src_table", "row_id", "ref"), ["src_table", "row_id", "ref"], "left_anti"
        )
        frontier = written(fresh.select(*found.columns[:6], F.lit("inherited").alias("origin"), F.lit(depth).alias("depth")), "orphans")
        found = found.unionByName(frontier)
    return found


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per table, month of ``created_at`` (UTC; null where unreadable), reason and origin."""
    month = F.substring(F.date_format(F.to_utc_timestamp("at", F.current_timezone()), "yyyy-MM-dd"), 1, 7)
    return orphans.groupBy("src_table", month.alias("month"), "reason", "origin").agg(F.count("*").alias("n"))
