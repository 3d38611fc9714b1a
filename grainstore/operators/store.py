"""Metadata of projects, assets, threads and turns: lookups, listings and changes as rewrites of tables.

A change takes tables and gives new ones; nothing is altered in place, so a run that fails leaves the old state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainstore.functions.instants import instant

#: Columns of the metadata tables.
SCHEMAS = {
    "projects": "id long, name string, created_at string",
    "threads": "id long, project_id long, title string, tag string, created_at string, updated_at string",
    "turns": "id long, thread_id long, role string, content string, payload_json string, created_at string",
    "project_docs": "id long, project_id long, filename string, mime string, size long, sha256 string, doc_id string, stored_path string, created_at string",
    "project_repos": "id long, project_id long, filename string, sha256 string, repo_id string, zip_path string, extract_path string, created_at string",
    "project_targets": "project_id long, target_kind string, target_ref_id string, filename string, updated_at string",
    "project_target_settings": "project_id long, active_only int, updated_at string",
}
DEFAULT_TAG = "general"


def empty_tables(spark) -> dict[str, DataFrame]:
    """All tables of the store, without rows."""
    return {name: spark.createDataFrame([], T._parse_datatype_string(schema)) for name, schema in SCHEMAS.items()}


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key; the whole row settles ties, so the result hangs on no partitioning."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order], *[F.desc(c) for c in rows.columns if c not in keys])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def insert_if_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with those ``rows`` whose key it lacks, each key once (projects by name, assets by project and hash)."""
    fresh = latest(rows, keys, F.lit(0)).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(fresh.select(table.columns))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], at: str = "updated_at") -> DataFrame:
    """``table`` with ``rows`` in place of those of the same key; of several rows the latest holds."""
    newest = latest(rows, keys, instant(F.col(at)))
    return table.join(newest.select(*keys), keys, "left_anti").select(table.columns).unionByName(newest.select(table.columns))


def delete_keys(table: DataFrame, keys: DataFrame) -> DataFrame:
    """``table`` without the rows whose key is in ``keys`` (same column names)."""
    return table.join(keys.distinct(), keys.columns, "left_anti").select(table.columns)


def delete_projects(tables: dict[str, DataFrame], projects: DataFrame) -> dict[str, DataFrame]:
    """All tables without the given projects (project_id) and what belongs to them, and, under ``files``, the paths that no
    other project uses any more."""
    gone = projects.select("project_id").distinct()
    threads = tables["threads"].join(gone, "project_id", "left_semi").select(F.col("id").alias("thread_id"))
    out = {
        "projects": delete_keys(tables["projects"], gone.select(F.col("project_id").alias("id"))),
        "threads": delete_keys(tables["threads"], gone),
        "turns": delete_keys(tables["turns"], threads),
    }
    for name in ("project_docs", "project_repos", "project_targets", "project_target_settings"):
        if name in tables:
            out[name] = delete_keys(tables[name], gone)
    paths = lambda t: t["project_docs"].select(F.col("stored_path").alias("path")).unionByName(
        t["project_repos"].select(F.explode(F.array("zip_path", "extract_path")).alias("path"))
    )
    out["files"] = paths(tables).where("path is not null").distinct().join(paths(out), "path", "left_anti")
    return out


def delete_threads(tables: dict[str, DataFrame], threads: DataFrame) -> dict[str, DataFrame]:
    """Threads and turns without the given threads (thread_id)."""
    ids = threads.select("thread_id").distinct()
    return {"threads": delete_keys(tables["threads"], ids.select(F.col("thread_id").alias("id"))), "turns": delete_keys(tables["turns"], ids)}


def add_turns(tables: dict[str, DataFrame], turns: DataFrame) -> dict[str, DataFrame]:
    """Turns with new ones, and threads whose ``updated_at`` is that of their last turn, if it is later."""
    touched = latest(turns.select("thread_id", "created_at"), ["thread_id"], instant(F.col("created_at"))).select(F.col("thread_id").alias("id"), F.col("created_at").alias("_at"))
    threads = tables["threads"].join(touched, "id", "left")
    later = instant(F.col("_at")) > F.coalesce(instant(F.col("updated_at")), F.lit("1970-01-01 00:00:00Z").cast("timestamp"))
    threads = threads.withColumn("updated_at", F.when(later, F.col("_at")).otherwise(F.col("updated_at")))
    return {"turns": tables["turns"].unionByName(turns.select(tables["turns"].columns)), "threads": threads.select(tables["threads"].columns)}


def last_payload(turns: DataFrame) -> DataFrame:
    """(thread_id, payload_json): of each thread's last assistant turn with a well-formed object as payload."""
    good = turns.where((F.lower(F.trim("role")) == "assistant") & F.get_json_object("payload_json", "$").startswith("{"))
    return good.groupBy("thread_id").agg(F.max_by("payload_json", "id").alias("payload_json"))


def active_assets(assets: DataFrame, targets: DataFrame, settings: DataFrame) -> DataFrame:
    """The assets (project_id, kind, ref_id) a project's questions are asked of: all, or only those in ``targets``
    (project_id, target_kind, target_ref_id) where ``settings`` (project_id, active_only) says so; without a row they
    don't."""
    strict = settings.where("active_only = 1").select("project_id").distinct()
    chosen = targets.select("project_id", F.col("target_kind").alias("kind"), F.col("target_ref_id").alias("ref_id")).distinct()
    free = assets.join(strict, "project_id", "left_anti")
    held = assets.join(strict, "project_id", "left_semi").join(chosen, ["project_id", "kind", "ref_id"], "left_semi")
    return free.unionByName(held.select(free.columns))


def in_scope(chunks: DataFrame, scope: DataFrame) -> DataFrame:
    """The chunks (kind, ref_id) of a scope (kind, ref_id); an empty scope has none."""
    return chunks.join(scope.select("kind", "ref_id").distinct(), ["kind", "ref_id"], "left_semi").select(chunks.columns)


def thread_search(threads: DataFrame, text: str) -> DataFrame:
    """Threads whose title or tag is like ``%text%``, whatever the case of ASCII letters; ``%`` and ``_`` are wild cards."""
    return threads.where(F.col("title").ilike(f"%{text}%") | F.col("tag").ilike(f"%{text}%"))


def listing(table: DataFrame, by: str, partition: str | None = None, limit: int | None = None) -> DataFrame:
    """``table`` with ``position`` by the time ``by``, latest first, then by id; per partition, up to ``limit``."""
    w = Window.partitionBy(partition) if partition else Window.partitionBy(F.lit(0))
    out = table.withColumn("position", F.row_number().over(w.orderBy(F.desc_nulls_last(instant(F.col(by))), F.desc("id"))))
    return out if limit is None else out.where(F.col("position") <= limit)


def thread_title(message: Column) -> Column:
    """The first 40 characters of a message."""
    return F.substring(message, 1, 40)


def csv_lines(columns: list[str]) -> Column:
    """One line of text per row: ``name: value`` pairs; a blank name counts as col_N."""
    pairs = [F.concat(F.lit((c.strip() or f"col_{i + 1}") + ": "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for i, c in enumerate(columns)]
    return F.concat_ws(" | ", *pairs)
