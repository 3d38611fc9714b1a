"""Queries of the metadata store and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainstore.functions.instants import instant
from grainstore.operators import store
from grainstore.session import table


def _once(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Rows of a table, a redelivered record once."""
    rows = table(spark, d, name)
    return rows.drop("loaded_at").dropDuplicates(["id"]) if "loaded_at" in rows.columns else rows.dropDuplicates(["id"])


def projects_order(spark, d):
    return store.listing(_once(spark, d, "projects"), "created_at").select("id", "position")


def docs_order(spark, d):
    return store.listing(_once(spark, d, "project_docs").where("project_id is not null"), "created_at", "project_id").select("id", "project_id", "position")


def thread_latest(spark, d):
    return store.listing(_once(spark, d, "threads").where("project_id is not null"), "updated_at", "project_id").select("id", "project_id", "position")


def thread_search(spark, d):
    return store.thread_search(_once(spark, d, "threads"), "lease").select("id", "title", "tag")


def turns_tail(spark, d):
    """The last 30 turns of each thread, by id."""
    w = Window.partitionBy("thread_id").orderBy(F.desc("id"))
    return _once(spark, d, "turns").where("thread_id is not null").withColumn("n", F.row_number().over(w)).where("n <= 30").select("thread_id", "id", "n")


def last_assistant_turn(spark, d):
    return store.last_payload(_once(spark, d, "turns").where("thread_id is not null"))


def _targets(spark, d) -> DataFrame:
    rows = table(spark, d, "uploads").where("project_id is not null and target_id is not null")
    kind = F.lower(F.trim("kind"))
    return rows.select("project_id", kind.alias("target_kind"), F.col("target_id").alias("target_ref_id"), "filename", F.col("created_at").alias("updated_at"), "id").where(
        F.col("target_kind").isin("doc", "code"))


def target_upsert_latest(spark, d):
    """Targets out of uploads: the latest row of each (project, kind, asset)."""
    keys = ["project_id", "target_kind", "target_ref_id"]
    return store.latest(_targets(spark, d), keys, instant(F.col("updated_at")), F.col("id")).select(*keys, "updated_at", "id")


def target_order(spark, d):
    rows = target_upsert_latest(spark, d).join(_targets(spark, d).select("id", "filename").distinct(), "id")
    w = Window.partitionBy("project_id").orderBy("target_kind", "filename", F.desc_nulls_last(instant(F.col("updated_at"))), F.desc("id"))
    return rows.select("project_id", "id", F.row_number().over(w).alias("position"))


def _assets(spark, d) -> DataFrame:
    docs = table(spark, d, "project_docs").where("project_id is not null and doc_id is not null").select("project_id", F.lit("doc").alias("kind"), F.col("doc_id").alias("ref_id"))
    repos = table(spark, d, "project_repos").where("project_id is not null and repo_id is not null").select("project_id", F.lit("code").alias("kind"), F.col("repo_id").alias("ref_id"))
    return docs.unionByName(repos).distinct()


def _settings(spark, d) -> DataFrame:
    """Every third project asks its active targets alone; projects above 300 have no settings."""
    return table(spark, d, "projects").where("id <= 300").select(F.col("id").alias("project_id"), (F.col("id") % 3 == 0).cast("int").alias("active_only")).distinct()


def scope_filter(spark, d):
    return store.active_assets(_assets(spark, d), _targets(spark, d), _settings(spark, d)).select("project_id", "kind", "ref_id")


def asset_counts(spark, d):
    scope = store.active_assets(_assets(spark, d), _targets(spark, d), _settings(spark, d))
    return scope.groupBy("project_id").agg(F.count_if(F.col("kind") == "doc").alias("docs"), F.count_if(F.col("kind") == "code").alias("repos"))


def scope_chunks(spark, d):
    """How many chunks lie in each project's scope."""
    scope = store.active_assets(_assets(spark, d), _targets(spark, d), _settings(spark, d))
    code = table(spark, d, "code_chunks").select(F.lit("code").alias("kind"), F.col("repo_id").alias("ref_id"), "chunk_id")
    docs = table(spark, d, "text_chunks").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("ref_id"), "chunk_id")
    sizes = code.unionByName(docs).distinct().groupBy("kind", "ref_id").agg(F.count("*").alias("n"))
    return scope.join(sizes, ["kind", "ref_id"]).groupBy("project_id").agg(F.sum("n").alias("chunks"))


def delete_cascade(spark, d):
    """Rows left of each table when the projects with an even id are deleted, and the files to be removed."""
    names = ("projects", "threads", "turns", "project_docs", "project_repos")
    tables = {n: _once(spark, d, n) for n in names}
    left = store.delete_projects(tables, tables["projects"].where("id % 2 = 0").select(F.col("id").alias("project_id")))
    out = None
    for n in (*names, "files"):
        part = left[n].agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def insert_absent(spark, d):
    """Documents by project and hash: the first of each is kept, the others are no news."""
    docs = _once(spark, d, "project_docs").where("project_id is not null and sha256 is not null")
    half = store.insert_if_absent(docs.where("false"), docs.where("id % 2 = 0"), ["project_id", "sha256"])
    return store.insert_if_absent(half, docs.where("id % 2 = 1"), ["project_id", "sha256"]).groupBy("project_id").agg(F.count("*").alias("docs"))


def thread_touch(spark, d):
    """``updated_at`` of the threads after all their turns are added again."""
    turns = _once(spark, d, "turns").where("thread_id is not null")
    tables = {"threads": _once(spark, d, "threads"), "turns": turns.where("false")}
    return store.add_turns(tables, turns)["threads"].select("id", "updated_at")


def csv_row_render(spark, d):
    rows = table(spark, d, "mix_targets")
    return rows.select("source", store.csv_lines(["source", "max_repeats"]).alias("line"), store.thread_title(F.col("source")).alias("title"))


_QUERIES = {
    f.__name__: f
    for f in (
        projects_order, docs_order, thread_latest, thread_search, turns_tail, last_assistant_turn, target_upsert_latest, target_order,
        scope_filter, asset_counts, scope_chunks, delete_cascade, insert_absent, thread_touch, csv_row_render,
    )
}


def queries():
    return dict(_QUERIES)


def _at(x: str) -> str:
    return f"(CASE WHEN regexp_matches(trim({x}), ':\\d\\d(\\.\\d+)?\\s*(Z|[+-]\\d\\d(:?\\d\\d)?)$') THEN trim({x}) ELSE trim({x}) || 'Z' END)::TIMESTAMPTZ"


_TARGETS = f"""t AS (SELECT DISTINCT project_id, lower(trim(kind)) AS target_kind, target_id AS target_ref_id, filename, created_at AS updated_at, id FROM uploads
  WHERE project_id IS NOT NULL AND target_id IS NOT NULL AND lower(trim(kind)) IN ('doc', 'code')),
newest AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY project_id, target_kind, target_ref_id ORDER BY {_at('updated_at')} DESC, id DESC) = 1)"""
_SCOPE = f"""{_TARGETS}, assets AS (SELECT DISTINCT project_id, 'doc' AS kind, doc_id AS ref_id FROM project_docs WHERE project_id IS NOT NULL AND doc_id IS NOT NULL
  UNION SELECT project_id, 'code', repo_id FROM project_repos WHERE project_id IS NOT NULL AND repo_id IS NOT NULL),
strict AS (SELECT DISTINCT id AS project_id FROM projects WHERE id <= 300 AND id % 3 = 0),
scope AS (SELECT a.* FROM assets a WHERE a.project_id NOT IN (SELECT project_id FROM strict)
  OR EXISTS (SELECT 1 FROM t WHERE t.project_id = a.project_id AND t.target_kind = a.kind AND t.target_ref_id = a.ref_id))"""


def oracle_sql():
    order = lambda name, at, part: f"""SELECT id, {part + ',' if part else ''} row_number() OVER ({'PARTITION BY ' + part if part else ''} ORDER BY x DESC NULLS LAST, id DESC) AS position
FROM (SELECT DISTINCT ON (id) *, {_at(at)} AS x FROM {name}) {f'WHERE {part} IS NOT NULL' if part else ''}"""  # noqa: E731
    return {
        "projects_order": order("projects", "created_at", ""),
        "docs_order": order("project_docs", "created_at", "project_id"),
        "thread_latest": order("threads", "updated_at", "project_id"),
        "thread_search": "SELECT DISTINCT id, title, tag FROM threads WHERE title ILIKE '%lease%' OR tag ILIKE '%lease%'",
        "turns_tail": """SELECT thread_id, id, n FROM (SELECT thread_id, id, row_number() OVER (PARTITION BY thread_id ORDER BY id DESC) AS n
FROM (SELECT DISTINCT id, thread_id FROM turns WHERE thread_id IS NOT NULL)) WHERE n <= 30""",
        "last_assistant_turn": """SELECT thread_id, arg_max(payload_json, id) AS payload_json FROM turns WHERE thread_id IS NOT NULL AND lower(trim(role)) = 'assistant'
AND json_valid(payload_json) AND json_type(CASE WHEN json_valid(payload_json) THEN payload_json END) = 'OBJECT' GROUP BY 1""",
        "target_upsert_latest": f"WITH {_TARGETS} SELECT project_id, target_kind, target_ref_id, updated_at, id FROM newest",
        "target_order": f"""WITH {_TARGETS} SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY target_kind, filename, {_at('updated_at')} DESC, id DESC) AS position FROM newest""",
        "scope_filter": f"WITH {_SCOPE} SELECT project_id, kind, ref_id FROM scope",
        "asset_counts": f"WITH {_SCOPE} SELECT project_id, count(*) FILTER (kind = 'doc') AS docs, count(*) FILTER (kind = 'code') AS repos FROM scope GROUP BY 1",
        "scope_chunks": f"""WITH {_SCOPE}, c AS (SELECT 'code' AS kind, repo_id AS ref_id, count(DISTINCT chunk_id) AS n FROM code_chunks GROUP BY 2
  UNION ALL SELECT 'doc', doc_id, count(DISTINCT chunk_id) FROM text_chunks GROUP BY 2)
SELECT project_id, sum(n) AS chunks FROM scope JOIN c USING (kind, ref_id) GROUP BY 1""",
        "delete_cascade": """WITH gone AS (SELECT id FROM projects WHERE id % 2 = 0), th AS (SELECT DISTINCT ON (id) * FROM threads), tu AS (SELECT DISTINCT ON (id) * FROM turns),
pd AS (SELECT DISTINCT ON (id) * FROM project_docs), pr AS (SELECT DISTINCT ON (id) * FROM project_repos),
paths AS (SELECT project_id, stored_path AS p FROM pd UNION ALL SELECT project_id, zip_path FROM pr UNION ALL SELECT project_id, extract_path FROM pr)
SELECT 'projects' AS name, count(DISTINCT id) AS rows FROM projects WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'threads', count(*) FROM th WHERE project_id IS NULL OR project_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'turns', count(*) FROM tu WHERE thread_id IS NULL OR thread_id NOT IN (SELECT id FROM th WHERE project_id IN (SELECT id FROM gone))
UNION ALL SELECT 'project_docs', count(*) FROM pd WHERE project_id IS NULL OR project_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'project_repos', count(*) FROM pr WHERE project_id IS NULL OR project_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'files', count(DISTINCT p) FROM paths WHERE p IS NOT NULL AND p NOT IN (SELECT p FROM paths WHERE p IS NOT NULL AND (project_id IS NULL OR project_id NOT IN (SELECT id FROM gone)))""",
        "insert_absent": "SELECT project_id, count(DISTINCT sha256) AS docs FROM project_docs WHERE project_id IS NOT NULL AND sha256 IS NOT NULL GROUP BY 1",
        "thread_touch": f"""WITH u AS (SELECT DISTINCT id, thread_id, created_at FROM turns WHERE thread_id IS NOT NULL),
m AS (SELECT thread_id, created_at FROM u QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY {_at('created_at')} DESC NULLS LAST, created_at DESC) = 1),
h AS (SELECT DISTINCT ON (id) * FROM threads)
SELECT h.id, CASE WHEN {_at('m.created_at')} > coalesce({_at('h.updated_at')}, '1970-01-01 00:00:00Z'::TIMESTAMPTZ) THEN m.created_at ELSE h.updated_at END AS updated_at FROM h LEFT JOIN m ON m.thread_id = h.id""",
        "csv_row_render": "SELECT source, 'source: ' || coalesce(source, '') || ' | max_repeats: ' || coalesce(max_repeats::VARCHAR, '') AS line, substr(source, 1, 40) AS title FROM mix_targets",
    }
