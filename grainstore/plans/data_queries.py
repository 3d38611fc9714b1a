"""Queries of the general data-quality problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grainstore.operators.references import orphan_cascade, orphan_report
from grainstore.session import table

_TABLES = ("uploads", "threads", "turns", "project_docs", "project_repos", "projects")


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: table(spark, d, t) for t in _TABLES}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = orphan_cascade(_tables(spark, d), table(spark, d, "deletion_log"))
    return found.where("origin = 'direct'").select("src_table", "row_id", "reason").distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(orphan_cascade(_tables(spark, d), table(spark, d, "deletion_log")))


def queries():
    return {"p6_found": p6_found, "p6_report": p6_report}


def _instant(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, ':\\d\\d(Z|[+-]\\d\\d:?\\d\\d)$') THEN {x} ELSE {x} || 'Z' END)::TIMESTAMPTZ"


_EDGE_SQL = f"""
refs AS (
  SELECT 'uploads' AS src_table, id AS row_id, target_id AS ref, {_instant('created_at')} AS ts,
         CASE WHEN lower(trim(kind)) = 'doc' THEN 'project_docs' WHEN lower(trim(kind)) = 'code' THEN 'project_repos' END AS tgt,
         CAST(id AS VARCHAR) AS own_key
  FROM uploads WHERE target_id IS NOT NULL
  UNION SELECT 'threads', id, CAST(project_id AS VARCHAR), {_instant('created_at')}, 'projects', CAST(id AS VARCHAR)
  FROM threads WHERE project_id IS NOT NULL
  UNION SELECT 'turns', id, CAST(thread_id AS VARCHAR), {_instant('created_at')}, 'threads', CAST(id AS VARCHAR)
  FROM turns WHERE thread_id IS NOT NULL
  UNION SELECT 'project_docs', id, CAST(project_id AS VARCHAR), {_instant('created_at')}, 'projects', doc_id
  FROM project_docs WHERE project_id IS NOT NULL),
targets AS (
  SELECT 'projects' AS tgt, CAST(id AS VARCHAR) AS ref, min({_instant('created_at')}) AS since FROM projects GROUP BY ALL
  UNION ALL SELECT 'threads', CAST(id AS VARCHAR), min({_instant('created_at')}) FROM threads GROUP BY ALL
  UNION ALL SELECT 'project_docs', doc_id, min({_instant('created_at')}) FROM project_docs GROUP BY ALL
  UNION ALL SELECT 'project_repos', repo_id, min({_instant('created_at')}) FROM project_repos GROUP BY ALL),
direct AS (
  SELECT r.*, CASE WHEN t.ref IS NOT NULL THEN 'late'
              WHEN EXISTS (SELECT 1 FROM deletion_log g WHERE g.table_name = r.tgt AND g.record_key = r.ref) THEN 'deleted'
              ELSE 'missing' END AS reason
  FROM refs r LEFT JOIN targets t ON t.tgt = r.tgt AND t.ref = r.ref
  WHERE t.ref IS NULL OR t.since > r.ts)
"""

_INHERITED_SQL = """
records AS (
  SELECT 'threads' AS t, id AS row_id, CAST(id AS VARCHAR) AS key FROM threads
  UNION SELECT 'project_docs', id, doc_id FROM project_docs
  UNION SELECT 'projects', id, CAST(id AS VARCHAR) FROM projects
  UNION SELECT 'project_repos', id, repo_id FROM project_repos),
bad1 AS (
  SELECT c.t, c.key FROM records c LEFT JOIN direct d ON d.src_table = c.t AND d.row_id = c.row_id
  GROUP BY ALL HAVING bool_and(d.row_id IS NOT NULL)),
inh1 AS (
  SELECT r.* FROM refs r SEMI JOIN bad1 b ON b.t = r.tgt AND b.key = r.ref
  WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.src_table = r.src_table AND d.row_id = r.row_id)),
allbad AS (
  SELECT src_table, row_id, ts, reason, 'direct' AS origin FROM direct
  UNION ALL SELECT src_table, row_id, ts, 'inherited', 'inherited' FROM inh1),
bad2 AS (
  SELECT c.t, c.key FROM records c LEFT JOIN allbad d ON d.src_table = c.t AND d.row_id = c.row_id
  GROUP BY ALL HAVING bool_and(d.row_id IS NOT NULL)),
inh2 AS (
  SELECT r.* FROM refs r SEMI JOIN bad2 b ON b.t = r.tgt AND b.key = r.ref
  WHERE NOT EXISTS (SELECT 1 FROM allbad d WHERE d.src_table = r.src_table AND d.row_id = r.row_id)),
everything AS (SELECT * FROM allbad UNION ALL SELECT src_table, row_id, ts, 'inherited', 'inherited' FROM inh2)
"""


def oracle_sql():
    return {
        "p6_found": f"WITH {_EDGE_SQL} SELECT DISTINCT src_table, row_id, reason FROM direct",
        "p6_report": f"""WITH {_EDGE_SQL}, {_INHERITED_SQL}
SELECT src_table, strftime(ts AT TIME ZONE 'UTC', '%Y-%m') AS month, reason, origin, count(*) AS n FROM everything GROUP BY ALL""",
    }
