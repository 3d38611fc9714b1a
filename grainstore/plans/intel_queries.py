"""Queries on repositories and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainstore.functions import fixed
from grainstore.operators import chunking, repo_intel
from grainstore.session import table, written


def _files(spark: SparkSession, d: str) -> DataFrame:
    return written(chunking.whole_files(table(spark, d, "code_chunks")), "files")


def _members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "project_repos").where("project_id is not null and repo_id is not null").select("project_id", "repo_id").distinct()


def code_signals(spark, d):
    return repo_intel.code_signals(_files(spark, d))


def config_pairs_kv(spark, d):
    """Of files of ``key=value`` lines."""
    return repo_intel.config_pairs(_files(spark, d).where("path like '%.properties'")).select("repo_id", "path", "position", "key", "value")


def config_pairs(spark, d):
    return repo_intel.config_pairs(_files(spark, d)).select("repo_id", "path", "position", "key", "value")


def token_signal_counts(spark, d):
    files = _files(spark, d)
    return repo_intel.signal_counts(files, repo_intel.config_pairs(files.where("path like '%.properties'")), repo_intel.code_signals(files))


def role_top_candidates(spark, d):
    files = _files(spark, d)
    return repo_intel.role_candidates(files, repo_intel.code_signals(files)).select("repo_id", "role", "position", "path", "score")


def _summary(spark, d) -> DataFrame:
    return written(repo_intel.summaries(_files(spark, d), table(spark, d, "project_repos")), "summaries")


def repo_summary(spark, d):
    return _summary(spark, d)


def repo_relations(spark, d):
    return repo_intel.repo_relations(_members(spark, d), _summary(spark, d))


def repo_overview(spark, d):
    summary = _summary(spark, d)
    members = _members(spark, d)
    return repo_intel.overview(members, summary, repo_intel.repo_relations(members, summary))


def line_chunks(spark, d):
    return chunking.line_chunks(_files(spark, d))


def language_guess(spark, d):
    paths = table(spark, d, "code_chunks").where("path is not null").select(F.translate("path", "\\", "/").alias("path")).distinct()
    return paths.select("path", chunking.language_guess(F.col("path")).alias("lang"))


_QUERIES = {
    f.__name__: f
    for f in (code_signals, config_pairs_kv, config_pairs, token_signal_counts, role_top_candidates, repo_summary, repo_relations, repo_overview, line_chunks, language_guess)
}


def queries():
    return dict(_QUERIES)


_STRIP = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_LINES = f"""src AS (SELECT *, lead(s) OVER (PARTITION BY repo_id, path ORDER BY s, text) AS nxt FROM (SELECT DISTINCT repo_id, replace(path, '\\', '/') AS path, coalesce(start_line, 1) AS s, text
  FROM code_chunks WHERE path IS NOT NULL AND text IS NOT NULL)),
cut AS (SELECT repo_id, path, s, nxt, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM src),
own AS (SELECT repo_id, path, s, CASE WHEN nxt IS NULL THEN ls ELSE ls[1:greatest(0, nxt - s)] END AS ls FROM cut),
whole AS (SELECT repo_id, path, flatten(list(ls ORDER BY s)) AS ls FROM own GROUP BY ALL),
lines AS (SELECT repo_id, path, unnest(range(1, len(ls) + 1)) AS line, regexp_replace(unnest(ls), '^{_STRIP}+|{_STRIP}+$', '', 'g') AS text FROM whole)"""
_CODE = "regexp_matches(path, '(?i)\\.(java|kt|py|js|ts|tsx|jsx|go|rb|php|cs)$')"
_SIGNALS = f"""signals AS (SELECT repo_id, path, line, substr(text, 1, {fixed.SIGNAL_CHARS}) AS text FROM lines WHERE {_CODE} AND ({' OR '.join(f"contains(text, '{m}')" for m in fixed.CODE_MARKERS)})
  QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY line) <= {fixed.SIGNALS_PER_FILE})"""
_KV = f"""kv AS (SELECT repo_id, path, line, regexp_replace(split_part(text, '=', 1), '{_STRIP}+$', '') AS key, regexp_replace(substr(text, strpos(text, '=') + 1), '^{_STRIP}+', '') AS value, split_part(text, '=', 1) AS raw
  FROM lines WHERE path LIKE '%.properties' AND contains(text, '=') AND NOT starts_with(text, '#') AND NOT starts_with(text, '-')),
pairs AS (SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id, path ORDER BY line) - 1 AS position, key, value FROM kv
  WHERE {' OR '.join(f"contains(lower(raw), '{w}')" for w in fixed.CONFIG_WORDS)} QUALIFY position < {fixed.PAIRS_PER_FILE})"""


def _count(x: str, words) -> str:
    return "(" + " + ".join(f"(length({x}) - length(replace({x}, '{w}', ''))) // {len(w)}" for w in words) + ")"


def oracle_sql():
    roles = " UNION ALL ".join(
        f"SELECT f.repo_id, '{r}' AS role, f.path, {_count('lower(f.path)', w[0])} + coalesce((SELECT sum({_count('lower(s.text)', w[1])}) FROM signals s WHERE s.repo_id = f.repo_id "
        f"AND regexp_extract(s.path, '[^/]*$') = regexp_extract(f.path, '[^/]*$')), 0) AS score FROM f"
        for r, w in fixed.ROLE_WORDS.items()
    )
    return {
        "code_signals": f"WITH {_LINES}, {_SIGNALS} SELECT repo_id, path, line, text FROM signals",
        "config_pairs_kv": f"WITH {_LINES}, {_KV} SELECT repo_id, path, position, key, value FROM pairs",
        "token_signal_counts": f"""WITH {_LINES}, {_SIGNALS}, {_KV}, rows AS (SELECT repo_id, lower(path) AS x, NULL AS key FROM whole WHERE {_CODE}
  UNION ALL SELECT repo_id, lower(key || ' ' || value), lower(key) FROM pairs UNION ALL SELECT repo_id, lower(text), NULL FROM signals),
c AS (SELECT repo_id, sum({_count('x', fixed.OUTBOUND_WORDS)}) AS outbound, sum({_count('x', fixed.INBOUND_WORDS)}) AS inbound, sum({_count('x', fixed.TRANSFORM_WORDS)}) AS transform,
  count(*) FILTER (contains(key, 'port')) AS config_port, count(*) FILTER (contains(key, 'url')) AS config_url FROM rows GROUP BY 1)
SELECT *, CASE WHEN outbound > 0 AND inbound > 0 AND transform > 0 THEN 'relay' WHEN outbound > 0 AND inbound > 0 THEN 'gateway' WHEN outbound > 0 THEN 'producer'
  WHEN inbound > 0 THEN 'receiver' WHEN transform > 0 THEN 'processor' ELSE 'application' END AS role FROM c""",
        "role_top_candidates": f"""WITH {_LINES}, {_SIGNALS}, f AS (SELECT repo_id, path FROM whole WHERE {_CODE}), scored AS ({roles})
SELECT repo_id, role, row_number() OVER (PARTITION BY repo_id, role ORDER BY score DESC, path) AS position, path, score FROM scored WHERE score >= {fixed.ROLE_SCORE} QUALIFY position <= {fixed.ROLE_FILES}""",
    }
