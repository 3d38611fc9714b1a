"""Queries of the text problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainstore.llm.conversations import conversation_segments, conversations, judged_threads
from grainstore.llm.credentials import credentials
from grainstore.llm.languages import language_spans, mislabelled
from grainstore.llm.leakage import leakage_report, leaked_passages
from grainstore.llm.mixing import mix_sources
from grainstore.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs, near_duplicates
from grainstore.llm.pairs import broken_pairs
from grainstore.llm.source_files import not_hand_written
from grainstore.llm.splitting import split_oversized
from grainstore.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    segments = conversation_segments(spark, f"{d}/turns.parquet")
    return judged_threads(segments, table(spark, d, "threads")).where(F.col("reason").isNotNull())


def p1_conversations(spark: SparkSession, d: str) -> DataFrame:
    segments = conversation_segments(spark, f"{d}/turns.parquet")
    return conversations(segments, table(spark, d, "threads"), table(spark, d, "turns"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return broken_pairs(table(spark, d, "turns")).select("turn_id", "defect")


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(*(table(spark, d, t) for t in ("text_chunks", "code_chunks", "chunk_limits")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("piece_index = 0").select("chunk_id").distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return not_hand_written(table(spark, d, "code_chunks")).select("repo_id", "path")


def _near(spark: SparkSession, d: str):
    return near_duplicates([table(spark, d, t).select("chunk_id", "text") for t in ("code_chunks", "text_chunks")])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_pairs(_near(spark, d))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_groups(_near(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials(table(spark, d, "code_chunks")).select("chunk_id", F.col("line_no").cast("int").alias("line_no")).distinct()


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials(table(spark, d, "code_chunks"), with_text=True)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_cases"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage_report(_leaks(spark, d), table(spark, d, "eval_cases"))


def _mix(spark: SparkSession, d: str):
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).documents


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return mislabelled(table(spark, d, "documents")).select("doc_id", "lang")


def p10_spans(spark: SparkSession, d: str) -> DataFrame:
    return language_spans(table(spark, d, "documents"))


_QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_conversations, p2_found, p3_found, p3_pieces, p4_found, p5_found, p5_groups, p7_found, p7_redacted,
        p8_found, p8_report, p9_shares, p9_mix, p10_found, p10_spans,
    )
}


def queries():
    return dict(_QUERIES)


_INSTANT = "(CASE WHEN regexp_matches(created_at, ':\\d\\d(Z|[+-]\\d\\d:?\\d\\d)$') THEN created_at ELSE created_at || 'Z' END)::TIMESTAMPTZ"
_TURNS = f"""
payload AS (SELECT *, CASE WHEN json_valid(payload_json) THEN payload_json END AS pj FROM turns),
t AS (
  SELECT DISTINCT id, thread_id, {_INSTANT} AS ts,
    CASE WHEN lower(trim(role)) IN ('user', 'human', '사용자') THEN 'user'
         WHEN lower(trim(role)) IN ('assistant', 'ai', 'bot', '어시스턴트') THEN 'assistant'
         WHEN lower(trim(role)) = 'system' THEN 'system' ELSE 'unknown' END AS role,
    CASE WHEN regexp_matches(coalesce(content, ''), '[\\p{{L}}\\p{{N}}]') THEN content
         WHEN regexp_matches(coalesce(pj->>'$.answer_markdown', ''), '[\\p{{L}}\\p{{N}}]') THEN pj->>'$.answer_markdown'
         WHEN regexp_matches(coalesce(pj->>'$.answer', ''), '[\\p{{L}}\\p{{N}}]') THEN pj->>'$.answer'
         WHEN regexp_matches(coalesce(pj->>'$.text', ''), '[\\p{{L}}\\p{{N}}]') THEN pj->>'$.text' END AS txt
  FROM payload WHERE thread_id IS NOT NULL),
o AS (
  SELECT *, lag(role) OVER w AS prev, lead(role) OVER w AS next, row_number() OVER w AS pos
  FROM t WHERE txt IS NOT NULL AND role <> 'system' WINDOW w AS (PARTITION BY thread_id ORDER BY ts, id)),
judged AS (
  SELECT h.id AS thread_id,
    CASE WHEN count(o.id) = 0 THEN 'empty'
         WHEN bool_or(o.role = 'unknown' OR (o.role = 'assistant' AND coalesce(o.prev, 'assistant') = 'assistant')) THEN 'broken'
         WHEN bool_or(o.role = 'user' AND coalesce(o.next, '') <> 'assistant') THEN 'missing_reply' END AS reason
  FROM (SELECT DISTINCT id FROM threads) h LEFT JOIN o ON o.thread_id = h.id GROUP BY 1)
"""

_RUNS = """
chunks AS (SELECT DISTINCT 'code' AS tbl, chunk_id, text FROM code_chunks UNION SELECT 'text', chunk_id, text FROM text_chunks),
w AS (SELECT tbl, chunk_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS ws FROM chunks),
runs AS (SELECT DISTINCT tbl, chunk_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: hash(ws[i], ws[i + 1], ws[i + 2]))) AS g FROM w),
size AS (SELECT tbl, chunk_id, count(*) AS n FROM runs GROUP BY ALL)
"""


_LEAKS = """
dw AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\\p{L}\\p{N}_]+') AS ws FROM documents),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws) - 10), lambda i: array_to_string(ws[i:i+11], ' '))) AS g FROM dw),
iw AS (SELECT item_id, regexp_extract_all(lower(nfc_normalize(passage)), '[\\p{L}\\p{N}_]+') AS ws FROM eval_cases),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(ws) - 10), lambda i: array_to_string(ws[i:i+11], ' '))) AS g FROM iw),
leaks AS (SELECT doc_id, item_id, count(*) AS windows FROM dg JOIN ig USING (g) GROUP BY ALL)
"""


def oracle_sql():
    return {
        "p8_found": f"WITH {_LEAKS} SELECT doc_id, item_id FROM leaks",
        "p8_report": f"""WITH {_LEAKS} SELECT e.item_id, count(l.doc_id) AS docs, coalesce(max(l.windows), 0) AS most_windows
FROM (SELECT DISTINCT item_id FROM eval_cases) e LEFT JOIN leaks l USING (item_id) GROUP BY 1""",
        "p5_found": f"""WITH {_RUNS}, inter AS (SELECT a.tbl, a.chunk_id AS x, b.chunk_id AS y, count(*) AS c
  FROM runs a JOIN runs b ON a.g = b.g AND a.tbl = b.tbl AND a.chunk_id < b.chunk_id GROUP BY ALL)
SELECT x AS chunk_a, y AS chunk_b FROM inter i JOIN size s ON s.tbl = i.tbl AND s.chunk_id = x JOIN size t ON t.tbl = i.tbl AND t.chunk_id = y
WHERE c >= 0.6 * (s.n + t.n - c)""",
        "p1_found": f"WITH {_TURNS} SELECT thread_id, reason FROM judged WHERE reason IS NOT NULL",
        "p1_conversations": f"""WITH {_TURNS} SELECT thread_id, pos AS position, id AS turn_id, role, txt AS text
FROM o SEMI JOIN (SELECT thread_id FROM judged WHERE reason IS NULL) USING (thread_id)""",
        "p3_found": """SELECT DISTINCT chunk_id FROM text_chunks, chunk_limits WHERE chunk_kind = 'text'
  AND (coalesce(length(text) > max_chars, false) OR coalesce(len(regexp_extract_all(text, '\\r\\n|\\n|\\r')) + 1 > max_lines, false))
UNION SELECT DISTINCT chunk_id FROM code_chunks, chunk_limits WHERE chunk_kind = 'code'
  AND (coalesce(length(text) > max_chars, false) OR coalesce(len(regexp_extract_all(text, '\\r\\n|\\n|\\r')) + 1 > max_lines, false))""",
    }
