"""Chunks of documents by characters and of source files by lines, with their ids."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainstore.functions.text import normalized, strip

#: Languages of suffixes; other suffixes name themselves (fixed values).
LANGUAGE_OF_SUFFIX = {
    "csv": "csv", "pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "py": "python", "java": "java", "js": "javascript", "jsx": "javascript",
    "ts": "typescript", "tsx": "typescript", "yml": "yaml", "yaml": "yaml", "json": "json", "xml": "xml", "md": "markdown", "sql": "sql",
}
LOOKAROUND = 40
PENALTY = 0.03

_BLOCK_LANGUAGES = frozenset("java javascript typescript go cs cpp c php kt".split())
_DATA_LANGUAGES = frozenset("yaml json xml sql markdown properties".split())
_BLOCK_STARTS = re.compile(
    r"(?:public|private|protected|internal|static|final|abstract|sealed|@)|(?:class|interface|enum|record|object|data class|fun|func)\b"
    r"|[A-Za-z0-9_<>\[\], ?]+\s+[A-Za-z_][A-Za-z0-9_]*\s*\("
)
_PYTHON_STARTS = re.compile(r"(?:class|def|async def)\s+")
_DATA_STARTS = re.compile(r"[A-Za-z0-9_.\-]+:|<[^/!?][^>]*>|(?:select|insert|update|delete|create|alter)\b|#+\s", re.I)
_CLOSERS = ("}", "];", ");", ")", ":")
_OPENERS = ("class ", "def ", "async def ", "public ", "private ", "@", "function ")


def document_id(content: Column) -> Column:
    """Of the bytes of a document."""
    return F.concat(F.lit("doc-"), F.substring(F.sha2(content, 256), 1, 16))


def repository_id(content: Column) -> Column:
    """Of the bytes of an archive or a single source file."""
    return F.substring(F.sha2(content, 256), 1, 16)


def language_guess(path: Column) -> Column:
    """Of the file name: known suffixes by their language, others as they are, ``text`` without one."""
    name = F.substring_index(path, "/", -1)
    suffix = F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF_SUFFIX.items() for x in pair])
    return F.when(name == "Dockerfile", "dockerfile").when(suffix == "", "text").otherwise(F.coalesce(known[suffix], suffix))


def char_chunks(pages: DataFrame, size: int = 900, overlap: int = 150) -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap``, of pages (doc_id, page, text).

    (chunk_id, doc_id, page, chunk_index, text, char_start, char_end), positions in the normalised text. A window begins
    wherever text is left, so the last may lie in the one before. Blank windows get no index; a null or blank page has no
    chunk. A page given twice gives its chunks twice.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and the overlap less than it")
    step = size - overlap
    whole = pages.select("doc_id", F.coalesce("page", F.lit(1)).alias("page"), normalized(F.col("text")).alias("text")).where(F.length("text") > 0)
    cut = F.transform(
        F.sequence(F.lit(0), F.length("text") - 1, F.lit(step)),
        lambda at: F.struct(
            strip(F.substring("text", at + 1, F.lit(size))).alias("text"), at.alias("char_start"),
            F.least(at + size, F.length("text")).alias("char_end"),
        ),
    )
    # the index is the place among the windows that aren't blank, so nothing is numbered across rows
    rows = whole.select("doc_id", "page", F.posexplode(F.filter(cut, lambda w: F.length(w["text"]) > 0)).alias("chunk_index", "w"))
    return rows.select(
        F.format_string("%s_p%03d_c%03d", "doc_id", F.col("page").cast("int"), "chunk_index").alias("chunk_id"),
        "doc_id", F.col("page").cast("int").alias("page"), "chunk_index", "w.text", "w.char_start", "w.char_end",
    )


def starts_definition(line: str, language: str) -> bool:
    """Whether a stripped line begins something, by kind of language."""
    if language == "python":
        return _PYTHON_STARTS.match(line) is not None
    if language in _BLOCK_LANGUAGES:
        return _BLOCK_STARTS.match(line) is not None
    return language in _DATA_LANGUAGES and _DATA_STARTS.match(line) is not None


def boundary_scores(lines: list[str], language: str) -> np.ndarray:
    """How good it is to end a chunk before line i, for i up to the number of lines."""
    n = len(lines)
    bare = [x.strip() for x in lines]
    blank = np.array([not x for x in bare], bool)
    edge = blank | np.array([bool(x) and starts_definition(x, language) for x in bare], bool)
    closed = np.array([x.endswith(_CLOSERS) for x in bare], bool)
    opened = np.array([x.startswith(_OPENERS) for x in bare], bool)
    before, after = np.concatenate([[True], blank]), np.concatenate([blank, [True]])
    out = 2.0 * np.concatenate([edge, [True]]) + 1.0 * (before | after)
    out[0] = 2.0 + 1.0
    return out + 0.4 * np.concatenate([[False], closed]) + 0.8 * np.concatenate([opened, [False]])


def line_windows(lines: list[str], language: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) of the chunks of a file: about ``size`` lines, the end moved to the best boundary nearby.

    The end wanted wins ties, then the lowest. Small windows may leave lines out: the next start is at least ``size -
    overlap`` after the last one, whatever the end. A blank piece moves the start by one line.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and the overlap less than it")
    n, out, start = len(lines), [], 0
    score = boundary_scores(lines, language) if lines else np.zeros(1)
    while start < n:
        end = min(start + size, n)
        if end < n:
            ends = np.arange(max(start + 1, end - LOOKAROUND), min(n, end + LOOKAROUND) + 1)
            value = score[ends] - np.abs(ends - end) * PENALTY
            best = int(value.argmax())
            if value[best] > score[end]:
                end = max(start + 1, int(ends[best]))
        if not "".join(lines[start:end]).strip():
            start += 1
            continue
        out.append((start, end))
        if end >= n:
            break
        after = max(start + size - overlap, end - overlap)
        start = after if after > start else end
    return out


def _cut_files(size: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for repo, path, lang, text in zip(pdf["repo_id"], pdf["path"], pdf["lang"], pdf["text"], strict=True):
                lines = text.splitlines()
                for i, (a, b) in enumerate(line_windows(lines, lang, size, overlap)):
                    rows.append((f"{repo}:{path}:L{a + 1}-L{b}:{i:03d}", repo, path, lang, a + 1, b, "\n".join(lines[a:b]).strip()))
            yield pd.DataFrame(rows, columns=["chunk_id", "repo_id", "path", "lang", "start_line", "end_line", "text"])

    return run


def line_chunks(files: DataFrame, size: int = 250, overlap: int = 40) -> DataFrame:
    """(chunk_id, repo_id, path, lang, start_line, end_line, text) of files (repo_id, path, text).

    Each start hangs on the end before it, so a file is cut in one Python pass, alone and where it lies. Null texts and
    paths give nothing.
    """
    rows = files.where(F.col("path").isNotNull() & F.col("text").isNotNull()).select("repo_id", "path", language_guess(F.col("path")).alias("lang"), "text")
    return rows.mapInPandas(_cut_files(size, overlap), "chunk_id string, repo_id string, path string, lang string, start_line int, end_line int, text string")


def whole_files(code_chunks: DataFrame) -> DataFrame:
    """(repo_id, path, text) of files stored as overlapping chunks; a file's lines, each once, in order.

    One file is one row in the end, so it must fit into one; that is what a file is.
    """
    lines = code_chunks.where(F.col("text").isNotNull() & F.col("path").isNotNull()).select(
        "repo_id", F.translate("path", "\\", "/").alias("path"), F.coalesce("start_line", F.lit(1)).alias("start"), F.split("text", r"\r\n|\n|\r").alias("lines")
    )
    w = Window.partitionBy("repo_id", "path").orderBy("start")
    own = F.when(F.col("next").isNull(), F.col("lines")).otherwise(
        F.slice("lines", F.lit(1), F.greatest(F.lit(0), F.least(F.size("lines"), F.col("next") - F.col("start"))))
    )
    return (
        lines.withColumn("next", F.lead("start").over(w))
        .groupBy("repo_id", "path")
        .agg(F.array_sort(F.collect_list(F.struct("start", own.alias("own")))).alias("parts"))
        .select("repo_id", "path", F.array_join(F.flatten(F.transform("parts", lambda p: p["own"])), "\n").alias("text"))
    )
