"""Problem 3: cutting oversized chunks at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Separators from coarse to fine; a boundary lies at the end of each match.
TEXT_LEVELS = (
    re.compile(r"\n(?=#{1,6} )|\f"),
    re.compile(r"\n[ \t\r]*\n+"),
    re.compile(r"[.!?…]+[\"')\]]*\s+|[。！？]+[」』”]*\s*|\n"),
    re.compile(r"\s+"),
)
CODE_LEVELS = (
    re.compile(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)+(?=[^\s})\]])"),
    re.compile(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)+"),
    re.compile(r"\r\n|\n|\r"),
    re.compile(r"[\s,;]+"),
)
BREAK = re.compile(r"\r\n|\n|\r")
PIECE_SCHEMA = (
    "chunk_kind string, chunk_id string, piece_index int, n_pieces int, text string, "
    "char_start long, char_end long, start_line long, end_line long, overlap int"
)


def boundaries(text: str, levels: tuple[re.Pattern, ...], fits) -> list[int]:
    """Ends of the atoms of ``text``: each part that doesn't fit is cut by the next finer level, at last by characters.

    ``fits(lo, hi)`` says whether a part may stay whole.
    """
    ends: list[int] = []
    stack = [(0, len(text), 0)]
    while stack:
        lo, hi, level = stack.pop()
        if fits(lo, hi) or hi - lo <= 1:
            ends.append(hi)
        elif level == len(levels):
            mid = (lo + hi) // 2
            if text[mid - 1] == "\r" and text[mid] == "\n" and mid - 1 > lo:
                mid -= 1
            stack += [(mid, hi, level), (lo, mid, level)]
        else:
            cuts = [m.end() for m in levels[level].finditer(text, lo, hi) if lo < m.end() < hi]
            parts = list(zip([lo, *cuts], [*cuts, hi], strict=True))
            stack += [(a, b, level + 1) for a, b in reversed(parts)]
    return ends


def split_text(text: str, max_chars: int, overlap: int, max_lines: int = 2**31 - 1) -> list[tuple[int, int]]:
    """[start, end) of pieces of at most ``max_chars`` and ``max_lines``; each starts ``overlap`` characters before the
    last one's end, or as many of them as leave room for a new line under ``max_lines``."""
    overlap = max(0, min(overlap, max_chars - 1))
    fresh = max(1, max_chars - overlap)
    breaks, openings = [m.end() for m in BREAK.finditer(text)], [m.start() for m in BREAK.finditer(text)]
    n_breaks = lambda lo, hi: bisect_right(breaks, hi) - bisect_right(breaks, lo)

    def fits(lo: int, hi: int) -> bool:
        return hi - lo <= fresh and n_breaks(lo, hi - 1) < max_lines

    ends = boundaries(text, TEXT_LEVELS, fits)
    out, start, done = [], 0, 0
    while done < len(text):
        limit = min(len(text), start + max_chars)
        first = bisect_right(breaks, start)
        if first + max_lines - 1 < len(breaks):
            limit = min(limit, openings[first + max_lines - 1])  # the break after the last line stays out
        k = bisect_right(ends, limit)
        end = ends[k - 1] if k else 0
        if end <= done:
            end = max(done + 1, limit)
        out.append((start, end))
        done, start = end, max(0, end - overlap)
        # lines repeated must leave one for what is new
        first = bisect_right(breaks, start)
        spare = bisect_right(breaks, done) - first - (max_lines - 1) + (1 if done < len(text) and text[done] in "\r\n" else 0)
        if spare > 0 and done < len(text):
            start = min(done, breaks[first + spare - 1])
    return out


def split_code(text: str, max_chars: int, max_lines: int, overlap_lines: int) -> list[tuple[int, int, int, int]]:
    """(start, end, first line, last line) of pieces, lines from 0, within both limits.

    Pieces are whole lines without the last line's break, cut at definitions, else blank lines, else any line; only a
    line that is itself too long is cut inside. A piece repeats the last ``overlap_lines`` lines of the one before, or
    as many of them as leave room for the next part under the limits.
    """
    starts = [0, *[m.end() for m in BREAK.finditer(text)]]
    stops = [*[m.start() for m in BREAK.finditer(text)], len(text)]
    line_at = lambda pos: bisect_right(starts, pos) - 1
    overlap_lines = max(0, min(overlap_lines, max_lines - 1))
    room_lines, room_chars = max(1, max_lines - overlap_lines), max(1, max_chars - (max_chars // 2 if overlap_lines else 0))

    def fits(lo: int, hi: int) -> bool:
        return hi - lo <= room_chars and line_at(max(lo, hi - 1)) - line_at(lo) < room_lines

    ends = boundaries(text, CODE_LEVELS, fits)
    out, start, done = [], 0, 0
    while done < len(text):
        k = bisect_right(ends, done)
        best = None
        while k < len(ends):
            e = ends[k]
            last = line_at(max(done, e - 1))
            stop = min(e, stops[last]) if stops[last] > start else e
            if stop - start > max_chars or last - line_at(start) >= max_lines:
                break
            best = (e, max(stop, start), last)
            k += 1
        if best is None:
            e = min(len(text), start + max_chars)
            best = (e, e, line_at(max(start, e - 1)))
        e, stop, last = best
        out.append((start, stop, line_at(start), last))
        done = e
        if done >= len(text):
            break
        nxt = line_at(done)
        start = done
        if starts[nxt] == done:
            e = ends[bisect_right(ends, done)]
            last = line_at(max(done, e - 1))
            stop = min(e, stops[last]) if stops[last] > done else e
            for n in range(1, overlap_lines + 1):
                if nxt - n < 0 or stop - starts[nxt - n] > max_chars or last - (nxt - n) >= max_lines:
                    break
                start = starts[nxt - n]
    return out


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            if r.chunk_kind == "code":
                cut = split_code(r.text, int(r.max_chars), int(r.max_lines), int(r.overlap_lines))
                base = None if pd.isna(r.first) else int(r.first)
                for i, (a, b, l0, l1) in enumerate(cut):
                    shared = 0 if i == 0 else max(0, cut[i - 1][3] - l0 + 1 if a < cut[i - 1][1] else 0)
                    rows.append((r.chunk_kind, r.chunk_id, i, len(cut), r.text[a:b], a, b, base if base is None else base + l0, base if base is None else base + l1, shared))
            else:
                cut = split_text(r.text, int(r.max_chars), int(r.overlap_chars), int(r.max_lines))
                base = None if pd.isna(r.first) else int(r.first)
                for i, (a, b) in enumerate(cut):
                    rows.append((r.chunk_kind, r.chunk_id, i, len(cut), r.text[a:b], base if base is None else base + a, base if base is None else base + b, None, None, 0 if i == 0 else cut[i - 1][1] - a))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECE_SCHEMA.split(", ")])
        for c in ("char_start", "char_end", "start_line", "end_line"):
            out[c] = out[c].astype("Int64")
        yield out


_UNBOUNDED = 2**31 - 1


def split_oversized(text_chunks: DataFrame, code_chunks: DataFrame, chunk_limits: DataFrame) -> DataFrame:
    """Pieces of every chunk over the limits of its kind (schema ``PIECE_SCHEMA``); other chunks give no rows.

    Over: more code points than ``max_chars``, or more lines (line breaks, CRLF being one, plus one) than
    ``max_lines``; a null limit doesn't apply. Positions: of text pieces ``char_start``/``char_end`` in the document
    (null where the chunk's start is null), of code pieces ``start_line``/``end_line`` in the file and
    ``char_start``/``char_end`` in the chunk. ``overlap`` is what a piece shares with the one before: characters of text,
    lines of code. A redelivered chunk is cut once (the least text, should they differ); null and empty texts are never
    over; of several limits of a kind the least holds, and limits of other kinds hold for nothing.

    The test runs in the JVM and only oversized chunks reach Python; a chunk is cut alone, so no shuffle is needed but
    the one that drops redelivered chunks, over oversized rows alone.
    """
    known = chunk_limits.where(F.col("chunk_kind").isin("text", "code"))
    limits = F.broadcast(  # one row for each of two kinds
        known.groupBy("chunk_kind").agg(*[F.min(c).alias(c) for c in ("max_chars", "max_lines", "overlap_chars", "overlap_lines")])
    )
    parts = []
    for kind, df, first in (("text", text_chunks, "char_start"), ("code", code_chunks, "start_line")):
        parts.append(
            df.select(F.lit(kind).alias("chunk_kind"), "chunk_id", "text", F.col(first).cast("long").alias("first"))
            .where(F.col("chunk_id").isNotNull() & F.col("text").isNotNull())
        )
    over = (
        parts[0].unionByName(parts[1])
        .join(limits, "chunk_kind")
        .where(
            (F.length("text") > F.col("max_chars"))
            | (F.regexp_count("text", F.lit(r"\r\n|\n|\r")) + 1 > F.col("max_lines"))
        )
        .select(
            "chunk_kind", "chunk_id", "text", "first",
            *[F.coalesce(c, F.lit(d)).alias(c) for c, d in (("max_chars", _UNBOUNDED), ("max_lines", _UNBOUNDED), ("overlap_chars", 0), ("overlap_lines", 0))],
        )
        .groupBy("chunk_kind", "chunk_id")
        .agg(F.min(F.struct("text", "first", "max_chars", "max_lines", "overlap_chars", "overlap_lines")).alias("r"))
        .select("chunk_kind", "chunk_id", "r.*")
    )
    return over.mapInPandas(_pieces, PIECE_SCHEMA)
