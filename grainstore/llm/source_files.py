"""Problem 4: generated, minified, vendored and data files among source files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainstore.llm.vectors import blocks, mix, powers
from grainstore.session import written


@dataclass(frozen=True)
class SourceFileConfig:
    """``head_lines``: lines of a file in which a header may stand. A line of ``long_line`` characters is a minified or
    blob line if it makes up most of the file. ``data_lines``: fewest lines of a table. A directory of ``shared_files``
    files or more found in ``shared_repos`` repositories is vendored, if it is at most ``shared_part`` of each."""

    head_lines: int = 15
    long_line: int = 400
    data_lines: int = 6
    shared_files: int = 2
    shared_repos: int = 2
    shared_part: float = 0.5


#: What headers of files made by a tool say.
GENERATED = (
    r"(?i)@generated\b|<auto-?generated|\bauto-?generated\s+(?:by|from)\b|\bcode\s+generated\s+(?:by|from)\b"
    r"|\bgenerated\s+(?:automatically\s+)?(?:by|from)\b[^\n]*(?:\d\.\d|do\s+not|don't|overwritten|lost)"
    r"|\bmachine[- ](?:made|generated|written)\s+(?:by|from)\b"
    r"|\b(?:edits|changes)\s+(?:are|will\s+be)\s+(?:lost|overwritten|discarded)"
    r"|이 파일은 [^\n]*자동(?:으로)? 생성|자동(?:으로)? 생성(?:했|됐|되었|한 파일|된 파일)[^\n]*|このファイルは[^\n]*自動生成|本文件由[^\n]*自动生成|automatisch\s+(?:erzeugt|generiert)\s+(?:von|aus)|generado\s+automáticamente\s+por"
)
#: What headers of third-party files say; a header that names the own team is none.
THIRD_PARTY = (
    r"(?i)\b(?:taken|copied|vendored|imported|adapted|borrowed)\b[^\n]{0,30}\bfrom\b[^\n]*\d+\.\d+|\breport bugs upstream\b"
    r"|\bcopyright\b[^\n]*\b(?:authors|contributors|foundation|inc|ltd|llc|gmbh|corp|corporation)\b"
    r"|\bspdx-license-identifier\b|\blicensed under the\b|\bnotice of the upstream\b|\breleased under a\b[^\n]*\blicen[cs]e\b"
    r"|^\W{0,8}(?:upstream|home ?page|project (?:site|page|home))\s*:\s*https?://"
)
OWN = r"(?i)\bour own\b|\bour team\b|\binternal use\b"
#: Directories that packages are copied into (fixed values); a package's own directory must follow.
VENDOR_DIRS = r"(?i)(?:^|/)(?:third[_-]?party|3rdparty|node_modules|bower_components|vendor|vendored|site-packages|dist-packages|libs|pods|carthage|external|externals)/[^/]+/"
GENERATED_DIRS = r"(?i)(?:^|/)(?:generated-sources|generated-src|__generated__|generated)/"
LOCK_NAMES = r"(?i)(?:^|/)(?:[\w.-]+[.-]lock(?:\.(?:json|ya?ml|toml))?|[\w.-]*lock\.(?:json|ya?ml)|go\.sum)$"
MINIFIED_NAMES = r"(?i)\.min\.(?:js|css|mjs)$"

_LITERAL = r"\"[^\"]*\"|'[^']*'|[-+]?\b(?:0x[0-9A-Fa-f]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)[LlfFdDuU]?\b"
_CONSTANT = r"^\s*(?:public\s+|static\s+|final\s+|const\s+|export\s+)*(?:int|long|final|val|var|let)?\s*\w+\s*=\s*0x[0-9a-fA-F]{6,8};?\s*$"
_LOCK_LINE = r"^\s*(?:[\"']?(?:integrity|resolved|checksum|version|sha(?:256|512)|dependencies|packages|lockVersion|lockfileVersion)[\"']?\s*:|[\"']?[@\w./-]+@[\w.^~*-]+[\"']?\s*:)"


#: Substrings, in lower case, without which no header pattern can match.
_MADE_MARKS = ("generat", "machine", "edits", "changes", "생성", "生成", "erzeugt")
_FOREIGN_MARKS = ("copyright", "upstream", "licen", "taken", "copied", "vendored", "imported", "adapted", "borrowed", "home", "project")


def _classes() -> np.ndarray:
    """For each byte: 1 mark, 2 blank, 4 digit or quote, 8 line break."""
    out = np.zeros(256, np.uint8)
    out[list(b";{}()[],=&|!<>+*")] |= 1
    out[list(b" \t\n")] |= 2
    out[list(b"0123456789\"'")] |= 4
    return out


def _line_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A 63-bit hash of each line data[begin:end] and its number; an empty line hashes its number alone."""
    length = end - begin
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    weighed = np.append((data[np.repeat(begin, length) + place].astype(np.uint64) + np.uint64(1)) * powers(1 << int(max(64, length.max(initial=1))).bit_length())[place], np.uint64(0))
    sums = np.add.reduceat(weighed, np.cumsum(length) - length) if len(length) else np.zeros(0, np.uint64)
    sums[length == 0] = 0
    return (mix(mix(sums + length.astype(np.uint64)) ^ number.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)


_FEATURES = (
    "repo_id string, path string, start long, chars long, long_chars long, blob long, marks long, blanks long, made boolean, foreign boolean, "
    "n_full long, letters long, n_templates long, n_literal long, n_constant long, n_lock long, hashes array<long>"
)
_NAMES = [c.split()[0] for c in _FEATURES.split(", ")]


def _features(config: SourceFileConfig):
    made, foreign, own = re.compile(GENERATED), re.compile(THIRD_PARTY, re.M), re.compile(OWN)
    literal, constant, lock = re.compile(_LITERAL), re.compile(_CONSTANT), re.compile(_LOCK_LINE)
    blob, rest = re.compile(r"[A-Za-z0-9+/=]{200,}"), re.compile(r"[#\s,;\[\](){}:.-]")
    kinds = _classes()

    def layout(lines: list[str]) -> tuple[int, int, int]:
        templates = [literal.sub("#", x) for x in lines]
        return sum(len(rest.sub("", x)) for x in templates), len(set(templates)), sum("#" in x for x in templates)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t.replace("\r\n", "\n").replace("\r", "\n") if "\r" in t else t for t in pdf["text"]]
            repo, path, starts = pdf["repo_id"].tolist(), pdf["path"].tolist(), pdf["start"].to_numpy(np.int64)
            for lo, hi in blocks(texts, 1 << 21):
                coded = [(t + "\n").encode("utf-8", "surrogatepass") for t in texts[lo:hi]]
                data = np.frombuffer(b"".join(coded), np.uint8)
                sizes = np.array([len(x) for x in coded])
                at = np.cumsum(sizes) - sizes
                stop = np.flatnonzero(data == 10)
                begin = np.concatenate([[0], stop[:-1] + 1])
                chunk = np.searchsorted(at, begin, side="right") - 1
                first = np.searchsorted(begin, at)
                length = stop - begin
                kind = kinds[data]
                full = np.add.reduceat((length > 0).astype(np.int64), first)
                marks, blanks, figures = (np.add.reduceat(((kind & k) > 0).astype(np.int64), at) for k in (1, 2, 4))
                long_chars = np.add.reduceat(np.where(length >= config.long_line, length, 0), first)
                # blanks at a line's end don't count
                black = np.maximum.accumulate(np.where((kind & 2) == 0, np.arange(len(data)), -1))
                hashes = _line_hashes(data, begin, np.maximum(begin, black[stop] + 1), np.arange(len(begin)) - first[chunk] + starts[lo:hi][chunk])
                parts = np.split(hashes, first[1:])
                rows = []
                for i in range(hi - lo):
                    text, start = texts[lo + i], int(starts[lo + i])
                    is_made = is_foreign = False
                    if start <= config.head_lines:
                        head = "\n".join(text.split("\n", config.head_lines)[: config.head_lines + 1 - start])
                        low = head.lower()
                        is_made = any(x in low for x in _MADE_MARKS) and made.search(head) is not None
                        is_foreign = any(x in low for x in _FOREIGN_MARKS) and foreign.search(head) is not None and own.search(head) is None
                    longest = max(map(len, blob.findall(text)), default=0) if long_chars[i] else 0
                    letters, templates, literals, constants, locks = int(sizes[i]), int(full[i]), 0, 0, 0
                    lines = None
                    if figures[i] >= 0.08 * sizes[i] and long_chars[i] < 0.5 * sizes[i]:
                        lines = [x for x in text.split("\n") if x.strip()]
                        letters, templates, literals = layout(lines)
                    if "= 0x" in text:
                        constants = sum(constant.match(x) is not None for x in text.split("\n"))
                    if "integrity" in text or "resolved" in text or "checksum" in text:
                        locks = sum(lock.match(x) is not None for x in text.split("\n"))
                    rows.append((repo[lo + i], path[lo + i], start, int(sizes[i]), int(long_chars[i]), longest, int(marks[i]), int(blanks[i]), is_made, is_foreign,
                                 int(full[i]), letters, templates, literals, constants, locks, parts[i]))
                yield pd.DataFrame(rows, columns=_NAMES)

    return run


def chunk_features(code_chunks: DataFrame, config: SourceFileConfig) -> DataFrame:
    """One row per chunk with what it tells of its file, over the whole text (schema ``_FEATURES``).

    Additive features count a chunk's lines whole; lines that neighbours share count twice, which leaves ratios alone.
    Bytes are counted and lines hashed for a block of texts at once; patterns are tried only where a substring or a
    count says that they may match.
    """
    rows = code_chunks.where(F.col("repo_id").isNotNull() & F.col("path").isNotNull() & F.col("text").isNotNull())
    start = F.coalesce(F.col("start_line"), F.lit(1)).cast("long")
    return rows.select("repo_id", "path", start.alias("start"), "text").mapInPandas(_features(config), _FEATURES)


def files(code_chunks: DataFrame, config: SourceFileConfig = SourceFileConfig()) -> DataFrame:
    """One row per (repo_id, path): features, rules and the hash of the whole text.

    Chunks of a file overlap; each gives the hashes of its lines up to the start of the next, so the sum is one over the
    distinct lines. Redelivered chunks start where the first delivery does and so give no line of their own.
    """
    w = Window.partitionBy("repo_id", "path").orderBy("start")
    own = F.col("hashes")
    nxt = F.lead("start").over(w)
    own = F.when(F.col("next").isNull(), own).otherwise(F.slice(own, F.lit(1), F.greatest(F.lit(0), F.least(F.size(own), F.col("next") - F.col("start")))))
    # a sum modulo a prime below 2^31 of 31-bit parts can't overflow: two of them make the hash
    part = lambda shift: F.aggregate(own, F.lit(0).cast("long"), lambda a, x: (a + F.pmod(F.shiftright(x, shift), F.lit(2147483647))) % 2147483647)
    sums = ("chars", "long_chars", "marks", "blanks", "n_full", "letters", "n_templates", "n_literal", "n_constant", "n_lock")
    return (
        chunk_features(code_chunks, config)
        .withColumn("next", nxt)
        .withColumns({"h1": part(0), "h2": part(31), "n_own": F.size(own)})
        .groupBy("repo_id", "path")
        .agg(
            *[F.sum(c).alias(c) for c in sums],
            *[F.max(c).alias(c) for c in ("blob", "made", "foreign")],
            F.xxhash64(F.sum("h1") % 2147483647, F.sum("h2") % 2147483647, F.sum("n_own")).alias("hash"),
        )
    )


def _rules(config: SourceFileConfig) -> Column:
    """The kind of a file by directory, header and layout; null for hand-written source."""
    where = F.translate("path", "\\", "/")
    share = lambda part, whole: F.col(part) / F.greatest(F.col(whole), F.lit(1))
    long_line = share("long_chars", "chars") >= 0.6
    blob = (F.col("blob") >= config.long_line) & (share("blob", "chars") >= 0.6)
    table = (
        (F.col("n_full") >= config.data_lines)
        & (share("n_literal", "n_full") >= 0.8)
        & ((share("n_templates", "n_full") <= 0.25) | (share("letters", "chars") <= 0.08))
        & (share("letters", "chars") <= 0.5)
    )
    return (
        F.when(F.col("made") | where.rlike(GENERATED_DIRS), "generated")
        .when((share("n_lock", "n_full") >= 0.7) | (where.rlike(LOCK_NAMES) & (share("n_lock", "n_full") >= 0.3)), "generated")
        .when((F.col("n_constant") >= config.data_lines) & (share("n_constant", "n_full") >= 0.6), "generated")
        .when(F.col("foreign") | where.rlike(VENDOR_DIRS), "vendored")
        .when(blob, "data")
        .when(long_line & (share("marks", "chars") >= 0.1) & (share("blanks", "chars") <= 0.12), "minified")
        .when(where.rlike(MINIFIED_NAMES) & (F.col("long_chars") > 0), "minified")
        .when(table, "data")
    )


def merkle_trees(hashed: DataFrame) -> DataFrame:
    """(repo_id, dir, hash, n): every directory below a repository's root with the Merkle hash of its subtree and its
    number of files; ``hashed`` holds (repo_id, path, hash).

    Bottom-up, one aggregate per depth: a directory's hash is made of its children's names and hashes. Sums stand for
    sorted lists, so a directory of any size is never gathered.
    """
    nodes = hashed.select("repo_id", F.translate("path", "\\", "/").alias("node"), "hash", F.lit(1).cast("long").alias("n"))
    nodes = nodes.withColumn("depth", F.length("node") - F.length(F.replace("node", F.lit("/"))))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    up, out = None, None
    for depth in range(deepest, 0, -1):
        level = nodes.where(F.col("depth") == depth).select("repo_id", "node", "hash", "n")
        if up is not None:
            level = level.unionByName(up)
        name = F.substring_index("node", "/", -1)
        own = F.xxhash64(name, "hash")
        up = level.groupBy("repo_id", F.expr("substring(node, 1, length(node) - length(substring_index(node, '/', -1)) - 1)").alias("dir")).agg(
            F.xxhash64(F.sum(F.pmod(own, F.lit(2**40)).cast("decimal(38,0)")), F.bit_xor(own), F.count("*")).alias("hash"), F.sum("n").alias("n")
        )
        out = up if out is None else out.unionByName(up)
        up = up.select("repo_id", F.col("dir").alias("node"), "hash", "n")
    if out is None:
        return hashed.sparkSession.createDataFrame([], "repo_id string, dir string, hash long, n long")
    return out


def shared_directories(trees: DataFrame, hashed: DataFrame, config: SourceFileConfig) -> DataFrame:
    """(repo_id, dir): directories whose subtree is in several unrelated repositories.

    A subtree that is more than ``shared_part`` of a repository marks a fork, not a copy of a package: repositories
    that share so much are related, and the directory doesn't count there.
    """
    sizes = hashed.groupBy("repo_id").agg(F.count("*").alias("total"))
    small = trees.where(F.col("n") >= config.shared_files).join(sizes, "repo_id").where(F.col("n") <= config.shared_part * F.col("total"))
    hashes = small.groupBy("hash").agg(F.countDistinct("repo_id").alias("repos")).where(F.col("repos") >= config.shared_repos).select("hash")
    return small.join(hashes, "hash", "left_semi").select("repo_id", "dir").distinct()


def not_hand_written(code_chunks: DataFrame, config: SourceFileConfig = SourceFileConfig()) -> DataFrame:
    """(repo_id, path, kind): files made by a tool, minified, copied from a third party, or data; the rest is hand-written.

    Kinds: ``generated`` (header, lock file, constant table), ``vendored`` (directory of packages, third-party header, a
    subtree shared with unrelated repositories, or the same content as a file that is vendored elsewhere), ``minified``,
    ``data``. Null ids, paths and texts give nothing; a redelivered chunk counts once; null lines start at 1. Paths
    come as stored. Chunks send a few numbers and one hash per line over the shuffle, never their text, and no
    repository or file is gathered.
    """
    found = written(files(code_chunks, config).withColumn("kind", _rules(config)).select("repo_id", "path", "hash", "n_full", "kind"), "files")
    hashed = found.select("repo_id", "path", "hash")
    shared = shared_directories(merkle_trees(hashed), hashed, config)
    parents = hashed.select("repo_id", "path", F.split(F.translate("path", "\\", "/"), "/").alias("parts"))
    ancestors = parents.select(
        "repo_id", "path", F.explode(F.expr("transform(sequence(1, greatest(1, size(parts) - 1)), i -> array_join(slice(parts, 1, i), '/'))")).alias("dir")
    )
    by_tree = ancestors.join(shared, ["repo_id", "dir"], "left_semi").select("repo_id", "path").distinct()
    known = found.where("kind = 'vendored' and n_full > 3").select("hash").distinct()
    by_content = found.where("kind is null and n_full > 3").join(known, "hash", "left_semi").select("repo_id", "path")
    copies = found.where("kind is null").select("repo_id", "path").join(by_tree, ["repo_id", "path"], "left_semi").unionByName(by_content).distinct()
    return found.where("kind is not null").select("repo_id", "path", "kind").unionByName(copies.select("repo_id", "path", F.lit("vendored").alias("kind")))
