"""Hybrid retrieval: keyword lines, path hits and vector hits of a set of questions, merged, reranked and cut to a context.

Every operator takes ``question_id`` as one more key, so one plan answers any number of questions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainstore.functions import fixed, text as T


@dataclass(frozen=True)
class SearchConfig:
    """``top_k`` hits asked for (1 to 30); ``block``: questions searched in one pass over the texts, so what goes to the
    workers is bounded; ``repo_scoped``: paths of different repositories are different when hits are merged."""

    top_k: int = 10
    block: int = 5000
    dimensions: int = 64
    rerank_limit: int = fixed.RERANK_LIMIT
    context_chars: int = fixed.CONTEXT_CHARS
    repo_scoped: bool = False


HIT_COLUMNS = (
    "question_id", "block", "ord", "source", "kind", "repo_id", "path", "line", "text", "matched_keywords", "chunk_id",
    "filename", "page", "start_line", "end_line", "distance", "marks",
)
_TYPES = {
    "question_id": "long", "block": "int", "ord": "struct<a:string,b:string,c:long,d:double>", "source": "string", "kind": "string",
    "repo_id": "string", "path": "string", "line": "int", "text": "string", "matched_keywords": "array<string>", "chunk_id": "string",
    "filename": "string", "page": "int", "start_line": "int", "end_line": "int", "distance": "double",
    "marks": "struct<symbols:int,phrases:int,overlap:int,is_path:boolean>",
}


def understood(questions: DataFrame) -> DataFrame:
    """(question_id, question) with ``kind`` (general or structure), ``keywords`` and ``hints``."""
    out = questions.select("question_id", "question", T.question_type(F.col("question")).alias("qtype"), T.keywords(F.col("question")).alias("keywords"))
    return out.withColumn("hints", T.symbol_hints(F.col("keywords")))


def hits(df: DataFrame) -> DataFrame:
    """The one wide schema of hits; columns that a kind of hit lacks are null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(_TYPES[c]).alias(c) for c in HIT_COLUMNS])


def is_code_path(path: Column) -> Column:
    return F.lower(F.concat(F.lit("."), F.substring_index(F.substring_index(F.translate(path, "\\", "/"), "/", -1), ".", -1))).isin(*fixed.CODE_SUFFIXES)


# ---------------------------------------------------------------- keyword lines


def _line_matches(words: list[str]):
    """Lines with at least one of the words, found in one pass over each text by an automaton of all words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for w in words:
            machine.add_word(w, w)
        machine.make_automaton()
        for pdf in batches:
            rows = []
            for repo, path, start, text in zip(pdf["repo_id"], pdf["path"], pdf["start_line"], pdf["text"], strict=True):
                for n, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
                    found = {w for _, w in machine.iter(line.lower())}
                    if found:
                        rows.append((repo, path, int(start) + n, line.strip(), sorted(found)))
            yield pd.DataFrame(rows, columns=["repo_id", "path", "line", "text", "words"])

    return run


def _source_chunks(code_chunks: DataFrame) -> DataFrame:
    return code_chunks.where(F.col("text").isNotNull() & F.col("path").isNotNull() & is_code_path(F.col("path"))).select(
        "repo_id", F.translate("path", "\\", "/").alias("path"), F.coalesce("start_line", F.lit(1)).alias("start_line"), "text"
    )


def _blocks(asked: DataFrame, config: SearchConfig) -> list[DataFrame]:
    """The questions in parts of about ``block``."""
    n = max(1, -(-asked.count() // config.block))
    return [asked.where(F.pmod(F.xxhash64("question_id"), F.lit(n)) == b) for b in range(n)]


def _words_of(asked: DataFrame) -> DataFrame:
    return asked.select("question_id", F.posexplode("keywords").alias("i", "keyword")).where(F.length("keyword") > 0).withColumn("word", F.lower("keyword"))


def _within(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys, of which the repository may be null, are among a few that go to every worker."""
    few = few.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    on = [rows[k].eqNullSafe(few[f"_{k}"]) if k == "repo_id" else rows[k] == few[f"_{k}"] for k in keys]
    return rows.join(F.broadcast(few), on, "left_semi")


def keyword_lines(code_chunks: DataFrame, asked: DataFrame, config: SearchConfig = SearchConfig(), only: DataFrame | None = None) -> DataFrame:
    """(question_id, repo_id, path, line, text, matched_keywords): lines of source files that contain a keyword.

    Without regard to case; lines count in the file, those that neighbouring chunks share come once. A null start is
    line 1. The keywords of ``block`` questions at a time go to the workers; texts are read once per block. With ``only``
    (question_id, repo_id, path, line), a stated set, no other lines come out.
    """
    chunks = _source_chunks(code_chunks)
    if only is not None:
        chunks = _within(chunks, only, ["repo_id", "path"])
    out = None
    for few in _blocks(asked, config):
        part = _words_of(few)
        words = [r.word for r in part.select("word").distinct().collect()]
        found = chunks.mapInPandas(_line_matches(words), "repo_id string, path string, line int, text string, words array<string>") if words else None
        if found is None:
            continue
        if only is not None:
            found = _within(found, only, ["repo_id", "path", "line"])
        matched = found.select("repo_id", "path", "line", "text", F.explode("words").alias("word")).distinct().join(part, "word")
        if only is not None:
            matched = _within(matched, only, ["question_id", "repo_id", "path", "line"])
        rows = (
            matched.groupBy("question_id", "repo_id", "path", "line")
            .agg(F.min("text").alias("text"), F.array_sort(F.collect_set(F.struct("i", "keyword"))).alias("m"))
            .select("question_id", "repo_id", "path", "line", "text", F.transform("m", lambda x: x["keyword"]).alias("matched_keywords"))
        )
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return asked.sparkSession.createDataFrame([], "question_id long, repo_id string, path string, line int, text string, matched_keywords array<string>")
    return out


def _line_words(words: list[str]):
    """For each chunk, the pairs of line and number of a word in it; one row per chunk, without the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for i, w in enumerate(words):
            machine.add_word(w, i)
        machine.make_automaton()
        for pdf in batches:
            rows = []
            for repo, path, start, text in zip(pdf["repo_id"], pdf["path"], pdf["start_line"], pdf["text"], strict=True):
                at, word = [], []
                for n, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n"), int(start)):
                    found = {i for _, i in machine.iter(line.lower())}
                    at += [n] * len(found)
                    word += found
                if at:
                    rows.append((repo, path, at, word))
            yield pd.DataFrame(rows, columns=["repo_id", "path", "at", "word"])

    return run


def _count_lines(askers: list[np.ndarray], ids: np.ndarray):
    """Counts of each file for each question; ``askers`` has for each word the numbers of the questions that have it,
    once for each keyword. A file's lines are taken 2,000 at a time."""

    def run(batches):
        import pyarrow as pa

        kinds = [("question_id", pa.int64()), ("lines", pa.int64()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("matches", pa.int64())]
        for batch in batches:
            offsets, parts = [0], []
            at_all, word_all = batch.column("at"), batch.column("word")
            for at, word in zip(at_all, word_all, strict=True):
                pairs = np.unique(at.values.to_numpy().astype(np.int64) << 32 | word.values.to_numpy())
                lines, words = pairs >> 32, pairs & 0xFFFFFFFF
                own, words = np.unique(words, return_inverse=True)
                lists = [askers[w] for w in own]
                asking, q = np.unique(np.concatenate(lists), return_inverse=True)
                has = np.zeros((len(own), len(asking)), np.float32)
                np.add.at(has, (np.repeat(np.arange(len(own)), [len(x) for x in lists]), q), 1)
                places, row = np.unique(lines, return_inverse=True)
                total = np.zeros((3, len(asking)), np.int64)
                ends = np.zeros((2, len(asking)), np.int64)
                for lo in range(0, len(places), 2000):
                    a, b = np.searchsorted(row, [lo, lo + 2000])
                    n = min(2000, len(places) - lo)
                    seen = np.zeros((n, len(own)), np.float32)
                    seen[row[a:b] - lo, words[a:b]] = 1
                    found = seen @ has
                    hit = found > 0
                    any_ = hit.any(axis=0)
                    ends[0] = np.where(any_ & (total[0] == 0), places[lo + hit.argmax(axis=0)], ends[0])
                    ends[1] = np.where(any_, places[lo + n - 1 - hit[::-1].argmax(axis=0)], ends[1])
                    total[0] += hit.sum(axis=0)
                    total[1] += found.sum(axis=0).astype(np.int64)
                parts.append((ids[asking], total[0], ends[0], ends[1], total[1]))
                offsets.append(offsets[-1] + len(asking))
            columns = [pa.array(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64)).cast(kind) for i, (_, kind) in enumerate(kinds)]
            counts = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, [n for n, _ in kinds]))
            yield pa.RecordBatch.from_arrays([batch.column("repo_id"), batch.column("path"), counts], ["repo_id", "path", "counts"])

    return run


def keyword_line_counts(code_chunks: DataFrame, asked: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """(question_id, repo_id, path, lines, first_line, last_line, matches): what ``keyword_lines`` finds in each file.

    Only numbers of lines and words are shuffled, once, to their files; questions come in where nothing is shuffled any more.
    """
    chunks, out = _source_chunks(code_chunks), None
    for few in _blocks(asked, config):
        keywords = _words_of(few).select("question_id", "word").collect()
        if not keywords:
            continue
        ids = np.array(sorted({r.question_id for r in keywords}), np.int64)
        numbers = {w: i for i, w in enumerate(sorted({r.word for r in keywords}))}
        lists: list[list[int]] = [[] for _ in numbers]
        for r in keywords:
            lists[numbers[r.word]].append(int(np.searchsorted(ids, r.question_id)))
        found = chunks.mapInPandas(_line_words(list(numbers)), "repo_id string, path string, at array<int>, word array<int>")
        files = found.groupBy("repo_id", "path").agg(F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_list("word")).alias("word"))
        counted = files.mapInArrow(
            _count_lines([np.array(x, np.int64) for x in lists], ids),
            "repo_id string, path string, counts array<struct<question_id:long,lines:long,first_line:int,last_line:int,matches:long>>",
        )
        rows = counted.select("repo_id", "path", F.explode("counts").alias("c")).select("c.question_id", "repo_id", "path", "c.lines", "c.first_line", "c.last_line", "c.matches")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return asked.sparkSession.createDataFrame([], "question_id long, repo_id string, path string, lines long, first_line int, last_line int, matches long")
    return out


# ---------------------------------------------------------------- paths


def path_index(files: DataFrame) -> DataFrame:
    """(repo_id, path, tokens) of the source files, each once."""
    paths = files.where(F.col("path").isNotNull() & is_code_path(F.col("path"))).select("repo_id", F.translate("path", "\\", "/").alias("path")).distinct()
    return paths.withColumn("tokens", T.search_tokens(F.col("path")))


def path_hits(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(question_id, repo_id, path, matched_keywords): paths that a keyword matches.

    Candidates of a repository are the paths that share a token with a keyword; only where it has none are all its paths
    candidates, so a match by substring alone counts there and nowhere else. A keyword without tokens is in each candidate.
    """
    tokens = index.select("repo_id", "path", F.explode("tokens").alias("token"))
    asked_tokens = asked.select("question_id", F.explode(F.flatten(F.transform("keywords", T.search_tokens))).alias("token")).distinct()
    near = tokens.join(asked_tokens, "token").select("question_id", "repo_id", "path").distinct()
    served = near.select("question_id", "repo_id").distinct()
    # every question is asked of every repository that it finds no token in: few questions against the list of repositories
    every = index.select("repo_id").distinct().join(F.broadcast(asked.select("question_id")))
    rest = every.join(served, ["question_id", "repo_id"], "left_anti").join(index.select("repo_id", "path"), "repo_id")
    candidates = near.unionByName(rest.select("question_id", "repo_id", "path"))
    # tokens of keywords are made once per question, below the join, not once per path
    ready = F.transform(F.filter("keywords", lambda k: F.length(k) > 0), lambda k: F.struct(k.alias("word"), F.lower(k).alias("low"), T.search_tokens(k).alias("tokens")))
    joined = candidates.join(index.withColumn("low_path", F.lower("path")), ["repo_id", "path"]).join(asked.select("question_id", ready.alias("ready")), "question_id")
    matched = F.filter("ready", lambda k: F.col("low_path").contains(k["low"]) | (F.size(F.array_except(k["tokens"], F.col("tokens"))) == 0))
    return joined.select("question_id", "repo_id", "path", F.transform(matched, lambda k: k["word"]).alias("matched_keywords")).where(F.size("matched_keywords") > 0)


def keyword_hits(lines: DataFrame, paths: DataFrame, repos: int) -> DataFrame:
    """Path hits, then lines, of each repository up to its limit, and of all repositories up to 200 per question."""
    return _limited(_as_hits(paths).unionByName(hits(lines.withColumns({"source": F.lit("keyword"), "block": F.lit(1)}))), repos)


def _as_hits(paths: DataFrame) -> DataFrame:
    return hits(paths.select("*", F.lit("path").alias("source"), F.lit(0).alias("line"), F.col("path").alias("text"), F.lit(0).alias("block")))


def _limited(both: DataFrame, repos: int) -> DataFrame:
    per_repo = _per_repo(repos)
    within = Window.partitionBy("question_id", "repo_id").orderBy("block", "path", "line")
    over_all = Window.partitionBy("question_id").orderBy("repo_id", "block", "path", "line")
    return (
        both.withColumn("n", F.row_number().over(within)).where(F.col("n") <= per_repo)
        .withColumn("n", F.row_number().over(over_all)).where(F.col("n") <= fixed.KEYWORD_HITS)
        .withColumn("ord", F.struct(F.col("repo_id").alias("a"), F.col("path").alias("b"), F.col("line").cast("long").alias("c"), F.lit(0.0).alias("d")))
        .drop("n")
    )


def _per_repo(repos: int) -> int:
    return max(fixed.KEYWORD_HITS_PER_REPO, fixed.KEYWORD_HITS // max(1, repos))


class _First:
    """The hits of each question that may be among its first ``total``, with at most ``per_repo`` of each repository.

    A hit goes only when as many before it are kept as the limits leave room for. More hits never make one come in that
    these keep out, so what each task leaves out here is not in the answer. ``edge``: for questions where it is known,
    the repository after which they take no hits.
    """

    def __init__(self, questions: int, per_repo: int, total: int, edge: dict | None = None):
        self.questions, self.per_repo, self.total = questions, per_repo, total
        self.kept: dict = {}
        self.last: dict = {}
        self.edge: dict = dict(edge or {})
        self.fresh: dict = {}
        self.limit = max(self.edge.values()) if questions and len(self.edge) == questions else None

    def beyond(self, repo: tuple) -> bool:
        """Whether no question takes hits of this repository any more."""
        return self.limit is not None and repo > self.limit

    def add(self, question: int, repo: tuple, key, value=None) -> None:
        edge = self.edge.get(question)
        if edge is not None and repo > edge:
            return
        last = self.last.get((question, repo))
        if last is not None and key > last:
            return
        rows = self.kept.setdefault(question, {}).setdefault(repo, {})
        if key in rows:
            return
        rows[key] = value
        if len(rows) >= 2 * self.per_repo:
            best = sorted(rows)[: self.per_repo]
            self.last[question, repo] = best[-1]
            self.kept[question][repo] = {k: rows[k] for k in best}
        n = self.fresh[question] = self.fresh.get(question, 0) + 1
        if n >= self.total:
            self._settle(question)

    def _settle(self, question: int) -> None:
        """Drop the repositories after the one that fills the total."""
        self.fresh[question] = 0
        rows, room = self.kept[question], self.total
        for repo in sorted(rows):
            if room <= 0:
                del rows[repo]
            else:
                room -= min(self.per_repo, len(rows[repo]))
                edge = repo
        if room <= 0 and self.edge.get(question) != edge:
            self.edge[question] = edge
            if len(self.edge) == self.questions:
                self.limit = max(self.edge.values())

    def rows(self) -> Iterator[tuple]:
        for question, repos in self.kept.items():
            self._settle(question)
            for repo, rows in repos.items():
                for key in sorted(rows)[: self.per_repo]:
                    yield question, repo[1] if repo[0] else None, key, rows[key]


def _ordered(repo: str | None) -> tuple:
    """As repositories are ordered: null first."""
    return (repo is not None, repo or "")


def _first_lines(askers: dict[str, list[int]], questions: int, per_repo: int, edge: dict):
    """One row for each question and file, with the numbers of the lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for w in askers:
            machine.add_word(w, w)
        machine.make_automaton()
        first = _First(questions, per_repo, fixed.KEYWORD_HITS, edge)
        for pdf in batches:
            for repo, path, start, text in zip(pdf["repo_id"], pdf["path"], pdf["start_line"], pdf["text"], strict=True):
                place = _ordered(repo)
                if first.beyond(place):
                    continue
                for n, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n"), int(start)):
                    found = {w for _, w in machine.iter(line.lower())}
                    if found:
                        for q in set().union(*[askers[w] for w in found]):
                            first.add(q, place, (path, n))
        files = groupby(first.rows(), lambda r: (r[0], r[1], r[2][0]))  # hits of a file come one after the other
        yield pd.DataFrame([(*file, [key[1] for _, _, key, _ in rows]) for file, rows in files], columns=["question_id", "repo_id", "path", "lines"])

    return run


def _served(askers: dict[str, list[int]]):
    """Pairs of question and repository that share a token."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, set] = {}
        for pdf in batches:
            for repo, tokens in zip(pdf["repo_id"], pdf["tokens"], strict=True):
                mine = seen.setdefault(repo, set())
                for t in tokens:
                    if t in askers:
                        mine.update(askers[t])
        yield pd.DataFrame([(q, repo) for repo, qs in seen.items() for q in qs], columns=["question_id", "repo_id"])

    return run


def _first_paths(asked: list, askers: dict[str, list[int]], per_repo: int):
    """``asked``: (question_id, [(keyword, in lower case, tokens)]); as in ``path_hits``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine, has_low, by_token, bare = ahocorasick.Automaton(), {}, {}, {}
        words = {}
        for q, ready in asked:
            words[q] = [k for k, _, _ in ready]
            for i, (_, low, tokens) in enumerate(ready):
                has_low.setdefault(low, []).append((q, i))
                if tokens:
                    by_token.setdefault(tokens[0], []).append((set(tokens), q, i))
                else:
                    bare.setdefault(q, set()).add(i)
        for low in has_low:
            machine.add_word(low, low)
        machine.make_automaton()
        first = _First(len(words), per_repo, fixed.KEYWORD_HITS)
        for pdf in batches:
            for repo, path, low_path, tokens, rest in zip(pdf["repo_id"], pdf["path"], pdf["low_path"], pdf["tokens"], pdf["rest"], strict=True):
                place = _ordered(repo)
                if first.beyond(place):
                    continue
                tokens = set(tokens)
                candidates = set().union(*[askers[t] for t in tokens if t in askers], () if rest is None else rest.tolist())
                matched: dict[int, set] = {}
                for low in {w for _, w in machine.iter(low_path)} if has_low else ():
                    for q, i in has_low[low]:
                        if q in candidates:
                            matched.setdefault(q, set()).add(i)
                for t in tokens:
                    for needed, q, i in by_token.get(t, ()):
                        if needed <= tokens:
                            matched.setdefault(q, set()).add(i)
                for q in bare.keys() & candidates:
                    matched.setdefault(q, set()).update(bare[q])
                for q, found in matched.items():
                    first.add(q, place, path, found)
        rows = [(q, repo, path, [words[q][i] for i in sorted(found)]) for q, repo, path, found in first.rows()]
        yield pd.DataFrame(rows, columns=["question_id", "repo_id", "path", "matched_keywords"])

    return run


def _line_marks(code_chunks: DataFrame, asked: DataFrame, only: DataFrame) -> DataFrame:
    """(question_id, repo_id, path, line, matched_keywords, marks) of stated lines that are hits. Each of these lines is
    shuffled once with its text, not once for each question that it is a hit of."""
    keys = ["repo_id", "path", "line"]
    words = [r.word for r in _words_of(asked).select("word").distinct().collect()]
    chunks = _within(_source_chunks(code_chunks), only, ["repo_id", "path"])
    found = _within(chunks.mapInPandas(_line_matches(words), "repo_id string, path string, line int, text string, words array<string>"), only, keys)
    lines = found.groupBy(*keys).agg(F.min("text").alias("text"), F.array_distinct(F.flatten(F.collect_set("words"))).alias("words"))
    few = only.select("question_id", *[F.col(k).alias(f"_{k}") for k in keys])
    rows = lines.join(F.broadcast(few), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).join(F.broadcast(asked.select("question_id", "question", "keywords", "hints")), "question_id")
    return rows.select(
        "question_id", *keys, F.filter("keywords", lambda k: (F.length(k) > 0) & F.array_contains(F.col("words"), F.lower(k))).alias("matched_keywords"),
        T.text_marks(F.lit("keyword"), F.col("text"), F.col("path"), F.col("question"), F.col("keywords"), F.col("hints")).alias("marks"))


def lexical_hits(code_chunks: DataFrame, index: DataFrame, asked: DataFrame, config: SearchConfig = SearchConfig(), texts: bool = True, marks: bool = False) -> DataFrame:
    """``keyword_hits`` of ``keyword_lines`` and ``path_hits`` without writing down all of them.

    Each task keeps of its hits those that the limits may still take, at most a few hundred per question, which then
    compete; the texts of the lines that remain are looked up in a second reading. All chunks and paths are read whole.
    With ``marks``, lines have what their scores take from the texts instead of these. Without both there is no second
    reading, and ``text`` and ``matched_keywords`` of lines are null.
    """
    from grainstore.session import written

    chunks, repos, out = _source_chunks(code_chunks), index.select("repo_id").distinct().count(), None
    for few in _blocks(asked, config):
        tokens_of = F.transform(F.filter("keywords", lambda k: F.length(k) > 0), lambda k: F.struct(k.alias("word"), F.lower(k).alias("low"), T.search_tokens(k).alias("tokens")))
        asking = [(r.question_id, [(k.word, k.low, list(k.tokens)) for k in r.ready]) for r in few.select("question_id", tokens_of.alias("ready")).collect() if r.ready]
        by_word: dict[str, list[int]] = {}
        by_token: dict[str, list[int]] = {}
        for q, ready in asking:
            for low in {low for _, low, _ in ready}:
                by_word.setdefault(low, []).append(q)
            for t in {t for _, _, tokens in ready for t in tokens}:
                by_token.setdefault(t, []).append(q)
        if not asking:
            continue
        known = index.where(F.col("repo_id").isNotNull())
        served = known.mapInPandas(_served(by_token), "question_id long, repo_id string").distinct()
        # every question is asked of every repository that it finds no token in: few questions against the list of repositories
        rest = known.select("repo_id").distinct().join(F.broadcast(few.select("question_id"))).join(served, ["question_id", "repo_id"], "left_anti")
        rest = rest.groupBy("repo_id").agg(F.collect_list("question_id").alias("rest"))
        paths = known.join(rest, "repo_id", "left").select("repo_id", "path", F.lower("path").alias("low_path"), "tokens", "rest").mapInPandas(
            _first_paths(asking, by_token, _per_repo(repos)), "question_id long, repo_id string, path string, matched_keywords array<string>"
        ).repartition("question_id")
        # paths come before the lines of their repository: where they fill the total, no later repository has a line in the answer
        paths = written(_limited(_as_hits(paths), repos), "pathhits").select("question_id", "repo_id", "path", "matched_keywords")
        full = paths.groupBy("question_id").agg(F.count("*").alias("n"), F.max("repo_id").alias("repo_id")).where(F.col("n") >= fixed.KEYWORD_HITS)
        edge = {r.question_id: _ordered(r.repo_id) for r in full.collect()}  # one row a question
        # what the tasks keep grows with their number, so it is shuffled once, by question, and lines come to rows only behind that
        packed = chunks.mapInPandas(_first_lines(by_word, len(asking), _per_repo(repos), edge), "question_id long, repo_id string, path string, lines array<int>")
        lines = packed.repartition("question_id").select("question_id", "repo_id", "path", F.explode("lines").alias("line")).distinct()
        best = written(keyword_hits(lines, paths.repartition("question_id"), repos), "hits")
        if not texts and not marks:
            out = best if out is None else out.unionByName(best)
            continue
        keys = ["question_id", "repo_id", "path", "line"]
        only, parts = best.where("source = 'keyword'"), ["matched_keywords", "marks" if marks else "text"]
        shown = _line_marks(code_chunks, few, only) if marks else keyword_lines(code_chunks, few, config, only)
        shown = shown.select(*[F.col(c).alias(f"_{c}") for c in (*keys, *parts)])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        filled = only.join(shown, same).withColumns({c: F.col(f"_{c}") for c in parts}).select(best.columns)
        rows = best.where("source = 'path'").unionByName(filled)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        nothing = "question_id long, repo_id string, path string, line int, text string, matched_keywords array<string>"
        none = asked.sparkSession.createDataFrame([], nothing)
        return keyword_hits(none, none.drop("line", "text"), repos)
    return out


# ---------------------------------------------------------------- vectors


class HashingEmbedder:
    """Vectors out of hashed words, of unit length; stands in for a trained embedder, which has the same one method."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        import re
        import zlib

        out = np.zeros((len(texts), self.dimensions))
        for i, t in enumerate(texts):
            codes = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in re.findall(r"\w+", t.lower())], np.int64)
            if len(codes):
                np.add.at(out[i], codes % self.dimensions, np.where(codes >> 16 & 1, 1.0, -1.0))
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _nearest(ids: np.ndarray, queries: np.ndarray, n: int, vectors):
    """The n nearest rows of each batch to each query; the least of equal distances by key goes first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = vectors(pdf)
            for lo in range(0, len(ids), 256):
                q = queries[lo : lo + 256]
                d = np.maximum(0.0, (x * x).sum(axis=1)[None] + (q * q).sum(axis=1)[:, None] - 2 * q @ x.T)
                k = min(n, len(x))
                # all rows up to the k-th least distance, so that ties are settled later and alike everywhere
                edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k] + 1e-9
                rows, cols = np.nonzero(d <= edge)
                yield pd.DataFrame({"question_id": ids[lo : lo + 256][rows], "key": pdf["key"].to_numpy()[cols], "distance": d[rows, cols]})

    return run


def vector_topk(rows: DataFrame, queries: DataFrame, n: int, block: int = 5000) -> DataFrame:
    """(question_id, key, distance): the n rows (key, embedding) at the least squared distance from each query
    (question_id, embedding), exactly; ties go by key.

    The queries are a stated set and go to the workers ``block`` at a time; the rows are read where they lie, and only
    the nearest of each batch are shuffled. Null vectors are near nothing.
    """
    total = queries.count()
    out = None
    blocks = max(1, -(-total // block))
    good = rows.where(F.col("embedding").isNotNull()).select("key", "embedding")
    key_type = dict(good.dtypes)["key"]
    for b in range(blocks):
        part = queries.where(F.col("embedding").isNotNull() & (F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == b)).toPandas()
        if not len(part):
            continue
        q = np.array(part["embedding"].tolist(), np.float64)
        found = good.mapInPandas(
            _nearest(part["question_id"].to_numpy(), q, n, lambda pdf: np.array(pdf["embedding"].tolist(), np.float64)),
            f"question_id long, key {key_type}, distance double",
        )
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.sparkSession.createDataFrame([], f"question_id long, key {key_type}, distance double")
    w = Window.partitionBy("question_id").orderBy(F.round("distance", 9), "key")
    return out.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).drop("n")


def vector_dedupe(found: DataFrame, limit: int) -> DataFrame:
    """The nearest hit of each chunk, or of each (kind, asset, path, page) where there is no chunk id, up to ``limit``."""
    identity = F.coalesce(F.col("chunk_id"), F.concat_ws("\x1f", "kind", "repo_id", "path", F.col("page").cast("string")))
    first = Window.partitionBy("question_id", identity).orderBy("distance", "ord")
    near = Window.partitionBy("question_id").orderBy("distance", "ord")
    return (
        found.withColumn("n", F.row_number().over(first)).where("n = 1")
        .withColumn("n", F.row_number().over(near)).where(F.col("n") <= limit).drop("n")
    )


def vector_hits(chunks: DataFrame, asked: DataFrame, embedder, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Vector hits of chunks (chunk_id, kind, repo_id, path, filename, page, start_line, end_line, text): three times
    ``top_k`` per question."""
    n = 3 * max(1, min(fixed.RETRIEVAL_LIMIT, config.top_k))
    pdf = asked.select("question_id", "question").toPandas()  # the stated set of questions
    ids, q = pdf["question_id"].to_numpy(), embedder.embed(pdf["question"].fillna("").tolist())
    once = chunks.where(F.col("chunk_id").isNotNull() & F.col("text").isNotNull()).select(F.col("chunk_id").alias("key"), "text")
    found = once.mapInPandas(_nearest(ids, q, n, lambda b: embedder.embed(b["text"].tolist())), "question_id long, key string, distance double")
    w = Window.partitionBy("question_id").orderBy(F.round("distance", 9), "key")
    near = found.distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).drop("n")
    # at most ``n`` rows per question of the stated set, so the chunks stay where they lie
    rows = chunks.join(F.broadcast(near), near["key"] == chunks["chunk_id"]).withColumns(
        {"source": F.lit("vector"), "block": F.lit(2),
         "ord": F.struct(F.lit("").alias("a"), F.col("key").alias("b"), F.lit(0).cast("long").alias("c"), F.round("distance", 9).alias("d"))})
    return vector_dedupe(hits(rows), n)


# ---------------------------------------------------------------- merge and rank


def _keys(config: SearchConfig) -> list[str]:
    return ["question_id", "repo_id", "path"] if config.repo_scoped else ["question_id", "path"]


def interval_antijoin(vectors: DataFrame, lines: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Vector hits on code without those that a keyword line of the same path lies in; other vector hits pass."""
    keys = _keys(config)
    code = (F.col("kind") == "code") & F.col("path").isNotNull() & F.col("start_line").isNotNull() & F.col("end_line").isNotNull()
    marks = lines.select(*keys, F.col("line").alias("at")).distinct()
    v, m = vectors.where(code).alias("v"), marks.alias("m")
    same = [F.col(f"v.{k}") == F.col(f"m.{k}") for k in keys]
    free = v.join(m, [*same, F.col("m.at").between(F.col("v.start_line"), F.col("v.end_line"))], "left_anti")
    return free.unionByName(vectors.where(~F.coalesce(code, F.lit(False))))


def merge_hits(lexical: DataFrame, vectors: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Keyword lines, then the vector hits they don't cover, then the paths that neither has; ``rank`` from 1."""
    lines, paths = lexical.where("source <> 'path'"), lexical.where("source = 'path'")
    free = interval_antijoin(vectors, lines, config)
    keys = _keys(config)
    content = lines.select(*keys).unionByName(free.where("kind = 'code' and path is not null").select(*keys)).distinct()
    rest = paths.join(content, keys, "left_anti")
    merged = (
        lines.withColumn("block", F.lit(1)).unionByName(free.withColumn("block", F.lit(2))).unionByName(rest.withColumn("block", F.lit(3)).select(lines.columns))
    )
    # vector hits come by distance, the others by place
    w = Window.partitionBy("question_id").orderBy("block", F.coalesce(F.round("distance", 9), F.lit(0.0)), "ord.a", "ord.b", "ord.c")
    return merged.withColumn("rank", F.row_number().over(w))


def score_hits(merged: DataFrame, asked: DataFrame) -> DataFrame:
    """Hits with ``score``; those that have ``marks`` need no text."""
    place = F.coalesce("path", "filename", F.lit(""))
    marks = T.text_marks(F.col("source"), F.coalesce("text", F.lit("")), place, F.col("question"), F.col("keywords"), F.col("hints"))
    joined = merged.join(asked, "question_id").withColumn("marks", F.coalesce("marks", marks))
    hit = {
        "source": F.col("source"), "path": place, "marks": F.col("marks"), "matched": F.col("matched_keywords"),
        "distance": F.coalesce("distance", F.lit(1.0)), "is_code": (F.col("kind") == "code") & F.col("start_line").isNotNull(),
    }
    return joined.withColumn("score", T.hit_score(hit, F.col("question"), F.col("qtype"), F.col("keywords"), F.col("hints"))).drop("question", "keywords", "hints", "marks")


def diversify(scored: DataFrame, limit: Column | int) -> DataFrame:
    """The best hits per question: all kinds for questions about structure; else those that aren't on a path alone, and
    one path hit if a place is left. Without others the best path hit comes first and, if there is room, once more.
    ``scored`` has qtype, score and rank; ``position`` counts from 1."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    by_score = [F.desc("score"), F.asc("rank")]
    structural = F.col("qtype") == "structure"
    group = F.when(structural, "all").when(F.col("source") == "path", "path").otherwise("content")
    rows = scored.withColumns({"_limit": limit, "_group": group})
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("question_id", "_group").orderBy(*by_score)))
    rows = rows.where((F.col("_n") <= F.col("_limit")) & ((F.col("_group") != "path") | (F.col("_n") == 1)))
    rows = rows.withColumn("_content", F.sum(F.when(F.col("_group") == "content", 1).otherwise(0)).over(Window.partitionBy("question_id")))
    room = F.col("_limit") - F.col("_content")
    times = F.when(F.col("_group") != "path", 1).when(F.col("_content") == 0, F.least(F.lit(2), F.col("_limit"))).when(room > 0, 1).otherwise(0)
    rows = rows.withColumn("_copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))
    place = Window.partitionBy("question_id").orderBy(F.desc("score"), (F.col("_group") == "path"), F.asc("rank"), "_copy")
    return rows.withColumn("position", F.row_number().over(place)).drop("_limit", "_group", "_n", "_content", "_copy")


# ---------------------------------------------------------------- context


def coalesce_adjacent(ranked: DataFrame, gap: int = fixed.MERGE_GAP) -> DataFrame:
    """Hits of code that follow each other in rank and lie at most ``gap`` lines after each other in one path, as one.

    There is no lower bound of the gap, so a hit further up in the file is joined too and the end then moves backwards.
    Kept: first identity and start, last end, least distance, greatest score, texts in order.
    """
    w = Window.partitionBy("question_id").orderBy("position")
    code = F.coalesce((F.col("source") == "vector") & (F.col("kind") == "code"), F.lit(False))
    before = F.lag(F.struct(code.alias("code"), "path", "end_line")).over(w)
    joins = code & F.coalesce(before["code"], F.lit(False)) & (before["path"].eqNullSafe(F.col("path"))) & F.coalesce(F.col("start_line") - before["end_line"] <= gap, F.lit(False))
    rows = ranked.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("_group", F.sum("_new").over(w))
    first, kept = F.col("position"), [c for c in ranked.columns if c not in ("question_id", "position", "end_line", "distance", "score", "text")]
    return (
        rows.groupBy("question_id", "_group")
        .agg(
            F.min("position").alias("position"),
            *[F.min_by(c, first).alias(c) for c in kept],
            F.max_by("end_line", first).alias("end_line"),
            F.min("distance").alias("distance"),
            F.max("score").alias("score"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n").alias("text"),
        )
        .drop("_group")
    )


def _shown(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("None"))


def context_lines(coalesced: DataFrame, max_chars: int = fixed.CONTEXT_CHARS) -> DataFrame:
    """The hits that fit into the context, each with the ``context_line`` it is shown by.

    Lines count with one break each after the header; the first that is too long ends the context.
    """
    score = F.col("score").cast("string")
    lexical = F.format_string("- (kind=%s, score=%s, path=%s, line=%s, keywords=%s) %s", "source", score, "path", F.col("line").cast("string"), F.array_join("matched_keywords", ","), "text")
    doc = F.format_string("- (kind=doc, source_type=%s, score=%s, page=%s, chunk_id=%s) %s", F.lit("doc"), score, _shown(F.col("page")), F.coalesce("chunk_id", F.lit("")), "text")
    code = F.format_string("- (kind=code, source_type=%s, score=%s, path=%s, L%s-L%s, chunk_id=%s) %s", F.lit("code"), score, _shown(F.col("path")), _shown(F.col("start_line")), _shown(F.col("end_line")), F.coalesce("chunk_id", F.lit("")), "text")
    line = F.when(F.col("source").isin("keyword", "path"), lexical).when(F.col("kind") == "doc", doc).otherwise(code)
    w = Window.partitionBy("question_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rows = coalesced.withColumn("context_line", line)
    used = F.lit(len(fixed.CONTEXT_HEADER) + 1) + F.sum(F.length("context_line") + 1).over(w)
    return rows.withColumn("_used", used).where(F.col("_used") <= max_chars).drop("_used")


def citations(cited: DataFrame) -> DataFrame:
    """What each shown hit is cited by; columns that its kind has no use for are null."""
    lexical = F.col("source").isin("keyword", "path")
    only = lambda cond, c: F.when(cond, F.col(c)).alias(c)
    return cited.select(
        "question_id", "position", F.when(lexical, F.col("source")).otherwise(F.col("kind")).alias("kind"), "score", "path",
        only(lexical, "line"), only(lexical, "matched_keywords"), only(~lexical, "filename"), only(~lexical, "page"),
        only(~lexical, "start_line"), only(~lexical, "end_line"), only(~lexical, "chunk_id"), only(~lexical, "distance"), "context_line",
    )


def context(cited: DataFrame) -> DataFrame:
    """(question_id, context): the header and the shown lines, at most ``max_chars`` long, so one row holds it."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", "context_line"))), lambda x: x["context_line"])
    return cited.groupBy("question_id").agg(F.concat(F.lit(fixed.CONTEXT_HEADER + "\n"), F.array_join(lines, "\n")).alias("context"))


def hybrid_search(code_chunks: DataFrame, text_chunks: DataFrame, questions: DataFrame, config: SearchConfig = SearchConfig(), embedder=None) -> DataFrame:
    """Citations of each question (question_id, question): the whole way from keywords to the context.

    Ids and questions must not be null; a question without hits has no row. Redelivered chunks count once.
    """
    from grainstore.session import written

    asked = written(understood(questions.where(F.col("question_id").isNotNull() & F.col("question").isNotNull())), "questions")
    index = written(path_index(code_chunks), "paths")
    repos = index.select("repo_id").distinct().count()
    lexical = written(lexical_hits(code_chunks, index, asked, config), "lexical")
    code = code_chunks.select("chunk_id", F.lit("code").alias("kind"), "repo_id", F.translate("path", "\\", "/").alias("path"), F.substring_index(F.translate("path", "\\", "/"), "/", -1).alias("filename"), F.lit(None).cast("int").alias("page"), "start_line", "end_line", "text")
    docs = text_chunks.select("chunk_id", F.lit("doc").alias("kind"), F.col("doc_id").alias("repo_id"), F.lit(None).cast("string").alias("path"), "filename", "page", F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), "text")
    near = written(vector_hits(code.unionByName(docs), asked, embedder or HashingEmbedder(config.dimensions), config), "vectors")
    ranked = score_hits(merge_hits(lexical, near, config), asked)
    best = diversify(ranked, T.rerank_limit(F.col("qtype"), F.lit(repos), config.rerank_limit))
    return citations(context_lines(coalesce_adjacent(best), config.context_chars))
