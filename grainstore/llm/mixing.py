"""Problem 9: mixing sources to target weights by raking and calibrated sampling."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainstore.llm.languages import named_language
from grainstore.session import written

#: How text is split before the merges of a rank file (fixed value of the public tokenizers).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class MixConfig:
    """``ranks``: rank file of a public tokenizer, readable on every executor. ``bins``: steps per source and cell that
    the sampling is calibrated in, so at most sources x languages x topics x bins numbers reach the driver. ``rounds`` of
    raking; ``total``: tokens wanted (None: as many as the caps allow); ``seed`` of the sampling."""

    ranks: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    bins: int = 128
    rounds: int = 50
    total: int | None = None
    seed: int = 11


def token_counter(ranks: str):
    """A function from a text to its number of tokens; lone surrogates, which have no bytes, count as one mark each."""
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tokenizer = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=merges, special_tokens={})
    return lambda text: len(tokenizer.encode_ordinary(text.encode("utf-8", "replace").decode()))


def _count_tokens(ranks: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = token_counter(ranks)
        for pdf in batches:
            yield pdf.drop(columns="text").assign(tokens=np.array([count(t) for t in pdf["text"]], np.int64))

    return run


def canonical_source(source: Column) -> Column:
    """The name of a source without regard to case, outer spaces, hyphens and inner spaces; null stays null."""
    return F.regexp_replace(F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", "")), r"[\s\-]+", "_")


def layout_topic(text: Column) -> Column:
    """A coarse topic by what a text is made of: code, settings or prose."""
    return F.when(text.contains("```"), "code").when(text.rlike(r"(?m)^[\w.\-]+=\S+$"), "settings").otherwise("prose")


def counted(documents: DataFrame, targets: DataFrame, config: MixConfig, topic: Column | None = None) -> DataFrame:
    """(doc_id, source, language, topic, tokens) of the documents whose source has a target, each document once."""
    wanted = [r[0] for r in targets.select(canonical_source(F.col("source"))).distinct().collect()]  # one row per source
    rows = documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select(
        "doc_id", canonical_source(F.col("source")).alias("source"),
        F.coalesce(named_language(F.col("lang")), F.lit("other")).alias("language"),
        (topic if topic is not None else layout_topic(F.col("text"))).alias("topic"), "text",
    ).where(F.col("source").isin([x for x in wanted if x is not None]))
    tokens = rows.mapInPandas(_count_tokens(config.ranks), "doc_id long, source string, language string, topic string, tokens long")
    # a document delivered twice is the same one: the least of equal rows stands for it
    return tokens.groupBy("doc_id").agg(F.min(F.struct("source", "language", "topic", "tokens")).alias("r")).select("doc_id", "r.*").where("tokens > 0")


def rake(cells: pd.DataFrame, weights: dict[str, float], caps: dict[str, int], total: float | None, rounds: int) -> tuple[pd.Series, float]:
    """Repeats of each cell (source, language, topic, tokens) and the tokens they add up to.

    Iterative proportional fitting: weights are scaled in turn to the marginals of topic, language (both as in the
    collection) and source (the targets), and held under the caps of their source. The total is the largest at which
    every source with documents reaches its target, or ``total`` if that is less; the last step fits the sources, so
    only what the caps forbid is missing from their shares.
    """
    tokens = cells["tokens"].to_numpy(float)
    by_source = cells.groupby("source")["tokens"].sum()
    goal = {s: weights.get(s, 0.0) for s in by_source.index}
    room = [caps[s] * by_source[s] / goal[s] for s in by_source.index if goal[s] > 0]
    whole = min([*room, *([total] if total else [])], default=0.0)
    cap = cells["source"].map(caps).to_numpy(float)
    wanted = cells["source"].map(goal).to_numpy(float) * whole
    repeats = np.where(tokens > 0, wanted / np.maximum(cells["source"].map(by_source).to_numpy(float), 1), 0.0)
    share = {k: cells.groupby(k)["tokens"].sum() / max(1.0, tokens.sum()) for k in ("language", "topic")}
    for _ in range(rounds):
        for key in ("topic", "language"):
            now = pd.Series(repeats * tokens).groupby(cells[key].to_numpy()).sum()
            factor = {k: share[key][k] * whole / now[k] if now[k] > 0 else 1.0 for k in now.index}
            repeats = np.minimum(repeats * cells[key].map(factor).to_numpy(float), cap)
        for s in by_source.index:
            # what the caps take from some cells of a source goes to its others
            mine = (cells["source"] == s).to_numpy()
            for _ in range(20):
                now = float((repeats * tokens)[mine].sum())
                if now <= 0 or abs(now - goal[s] * whole) <= 1e-9 * max(1.0, whole):
                    break
                repeats[mine] = np.minimum(repeats[mine] * goal[s] * whole / now, cap[mine])
    return pd.Series(repeats, cells.index), whole


def _copies(rate: Column, u: Column) -> Column:
    """Whole copies plus one more with the probability of the rest."""
    return F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)


@dataclass
class Mix:
    """``documents``: (doc_id, source, copies, tokens), ``tokens`` of one copy; ``shares``: one row per target source."""

    documents: DataFrame
    shares: DataFrame


def mix_sources(documents: DataFrame, targets: DataFrame, config: MixConfig = MixConfig(), topic: Column | None = None) -> Mix:
    """Documents with how often each is used, so that the sources' shares of all tokens come to their targets.

    ``targets`` holds (source, target_weight, max_repeats), few rows; weights are taken relative to their sum, a null
    weight is 0, a null or lesser ``max_repeats`` 1. No document is used more often than its source's cap; documents of
    null or other sources, without an id or without text are not used; a source without documents has share 0.

    Token counts are written once, without texts. The cells of the marginals are raked on the driver; documents are drawn
    by a hash of their id, and the rate of each source is calibrated on a histogram of that hash, so the share reached is
    off by about one bin's documents. A source with a third of all rows is never sorted or gathered.
    """
    docs = written(counted(documents, targets, config, topic).withColumn(
        "u", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(config.seed)), F.lit(2**30)) / float(2**30)), "tokens")
    goals = targets.groupBy(canonical_source(F.col("source")).alias("source")).agg(
        F.sum(F.coalesce("target_weight", F.lit(0.0))).alias("w"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))).alias("cap")
    ).where("source is not null").collect()
    all_w = sum(r.w for r in goals) or 1.0
    weights, caps = {r.source: r.w / all_w for r in goals}, {r.source: int(r.cap) for r in goals}
    bins = docs.groupBy("source", "language", "topic", F.floor(F.col("u") * config.bins).cast("int").alias("bin")).agg(F.sum("tokens").alias("tokens")).toPandas()
    spark = documents.sparkSession
    keys = ["source", "language", "topic"]
    if len(bins):
        cells = bins.groupby(keys, as_index=False)["tokens"].sum()
        rates, whole = rake(cells, weights, caps, config.total, config.rounds)
        cells["rate"] = calibrated(cells.assign(rate=rates), bins, weights, caps, whole, config.bins)["rate"]
    else:
        cells = pd.DataFrame({"source": pd.Series(dtype=str), "language": pd.Series(dtype=str), "topic": pd.Series(dtype=str), "rate": pd.Series(dtype=float)})
    rows = [(r.source, r.language, r.topic, float(r.rate)) for r in cells.itertuples()]
    rate = F.broadcast(spark.createDataFrame(rows, "source string, language string, topic string, rate double"))  # one row per cell
    used = docs.join(rate, keys).withColumn("copies", _copies(F.col("rate"), F.col("u")).cast("int")).where("copies > 0")
    used = written(used.select("doc_id", "source", "copies", "tokens"), "mix")
    reached = used.groupBy("source").agg(
        F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.count("*").alias("docs"), F.max("copies").alias("most_copies"))
    total = reached.agg(F.sum("tokens").alias("all_tokens"))
    want = spark.createDataFrame([(s, weights[s], caps[s]) for s in weights], "source string, target_weight double, max_repeats int")
    shares = want.join(reached, "source", "left").join(F.broadcast(total)).select(  # one row
        "source", "target_weight", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("share"),
    )
    return Mix(used, shares)


def calibrated(cells: pd.DataFrame, bins: pd.DataFrame, weights: dict[str, float], caps: dict[str, int], whole: float, n_bins: int) -> pd.DataFrame:
    """``cells`` with rates scaled per source so that the expected draw from the histogram meets the target.

    The tokens drawn at a rate are those of the whole copies plus those of the bins below its fraction; this grows with
    the scale, so bisection finds it.
    """
    keys = ["source", "language", "topic"]
    table = np.zeros((len(cells), n_bins))
    at = {tuple(r): i for i, r in enumerate(cells[keys].itertuples(index=False))}
    for r in bins.itertuples():
        table[at[r.source, r.language, r.topic], min(int(r.bin), n_bins - 1)] += r.tokens
    below = np.concatenate([np.zeros((len(cells), 1)), np.cumsum(table, axis=1)], axis=1)
    out = cells.copy()
    for s, rows in cells.groupby("source").indices.items():
        base, cap = cells["rate"].to_numpy(float)[rows], caps[s]

        def drawn(scale: float, base=base, rows=rows, cap=cap) -> float:
            rate = np.minimum(base * scale, cap)
            part = (rate - np.floor(rate)) * n_bins
            lo = np.floor(part).astype(int)
            rest = below[rows, lo] + (part - lo) * (below[rows, np.minimum(lo + 1, n_bins)] - below[rows, lo])
            return float((np.floor(rate) * below[rows, -1] + rest).sum())

        lo, hi = 0.0, 2.0 ** 12
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if drawn(mid) < weights.get(s, 0.0) * whole else (lo, mid)
        # between the scales that just miss and just meet the target the lesser error counts
        out.loc[out.index[rows], "rate"] = np.minimum(base * hi, cap)
    return out
