"""Problem 5: near-duplicate chunks by MinHash candidates, Bayesian pruning and exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainstore.llm.graph import components
from grainstore.llm.vectors import blocks, mix, shingles
from grainstore.session import written


@dataclass(frozen=True)
class NearDuplicateConfig:
    """``shingle`` words a run, Jaccard ``threshold``; ``bands`` of ``rows`` MinHash values make the candidates.

    With 60 bands of 4 a pair at exactly 0.6 becomes a candidate with probability 0.9998, at 0.65 with 0.99999.
    ``compare`` values are compared, ``step`` at a time; a pair is dropped when the posterior probability that its
    similarity reaches the threshold, under a uniform prior, is below ``tolerance``. Buckets of more than ``block``
    classes are compared block by block, each pair of blocks apart.
    """

    shingle: int = 3
    threshold: float = 0.6
    bands: int = 60
    rows: int = 4
    compare: int = 64
    step: int = 16
    tolerance: float = 1e-4
    broadcast_rows: int = 100_000
    block: int = 1000


_SIGNATURES = "cls long, check long, n int, chunk_id string, bands array<long>, sig binary"


def _families(config: NearDuplicateConfig) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240917)
    k = config.bands * config.rows
    return rng.integers(0, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, k, dtype=np.uint32)


def min_hashes(sets: list[np.ndarray], config: NearDuplicateConfig) -> np.ndarray:
    """MinHash values, one row a set; sets must not be empty."""
    a, b = _families(config)
    out = np.empty((len(sets), len(a)), np.uint32)
    for i, s in enumerate(sets):
        h = (s >> np.uint64(32)).astype(np.uint32)
        best = None
        for lo in range(0, len(h), 512):
            part = (h[lo : lo + 512, None] * a + b).min(axis=0)
            best = part if best is None else np.minimum(best, part)
        out[i] = best
    return out


def _signatures(config: NearDuplicateConfig):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, ids, salts = pdf["text"].tolist(), pdf["chunk_id"].tolist(), pdf["salt"].to_numpy(np.int64).view(np.uint64)
            for lo, hi in blocks(texts):
                sets = shingles(texts[lo:hi], config.shingle)
                keep = [i for i, s in enumerate(sets) if len(s)]
                if not keep:
                    continue
                sets = [sets[i] for i in keep]
                salt = salts[lo:hi][keep]
                values = min_hashes(sets, config)
                n = np.array([len(s) for s in sets], np.uint64)
                sums = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                xors = np.array([np.bitwise_xor.reduce(mix(s)) for s in sets], np.uint64)
                key = np.zeros((len(sets), config.bands), np.uint64)
                grouped = values.reshape(len(sets), config.bands, config.rows).astype(np.uint64)
                for r in range(config.rows):
                    key = mix(key ^ grouped[:, :, r] + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % 2**64))
                key = mix(key ^ (salt[:, None] + np.arange(config.bands, dtype=np.uint64)))
                small = (values[:, : config.compare] & np.uint32(0xFFFF)).astype("<u2")
                yield pd.DataFrame(
                    {
                        "cls": mix(sums ^ salt ^ mix(n)).view(np.int64),
                        "check": mix(xors + salt).view(np.int64),
                        "n": n.astype(np.int32),
                        "chunk_id": [ids[lo + i] for i in keep],
                        "bands": list(key.view(np.int64)),
                        "sig": [x.tobytes() for x in small],
                    }
                )

    return run


def least_matches(config: NearDuplicateConfig) -> dict[int, int]:
    """For each number of compared values the fewest matches at which a pair is kept.

    After m matches of n the similarity has a Beta(m + 1, n - m + 1) posterior; its upper tail is a binomial sum.
    """
    t, out = config.threshold, {}
    for n in range(config.step, config.compare + 1, config.step):
        tail, m = 0.0, 0
        for m in range(n + 1):
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= config.tolerance:
                break
        out[n] = m
    return out


def _prune(config: NearDuplicateConfig):
    least = least_matches(config)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            alive = np.arange(len(pdf))
            a, b = (np.frombuffer(b"".join(pdf[c]), "<u2").reshape(-1, config.compare) for c in ("sig_a", "sig_b"))
            matches, done = np.zeros(len(pdf), np.int64), 0
            for n, m in least.items():
                matches[alive] += (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
                alive, done = alive[matches[alive] >= m], n
            yield pdf.iloc[alive][["a", "b"]]

    return run


def _sets(config: NearDuplicateConfig):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, cls = pdf["text"].tolist(), pdf["cls"].tolist()
            for lo, hi in blocks(texts):
                yield pd.DataFrame({"cls": cls[lo:hi], "runs": [s.tobytes() for s in shingles(texts[lo:hi], config.shingle)]})

    return run


def _verify(config: NearDuplicateConfig):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = []
            for x, y in zip(pdf["runs_a"], pdf["runs_b"], strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(both >= config.threshold * (len(p) + len(q) - both) - 1e-9)
            yield pdf.loc[good, ["a", "b"]]

    return run


@dataclass
class NearDuplicates:
    """``members``: (chunk_id, cls, rep), each chunk with the class of its set of runs and the class's representative.
    ``links``: (a, b, rep_a, rep_b), pairs of different classes at or above the threshold."""

    members: DataFrame
    links: DataFrame


def _in_blocks(crowded: DataFrame, config: NearDuplicateConfig) -> DataFrame:
    """Members of buckets (key, cls, n) with the block each lies in (``at``) and the bucket's number of blocks, so that no
    bucket, however many classes share its key, is compared in one task."""
    blocks = F.ceil(F.col("n") / config.block).cast("int")
    return crowded.select("key", "cls", F.pmod(F.xxhash64("cls", "key"), blocks).cast("int").alias("at"), blocks.alias("blocks"))


def near_duplicates(tables: list[DataFrame], config: NearDuplicateConfig = NearDuplicateConfig()) -> NearDuplicates:
    """Links between chunks (chunk_id, text) of one table each whose sets of word runs have the given similarity.

    Texts with fewer words than a run, and null texts or ids, have no set and no links; a redelivered chunk counts
    once; chunks with equal sets form one class, of which one representative takes part in the search.

    1. One pass over the texts yields per chunk a hash of its set, band keys and MinHash values (written once).
    2. Classes: least chunk_id per hash. 3. Buckets of band keys are counted; buckets of two give their pair from the
    count alone, larger ones are joined, so the many lone keys cost one partial aggregate and no join. 4. Pairs of
    classes are pruned on MinHash values. 5. The sets of what is left are read again and compared exactly.
    """
    rows = None
    for number, df in enumerate(tables):
        part = df.where(F.col("chunk_id").isNotNull() & F.col("text").isNotNull()).select(
            F.lit(number * 7_046_029_254_386_353_131 % 2**62).cast("long").alias("salt"), "chunk_id", "text"
        )
        rows = part if rows is None else rows.unionByName(part)
    sigs = written(rows.mapInPandas(_signatures(config), _SIGNATURES), "signatures")
    classes = sigs.groupBy("cls", "check").agg(F.min("chunk_id").alias("rep"), F.countDistinct("chunk_id").alias("copies"))
    classes = written(classes, "classes")
    if not classes.groupBy("cls").count().where("count > 1").isEmpty():
        raise RuntimeError("two sets of runs have one 64-bit hash; give the table another salt")
    reps = sigs.join(classes.select("cls", "check", F.col("rep").alias("chunk_id")), ["cls", "check", "chunk_id"], "left_semi")
    keys = reps.select("cls", F.explode("bands").alias("key"))
    buckets = written(
        keys.groupBy("key").agg(F.min("cls").alias("a"), F.max("cls").alias("b"), F.count("*").alias("n")).where("a < b"), "buckets"
    )
    crowded = written(_in_blocks(keys.join(buckets.where("n > 2").select("key", "n"), "key").distinct(), config), "crowded")
    last = F.col("blocks") - 1
    left = crowded.select("key", F.col("cls").alias("x"), F.col("at").alias("i"), F.explode(F.sequence(F.col("at"), last)).alias("j"))
    right = crowded.select("key", F.col("cls").alias("y"), F.explode(F.sequence(F.lit(0), F.col("at"))).alias("i"), F.col("at").alias("j"))
    within = left.join(right, ["key", "i", "j"]).where("i < j or x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    candidates = buckets.where("n = 2").select("a", "b").unionByName(within).distinct()
    small = reps.select("cls", "n", "sig").dropDuplicates(["cls"])
    pruned = written(
        candidates.join(small.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a")), "a")
        .join(small.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b")), "b")
        .where(F.least("n_a", "n_b") >= config.threshold * F.greatest("n_a", "n_b") - 1e-9)
        .select("a", "b", "sig_a", "sig_b")
        .mapInPandas(_prune(config), "a long, b long"),
        "pruned",
    )
    wanted = pruned.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes, "cls").select("cls", F.col("rep").alias("chunk_id"))
    wanted = written(wanted, "wanted")
    if wanted.count() <= config.broadcast_rows:  # beyond that the join shuffles both sides
        wanted = F.broadcast(wanted)
    sets = rows.select("chunk_id", "text").join(wanted, "chunk_id").select("cls", "text").mapInPandas(_sets(config), "cls long, runs binary")
    sets = written(sets.dropDuplicates(["cls"]), "sets")
    linked = (
        pruned.join(sets.select(F.col("cls").alias("b"), F.col("runs").alias("runs_b")), "b")
        .join(sets.select(F.col("cls").alias("a"), F.col("runs").alias("runs_a")), "a")
        .select("a", "b", "runs_a", "runs_b")
        .mapInPandas(_verify(config), "a long, b long")
    )
    rep = classes.select("cls", "rep", "copies")
    links = written(
        linked.join(rep.select(F.col("cls").alias("a"), F.col("rep").alias("rep_a"), F.col("copies").alias("copies_a")), "a")
        .join(rep.select(F.col("cls").alias("b"), F.col("rep").alias("rep_b"), F.col("copies").alias("copies_b")), "b"),
        "links",
    )
    members = sigs.select("cls", "check", "chunk_id").distinct().join(classes, ["cls", "check"]).select("chunk_id", "cls", "rep", "copies")
    return NearDuplicates(members, links)


def near_duplicate_pairs(found: NearDuplicates) -> DataFrame:
    """(chunk_a, chunk_b), chunk_a < chunk_b: all pairs of similar chunks, copies included.

    A class is one set of runs, not one text, so every member is paired with every other and with every member of the
    linked classes, whatever the size; the output is quadratic in the size of a class, as the pairs asked for are.
    """
    several = found.members.where("copies > 1").select("chunk_id", "cls", "rep", "copies")
    inside = (
        several.select("cls", F.col("chunk_id").alias("x")).join(several.select("cls", F.col("chunk_id").alias("y")), "cls").where("x < y").select("x", "y")
    )
    across = found.links
    for side in ("a", "b"):
        others = several.where("chunk_id <> rep").select(F.col("cls").alias(side), F.col("chunk_id").alias("other"))
        across = across.withColumn(f"x_{side}", F.col(f"rep_{side}")).unionByName(
            across.where(F.col(f"copies_{side}") > 1).join(others, side).withColumn(f"x_{side}", F.col("other")).drop("other")
        )
    pairs = inside.unionByName(across.select(F.col("x_a").alias("x"), F.col("x_b").alias("y")))
    return pairs.select(F.least("x", "y").alias("chunk_a"), F.greatest("x", "y").alias("chunk_b")).distinct()


def near_duplicate_groups(found: NearDuplicates) -> DataFrame:
    """(chunk_id, group_id, links): each chunk that has a near or exact copy, with the least representative of its
    group and the number of other texts its own is linked to."""
    ids = components(found.links.select("rep_a", "rep_b"), "rep_a", "rep_b").withColumnRenamed("node", "rep")
    degree = (
        found.links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    )
    return (
        found.members.join(ids, "rep", "left")
        .join(degree, "rep", "left")
        .where(F.col("component").isNotNull() | (F.col("copies") > 1))
        .select("chunk_id", F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
