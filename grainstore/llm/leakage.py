"""Problem 8: passages of test items inside training documents."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainstore.llm.vectors import blocks, mix, words
from grainstore.session import written


@dataclass(frozen=True)
class LeakageConfig:
    """``min_words``: consecutive words of an item that make a leak. ``shingle``: words of a shingle. ``segment``: words of
    the document parts that are sketched. ``miss``: highest probability that a part holding a whole window of an item
    is no candidate. ``least``: distinct shingles of a window from which on it is sketched; windows that repeat words
    more than that are looked up whole. ``filter_bits``: size of the Bloom filter of the items' sketches."""

    min_words: int = 12
    shingle: int = 6
    segment: int = 32
    miss: float = 1e-5
    least: int = 5
    filter_bits: int = 1 << 24
    probes: int = 3


def normal_form(text: str) -> str:
    """A text without regard to case and Unicode form."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()


def sketch_sizes(config: LeakageConfig) -> list[int]:
    """MinHash values that the partition of parts with n shingles needs, by n.

    A part that holds all q >= ``least`` shingles of a window has its least hash under a function with probability q / n
    at least, so enough functions leave all of them unequal with probability ``miss`` at most. The larger the parts of
    a partition, the more functions it takes.
    """
    out = [0]
    for n in range(1, config.segment - config.shingle + 2):
        out.append(1 if n <= config.least else ceil(log(config.miss) / log(1 - config.least / n)))
    return out


def _family(config: LeakageConfig) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240917)
    k = max(sketch_sizes(config))
    return rng.integers(0, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, k, dtype=np.uint32)


def _run_hashes(w: np.ndarray, size: int, salt: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = max(0, len(w) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h += mix(w[k : k + n] + np.uint64((k * 0x9E3779B97F4A7C15 + salt) % 2**64))
    return mix(h)


def _keys(number: int, least: np.ndarray) -> np.ndarray:
    return mix(least.astype(np.uint64) | np.uint64((number + 1) << 32))


_ITEM_KEYS = "item_id long, key long, whole boolean"


def _item_keys(config: LeakageConfig):
    """The sketches of each window of an item's passage: its least shingle hash under each function."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _family(config)
        per_window = config.min_words - config.shingle + 1
        for pdf in batches:
            for item, passage in zip(pdf["item_id"], pdf["passage"], strict=True):
                w, _ = words([normal_form(passage)])
                n = len(w) - config.min_words + 1
                if n <= 0:
                    continue
                h = _run_hashes(w, config.shingle, 1)
                windows = h[np.arange(n)[:, None] + np.arange(per_window)]
                distinct = np.array([len(np.unique(x)) for x in windows])
                small = (windows >> np.uint64(32)).astype(np.uint32)
                sketched = small[distinct >= config.least]
                found = [_keys(j, np.unique((sketched * a[j] + b[j]).min(axis=1))) for j in range(len(a))] if len(sketched) else []
                keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
                whole = np.unique(_run_hashes(w, config.min_words, 2)[distinct < config.least])
                both = np.concatenate([keys, whole]).view(np.int64)
                yield pd.DataFrame({"item_id": item, "key": both, "whole": np.arange(len(both)) >= len(keys)})

    return run


def _places(keys: np.ndarray, config: LeakageConfig) -> Iterator[np.ndarray]:
    for p in range(config.probes):
        yield mix(keys + np.uint64(p * 0xD6E8FEB86659FD93 % 2**64)) % np.uint64(config.filter_bits)


def _key_filter(keys: DataFrame, config: LeakageConfig) -> np.ndarray:
    """A Bloom filter of the keys; its size is fixed, whatever their number, and only it reaches the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(config.filter_bits // 64, np.uint64)
        for pdf in batches:
            for at in _places(pdf["key"].to_numpy(np.int64).view(np.uint64), config):
                np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        at = np.flatnonzero(bits)
        yield pd.DataFrame({"at": at.astype(np.int32), "bits": bits[at].view(np.int64)})

    found = keys.select("key").mapInPandas(run, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(config.filter_bits // 64, np.uint64)
    out[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _held(keys: np.ndarray, bits: np.ndarray, config: LeakageConfig) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for at in _places(keys, config):
        out &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def _document_keys(bits, with_whole: bool, config: LeakageConfig):
    """The sketches of a document's parts that the filter of the items lets through, each once per document.

    Parts overlap by all but one of a window's words, so each window lies in one of them whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _family(config)
        sizes, held = np.array(sketch_sizes(config)), bits.value
        stride = config.segment - config.min_words + 1
        for pdf in batches:
            ids = pdf["doc_id"].to_numpy(np.int64)
            texts = [normal_form(t) for t in pdf["text"]]
            for lo, hi in blocks(texts):
                w, doc = words(texts[lo:hi])
                first = np.searchsorted(doc, np.arange(hi - lo + 1))
                length = np.diff(first)
                h = _run_hashes(w, config.shingle, 1)
                small = (h >> np.uint64(32)).astype(np.uint32)
                parts = np.where(length >= config.min_words, 1 + np.maximum(0, -(-(length - config.segment) // stride)), 0)
                of = np.repeat(np.arange(hi - lo), parts)
                place = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
                begin = first[:-1][of] + place * stride
                end = np.minimum(begin + config.segment, first[1:][of]) - config.shingle + 1
                functions = sizes[end - begin]
                keys, docs = [], []
                if len(of):
                    edges = np.stack([begin, end], axis=1).ravel()
                    for j in range(int(functions.max())):
                        least = np.minimum.reduceat(np.append(small * a[j] + b[j], np.uint32(0)), edges)[::2]
                        mine = functions > j
                        k = _keys(j, least[mine])
                        ok = _held(k, held, config)
                        keys.append(k[ok])
                        docs.append(of[mine][ok])
                if with_whole and len(w) >= config.min_words:
                    k = _run_hashes(w, config.min_words, 2)
                    ok = _held(k, held, config) & (doc[: len(k)] == doc[config.min_words - 1 :])
                    keys.append(k[ok])
                    docs.append(doc[: len(k)][ok])
                if keys:
                    pairs = pd.DataFrame({"doc_id": ids[lo:hi][np.concatenate(docs).astype(np.int64)], "key": np.concatenate(keys).view(np.int64)})
                    yield pairs.drop_duplicates()

    return run


def _verify(config: LeakageConfig):
    """Exact containment: the passage's windows of words among the document's."""

    def windows(text: str) -> list[str]:
        w = "".join(c if c.isalnum() or c == "_" else " " for c in normal_form(text)).split()
        return [" ".join(w[i : i + config.min_words]) for i in range(len(w) - config.min_words + 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, set()
        for pdf in batches:
            rows = []
            for doc, text, item, passage in zip(pdf["doc_id"], pdf["text"], pdf["item_id"], pdf["passage"], strict=True):
                if text != last:
                    last, held = text, set(windows(text))
                n = len(set(windows(passage)) & held)
                if n:
                    rows.append((doc, item, n))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "windows"])

    return run


def leaked_passages(documents: DataFrame, items: DataFrame, config: LeakageConfig = LeakageConfig()) -> DataFrame:
    """(doc_id, item_id, windows): documents with at least ``min_words`` consecutive words of an item's passage, and
    how many of the item's distinct windows of that many words they hold.

    Case, spacing, punctuation and Unicode form don't count; words are compared whole. ``documents`` needs doc_id and
    text, ``items`` item_id and passage; null texts, ids and passages, and passages of fewer words, match nothing; a
    document given twice comes once.

    A window of an item is a small set of shingles, a document a large one: MinHash compares them only where sizes are
    near. So documents are cut into overlapping parts, partitioned by size; each partition takes as many functions as its
    size needs to find a contained window. The documents are read once for the sketches, whatever the number of items;
    a Bloom filter of fixed size drops the sketches that no item has before they are joined on equality. The candidates
    (a part's document and an item) are verified on their words. Nothing grows with the items but their own table.
    """
    items = items.where(F.col("item_id").isNotNull() & F.col("passage").isNotNull()).select("item_id", "passage").distinct()
    keys = written(items.mapInPandas(_item_keys(config), _ITEM_KEYS).distinct(), "item-sketches")
    spark = documents.sparkSession
    bits = spark.sparkContext.broadcast(_key_filter(keys, config))  # filter_bits / 8 bytes
    with_whole = not keys.where("whole").isEmpty()
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    sketches = docs.mapInPandas(_document_keys(bits, with_whole, config), "doc_id long, key long")
    candidates = written(sketches.join(keys.select("item_id", "key"), "key").select("doc_id", "item_id").distinct(), "candidates")
    texts = docs.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    pairs = texts.join(candidates, "doc_id").join(items, "item_id").select("doc_id", "text", "item_id", "passage")
    return pairs.mapInPandas(_verify(config), "doc_id long, item_id long, windows int").groupBy("doc_id", "item_id").agg(F.max("windows").alias("windows"))


def leakage_report(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: documents it leaked into and the most windows of it in one of them; items without leaks have 0."""
    return (
        items.select("item_id").where("item_id is not null").distinct()
        .join(leaks.groupBy("item_id").agg(F.count("*").alias("docs"), F.max("windows").alias("most_windows")), "item_id", "left")
        .select("item_id", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("most_windows", F.lit(0)).alias("most_windows"))
    )
