"""Vectorised tokenising and hashing of batches of texts with numpy; shared by the operators that run in Python workers."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = 0x9E3779B97F4A7C15 | 1
_TAIL = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def word_points() -> np.ndarray:
    """For each code point, whether it is a letter, digit or underscore."""
    table = np.zeros(0x110000, dtype=bool)
    table[[i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalnum()]] = True
    table[ord("_")] = True
    return table


@lru_cache(maxsize=8)
def powers(n: int) -> np.ndarray:
    """_P ** i modulo 2**64 for i below n."""
    out = np.full(n, _P, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts with a blank after each, and where each text starts (one more than texts)."""
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    flat = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat, np.concatenate([[0], np.cumsum(lengths)])


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (longest run of letters, digits, underscores; case ignored) and its text's number."""
    flat, starts = code_points([t.lower() for t in texts])
    is_word = word_points()[flat]
    edge = np.diff(np.concatenate([[0], is_word.view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    length = end - begin
    inside = np.flatnonzero(is_word)
    first = np.cumsum(length) - length
    place = np.arange(len(inside)) - np.repeat(first, length)
    at = powers(1 << int(max(64, length.max())).bit_length())[place]
    sums = np.add.reduceat((flat[inside].astype(np.uint64) + np.uint64(1)) * at, first)
    return mix(sums + length.astype(np.uint64)), np.searchsorted(starts, begin, side="right") - 1


def shingles(texts: list[str], size: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its runs of ``size`` words; empty below ``size`` words."""
    w, doc = words(texts)
    n = len(w) - size + 1
    if n <= 0:
        return [np.zeros(0, np.uint64) for _ in texts]
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h += mix(w[k : k + n] * _TAIL[k % len(_TAIL)] + np.uint64(k))
    h = mix(h)
    whole = doc[:n] == doc[size - 1 : size - 1 + n]
    h, doc = h[whole], doc[:n][whole]
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [np.unique(h[cut[i] : cut[i + 1]]) for i in range(len(texts))]


def blocks(texts: list[str], limit: int = 1 << 20):
    """Index ranges of texts whose lengths add up to about ``limit`` characters; keeps the arrays small."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)
