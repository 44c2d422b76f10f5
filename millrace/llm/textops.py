"""Vectorised byte-level text kernels: words, rolling hashes and shingles of Arrow string arrays.

Texts stay in Arrow's contiguous buffer; every kernel is a handful of numpy passes over it, so no
Python code runs per word. Word and shingle identities are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPLIT_BYTES = 1 << 21
_HASH_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64's public constants)."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_R = U64(0xD6E8FEB86659FD93)
_R_INV = U64(pow(int(_R), -1, 1 << 64))
_POW: dict[str, np.ndarray] = {"r": np.ones(1, U64), "i": np.ones(1, U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the rolling base and of its inverse modulo 2**64."""
    if len(_POW["r"]) <= n:
        size = max(n + 1, 1 << 16)
        for key, base in (("r", _R), ("i", _R_INV)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POW[key] = np.multiply.accumulate(steps)
    return _POW["r"], _POW["i"]


def rolling(data: np.ndarray) -> np.ndarray:
    """Prefix sums S with S[e] - S[s] = base**s * hash(data[s:e])."""
    r, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * r[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hashes of the byte spans [start, end)."""
    _, inv = powers(len(sums))
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(U64) * U64(0xA24BAED4963EE407))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = _SPLIT_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes (a longer text alone), which bound a worker's memory."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def lower_ascii(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    upper = (out >= 65) & (out <= 90)
    out[upper] += 32
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


class Words:
    """Words of a slice of texts: start, end (bytes), doc (row of the slice), hash; first[d]:first[d+1] are d's."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        self.data = lower_ascii(data) if lower else data
        self.n_docs = len(offsets) - 1
        word = ~_SPACE[self.data]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        edge = offsets[:-1][(offsets[:-1] < len(data))]
        begin[edge] = word[edge]
        stop = word.copy()
        stop[:-1] &= ~word[1:]
        tail = offsets[1:][offsets[1:] > 0] - 1
        stop[tail] = word[tail]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))
        self.hash = np.empty(len(self.start), U64)
        lo = 0
        while lo < len(self.start):  # words of about 1 MB at a time: hashing takes many bytes for each byte of text
            hi = max(lo + 1, int(np.searchsorted(self.end, self.start[lo] + _HASH_BYTES, side="right")))
            a = self.start[lo]
            self.hash[lo:hi] = span_hash(rolling(self.data[a : self.end[hi - 1]]), self.start[lo:hi] - a, self.end[lo:hi] - a)
            lo = hi

    def shingles(self, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """(hash, doc) of all k-word shingles, repeats kept; a text of 1..k-1 words is one shingle."""
        n = len(self.hash)
        counts = np.diff(self.first)
        short = np.flatnonzero((counts > 0) & (counts < k))
        mult = mix(np.arange(11, 11 + k, dtype=U64))
        full_h, full_d = np.zeros(0, U64), np.zeros(0, np.int64)
        if n >= k:
            m = n - k + 1
            parts = np.zeros(m, U64)
            for j in range(k):
                parts += self.hash[j : j + m] * mult[j]
            keep = self.doc[:m] == self.doc[k - 1 :]
            full_h, full_d = mix(parts[keep]), self.doc[:m][keep]
        if len(short):
            odd = [short_hash(self.hash[self.first[d] : self.first[d + 1]], mult) for d in short]
            full_h, full_d = np.concatenate([full_h, np.array(odd, U64)]), np.concatenate([full_d, short])
            order = np.argsort(full_d, kind="stable")
            full_h, full_d = full_h[order], full_d[order]
        return full_h, full_d


def short_hash(words: np.ndarray, mult: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        return mix(np.array([(words * mult[: len(words)]).sum(dtype=U64) + U64(len(words))], U64))[0]


def distinct_per_doc(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each document, sorted within it, and the offsets of the documents."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(n_docs + 1))
