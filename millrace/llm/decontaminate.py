"""Benchmark decontamination by SimHash of item-sized windows.

A document leaks an item when one of its windows of as many words as the item has a weighted Jaccard
similarity (shingle counts) of at least `threshold` to it, over 5-word shingles. A window is fingerprinted as the set of its
(shingle, occurrence number) pairs, whose similarity is the weighted similarity of the shingles, however often words repeat. Windows that hold at
least one of an item's shingles, as any that leaks it must, are fingerprinted with SimHash of 2,048 bits, as running sums of
signed bits. A multi-index of 512 blocks of 4 bits gives every item fingerprint within the radius r, as at least 512 - r blocks of such a pair are equal;
of unrelated fingerprints one in 100,000 has as many equal blocks. The radius is the distance expected at the threshold (17 % of the bits) and six
standard deviations, beyond which one in 10**9 of the pairs at the threshold lies. Candidates
are verified by exact weighted similarity. A document that is shorter than an item
whose shingle it holds is one window and is verified at once. Items of under five words are one shingle and are compared with
all windows of as many words.

Scale: one pass over the documents without a shuffle. The benchmark is shipped in blocks of at most
`block_items` items, each of which is a bounded broadcast and a pass of its own: a benchmark of n items reads the
documents n / block_items times.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy
from .textops import U64, Words, buffers, mix, slices

WORDS = 5
THRESHOLD = 0.75
BITS = 2048
BLOCK = 4
STEP = 512
_SALT = mix(np.arange(501, 501 + BITS // 64, dtype=U64))


def radius_of(threshold: float, bits: int = BITS) -> int:
    """Distance that a pair of that similarity keeps within, with six standard deviations to spare."""
    p = math.acos(min(1.0, 2 * threshold / (1 + threshold))) / math.pi
    return math.ceil(bits * p + 6 * math.sqrt(bits * p * (1 - p)))


def signs(hashes: np.ndarray) -> np.ndarray:
    """Signed bits of every shingle, one row each."""
    words = mix(hashes[:, None] ^ _SALT[None, :])
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def numbered(hashes: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """Hashes of (shingle, occurrence number from 1) pairs."""
    return np.where(occurrence > 1, mix(hashes + occurrence.astype(U64) * U64(0x9E3779B97F4A7C15)), hashes)


def fingerprints(grams: np.ndarray, size: int) -> np.ndarray:
    """Bits of the windows of `size` shingles that begin at each shingle of grams, as rows; a sum of 0 counts as a 0.

    From one window to the next the last occurrence of the shingle that leaves goes and that of the one that enters comes, so the sums
    of the pairs run on as those of plain shingles do.
    """
    kinds, kind = np.unique(grams, return_inverse=True)
    n = len(grams)
    if len(kinds) == n:
        sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(signs(grams), axis=0, dtype=np.int32)])
        return sums[size:] > sums[: n - size + 1]
    place = kind.astype(np.int64) * n + np.arange(n)
    order = np.sort(place)
    rank = np.searchsorted(order, place)
    at = np.arange(n)
    enters = rank + 1 - np.searchsorted(order, place - at + np.maximum(at - size + 1, 0))
    leaves = np.searchsorted(order, place - at + np.minimum(at + size - 1, n - 1), side="right") - rank
    moves = signs(numbered(grams, enters))
    moves[size - 1] = moves[:size].sum(axis=0)
    moves[size:] -= signs(numbered(grams[: n - size], leaves[: n - size]))
    return np.cumsum(moves[size - 1 :], axis=0, dtype=np.int32) > 0


class HammingIndex:
    """Fingerprints (rows of bits) by blocks of `block` bits.

    A pair within `radius` bits differs in at most as many blocks, so at least (blocks - radius) are equal: all that reach this are candidates,
    and none within the radius is missed. Where the radius takes up all blocks, every pair is a candidate.
    """

    def __init__(self, prints: np.ndarray, radius: int, block: int = BLOCK):
        self.radius, self.block = radius, block
        self.packed = self._pack(prints)
        keys = self._keys(prints)
        self.need = keys.shape[1] - radius
        order = np.argsort(keys, axis=None, kind="stable")
        self.owner = order // max(1, keys.shape[1])
        self.begin = np.searchsorted(keys.ravel()[order], np.arange((keys.shape[1] << block) + 1))

    @staticmethod
    def _pack(prints: np.ndarray) -> np.ndarray:
        raw = np.packbits(prints, axis=1)
        return np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8))).view(U64)

    def _keys(self, prints: np.ndarray) -> np.ndarray:
        """(number and value of every block) of each fingerprint."""
        n = prints.shape[1] // self.block
        values = prints[:, : n * self.block].reshape(-1, n, self.block) @ (1 << np.arange(self.block)).astype(np.int32)
        return values + (np.arange(n, dtype=np.int32) << self.block)

    def candidates(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, fingerprint) index pairs with enough equal blocks."""
        width = len(self.packed)
        if self.need <= 0:
            return np.repeat(np.arange(len(queries)), width), np.tile(np.arange(width), len(queries))
        keys = self._keys(queries)
        found_q, found_p = [], []
        step = max(1, (1 << 22) // max(1, len(self.owner) >> self.block))
        for at in range(0, len(queries), step):
            part = keys[at : at + step]
            lo, n = self.begin[part].ravel(), (self.begin[part + 1] - self.begin[part]).ravel()
            index = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            query = np.repeat(np.repeat(np.arange(len(part)), keys.shape[1]), n)
            equal = np.bincount(query * width + self.owner[index], minlength=len(part) * width)
            hit = np.flatnonzero(equal >= self.need)
            found_q.append(at + hit // max(1, width))
            found_p.append(hit % max(1, width))
        return (np.concatenate(found_q), np.concatenate(found_p)) if found_q else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q, p = self.candidates(queries)
        near = np.bitwise_count(self._pack(queries)[q] ^ self.packed[p]).sum(axis=1, dtype=np.int64) <= self.radius
        return q[near], p[near]


class Benchmark:
    """Items of one block: shingle counts, fingerprints by window size, and an index from shingle to items."""

    def __init__(self, items: list[tuple[int, str]], k: int = WORDS, threshold: float = THRESHOLD):
        self.k, self.ids, self.size, self.shingles = k, [], [], []
        self.short: dict[tuple[int, int], list[int]] = {}
        for item_id, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            words = Words(raw, np.array([0, len(raw)]))
            n = len(words.hash)
            if not n:
                continue
            h, _ = words.shingles(k)
            if n < k:
                self.short.setdefault((n, int(h[0])), []).append(item_id)
                continue
            self.ids.append(item_id)
            self.size.append(n)
            self.shingles.append(h)
        self.counts = [Counter(h.tolist()) for h in self.shingles]
        self.size = np.array(self.size, np.int64)
        pairs = np.array([(x, t) for t, c in enumerate(self.counts) for x in c], dtype=object)
        token = np.array([p[0] for p in pairs], U64) if len(pairs) else np.zeros(0, U64)
        owner = np.array([p[1] for p in pairs], np.int64) if len(pairs) else np.zeros(0, np.int64)
        order = np.argsort(token, kind="stable")
        self.token, self.owner = token[order], owner[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.token >> U64(44)).astype(np.int64)] = True
        prints = np.array([fingerprints(h, len(h))[0] for h in self.shingles]).reshape(-1, BITS)
        self.index = {int(m): (np.flatnonzero(self.size == m), HammingIndex(prints[self.size == m], radius_of(threshold))) for m in np.unique(self.size)}

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, item) for positions whose shingle an item holds."""
        at = np.flatnonzero(self.filter[(hashes >> U64(44)).astype(np.int64)])
        if not len(at) or not len(self.token):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo, hi = np.searchsorted(self.token, hashes[at]), np.searchsorted(self.token, hashes[at], side="right")
        n = hi - lo
        index = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.repeat(at, n), self.owner[index]

    def similarity(self, window: np.ndarray, item: int) -> float:
        mine, theirs = Counter(window.tolist()), self.counts[item]
        both = sum(min(c, theirs.get(x, 0)) for x, c in mine.items())
        return both / (len(window) + len(self.shingles[item]) - both)


def short_leaks(words: Words, bench: Benchmark) -> list[tuple[int, int, int, float]]:
    """Items of under k words: the first window of as many words that is equal, in every document."""
    found: dict[tuple[int, int], int] = {}
    mult = mix(np.arange(11, 11 + bench.k, dtype=U64))
    for n in sorted({n for n, _ in bench.short}):
        m = len(words.hash) - n + 1
        if m < 1:
            continue
        sums = np.full(m, n, U64)
        for j in range(n):
            sums += words.hash[j : j + m] * mult[j]
        hashes = mix(sums)
        wanted = np.array([h for size, h in bench.short if size == n], U64)
        for at in np.flatnonzero(np.isin(hashes, wanted) & (words.doc[:m] == words.doc[n - 1 :])):
            d = int(words.doc[at])
            for item in bench.short[n, int(hashes[at])]:
                found.setdefault((d, item), int(at - words.first[d]))
    return [(d, item, start, 1.0) for (d, item), start in found.items()]


def leaks_in(words: Words, bench: Benchmark, threshold: float, whole: bool = False) -> list[tuple[int, int, int, float]]:
    """(document row, item id, first word, similarity): the best window of each leaked item."""
    counts = np.diff(words.first)
    out = short_leaks(words, bench) if bench.short else []
    k, n = bench.k, len(words.hash)
    if n < k:
        return out
    mult = mix(np.arange(11, 11 + k, dtype=U64))
    m = n - k + 1
    grams = np.zeros(m, U64)
    for j in range(k):
        grams += words.hash[j : j + m] * mult[j]
    grams = mix(grams)
    pos, item = bench.hits(grams)
    keep = words.doc[pos] == words.doc[np.minimum(pos + k - 1, n - 1)]
    pos, item = pos[keep], item[keep]
    if not len(pos):
        return out
    doc, size = words.doc[pos], bench.size[item]
    # Starts of the windows of the item's size that hold the shingle at pos, inside the document.
    lo = np.maximum(words.first[doc], pos + k - size)
    hi = np.minimum(words.first[doc + 1] - size, pos)
    order = np.lexsort((lo, size, doc))
    doc, size, lo, hi = doc[order], size[order], lo[order], hi[order]
    best: dict[tuple[int, int], tuple[float, int]] = {}
    if whole:
        d, t = words.doc[pos], item
        fits = (counts[d] < bench.size[t]) & (counts[d] - k + 1 >= threshold * (bench.size[t] - k + 1) - 1e-9)
        for row, t in np.unique(np.stack([d[fits], t[fits]], axis=1), axis=0).tolist():
            s = bench.similarity(grams[words.first[row] : words.first[row + 1] - k + 1], t)
            if s >= threshold:
                best[row, t] = (s, 0)
    i = 0
    while i < len(doc):
        d, w, a, b = doc[i], size[i], lo[i], hi[i]
        i += 1
        while i < len(doc) and doc[i] == d and size[i] == w and lo[i] <= b + 1:
            b = max(b, hi[i])
            i += 1
        if b < a:
            continue
        members, index = bench.index[int(w)]
        for c in range(a, b + 1, STEP):  # windows of a long region in steps, so memory stays bounded
            e = min(b, c + STEP - 1)
            prints = fingerprints(grams[c : e + w - k + 1], int(w) - k + 1)
            for q, p in zip(*index.search(prints), strict=True):
                t, start = int(members[p]), int(c + q)
                s = bench.similarity(grams[start : start + w - k + 1], t)
                old = best.get((int(d), t))
                if s >= threshold and (old is None or s > old[0]):
                    best[int(d), t] = (s, start - int(words.first[d]))
    out += [(d, bench.ids[t], start, s) for (d, t), (s, start) in best.items()]
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = WORDS, threshold: float = THRESHOLD, block_items: int = 5000, whole: bool = False) -> DataFrame:
    """doc_id, item_id, first_word, similarity for every leaked item of every document.

    Null or empty texts and items leak nothing. Rows with equal ids are reported each; of tied windows the first
    is given. Other columns of either table are ignored. With `whole`, a document of fewer words than an item is its
    one window; without, it cannot leak that item.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = None
    for shipped in _blocks(benchmark, block_items):
        found = docs.select("doc_id", "text").mapInArrow(tidy(_scan(shipped, k, threshold, whole)), f"doc_id {kind}, item_id long, first_word long, similarity double")
        out = found if out is None else out.unionAll(found)
    return out


def _blocks(benchmark: DataFrame, block_items: int) -> Iterator:
    """Broadcasts of at most about block_items items each."""
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    blocks = max(1, -(-items.count() // block_items))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield benchmark.sparkSession.sparkContext.broadcast(sorted((r.item_id, r.text) for r in part.collect()))


def without_leaks(docs: DataFrame, benchmark: DataFrame, k: int = WORDS, threshold: float = THRESHOLD, block_items: int = 5000, whole: bool = False) -> DataFrame:
    """The rows of docs that leak no item, all columns as they are; one filtering pass per block, no join."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    for shipped in _blocks(benchmark, block_items):
        docs = docs.mapInArrow(tidy(_filter(shipped, k, threshold, whole)), kinds)
    return docs


def _filter(shipped, k: int, threshold: float, whole: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(shipped.value, k, threshold)
        for batch in batches:
            data, offsets = buffers(batch.column(batch.schema.get_field_index("text")))
            keep = np.ones(batch.num_rows, bool)
            for lo, hi in slices(offsets):
                words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                keep[[lo + d for d, *_ in leaks_in(words, bench, threshold, whole)]] = False
            yield batch.filter(pa.array(keep))

    return run


def _scan(shipped, k: int, threshold: float, whole: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(shipped.value, k, threshold)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for lo, hi in slices(offsets):
                found = leaks_in(Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), bench, threshold, whole)
                if found:
                    row, item, start, s = zip(*sorted(found), strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(row) + lo)), pa.array(item, pa.int64()), pa.array(start, pa.int64()), pa.array(s, pa.float64())], names=["doc_id", "item_id", "first_word", "similarity"])

    return run


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), whole=True)
