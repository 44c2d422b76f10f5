"""Classes of near copies by min-hash signatures: who speaks for whom when documents vote.

A text's signature holds the smallest of PLACES hashes of its five-word shingles, so two texts agree in a place with a
probability of their Jaccard similarity. Texts that agree on a whole band of places meet; those whose signatures agree
in at least AGREE places are candidates, with the smallest key of the band and with their neighbour in it. A candidate is a link
if the texts share 75 % of their shingles. Sketches tell what is clear: BINS bins of the shingles by hash, each with a byte of its smallest, agree in a share of the
bins that either text fills which comes within three standard deviations of the similarity. Pairs between CLEAR_NOT and CLEAR are decided by their sets of shingles, those alone. Classes are the components of the links.

A text of similarity 0.75 meets a copy in one of ten bands with a probability of 99.6 % and agrees in 18 of 30 places with one of 97.8 %, for every copy anew, and a
class is held together by many links; links below the threshold do not pass, so classes do not chain.

The candidates are an estimate, for votes only; the near-duplicate operator is exact. Scale: one pass over the texts, which leaves ten rows of
46 bytes and a sketch of BINS bytes for a text in the shared folder. A task links the copies that it meets in a slice itself and sends one row for them, so a large
group of copies does not meet in one bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.graph import connected_components

from .common import cut, dealt, fresh_path, partitions, tidy
from .jaccard import forest
from .textops import U64, Words, buffers, mix, slices

PLACES, BAND, AGREE = 30, 3, 18
BINS, CLEAR_NOT, CLEAR, PERCENT = 256, 0.66, 0.83, 75
_ODD = mix(np.arange(101, 101 + PLACES, dtype=U64)) | U64(1)


def signatures(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, signatures) of the texts that have shingles; h and doc are sorted by doc."""
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, int)
    out = np.empty((len(begin), PLACES), np.uint32)
    if len(begin):
        for j, odd in enumerate(_ODD):
            out[:, j] = np.minimum.reduceat(((h ^ (odd >> U64(7))) * odd >> U64(32)).astype(np.uint32), begin)
    return doc[begin], out


def sketches(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Bytes of the smallest hash of each bin (0: none) of the texts that have shingles, in the order of signatures()."""
    text = np.cumsum(np.concatenate([[False], doc[1:] != doc[:-1]])) if len(doc) else doc
    out = np.zeros((int(text[-1]) + 1 if len(doc) else 0, BINS), np.uint8)
    for lo in range(0, len(out), 1 << 15):  # place and hash in one number, so one sort finds the smallest
        a, b = np.searchsorted(text, [lo, lo + (1 << 15)])
        value = (text[a:b] - lo).astype(U64) << U64(48) | h[a:b] >> U64(16)
        value.sort()
        place = value >> U64(40)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(value) else np.zeros(0, int)
        out.reshape(-1)[lo * BINS + place[first].astype(np.int64)] = (mix(value[first] & U64((1 << 40) - 1)) % U64(255) + U64(1)).astype(np.uint8)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the bins that either sketch fills in which both agree."""
    return ((a == b) & (a > 0)).sum(axis=1) / np.maximum(((a | b) > 0).sum(axis=1), 1)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (distinct, sorted) share PERCENT of their union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def sets_of(h: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Distinct shingles of each text that has any, in the order of signatures()."""
    edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if len(doc) else np.zeros(1, int)
    return [np.unique(h[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def linked(band: np.ndarray, key: np.ndarray, sig: np.ndarray, verified: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, rows that still speak): candidates of each row with the first and the previous row of its band, links where `verified` tells them from rows.

    A row that is linked with the first of its band is spoken for by it.
    """
    order = np.lexsort((key, band))
    value, k, s = band[order], key[order], sig[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = value[1:] != value[:-1]
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    rest = np.flatnonzero(~fresh)

    def agree(to: np.ndarray) -> np.ndarray:
        good = (s[rest] == s[to]).sum(axis=1) >= AGREE
        if verified is not None:
            at = np.flatnonzero(good)
            good[at] = verified(order[rest[at]], order[to[at]])
        return good

    to_first, to_previous = agree(first[rest]), agree(rest - 1)
    a = np.concatenate([k[rest[to_first]], k[rest[to_previous]]])
    b = np.concatenate([k[first[rest[to_first]]], k[rest[to_previous] - 1]])
    speaks = np.ones(len(order), bool)
    speaks[rest[to_first]] = False
    differ = a != b
    return a[differ], b[differ], order[speaks]


def near_copies(texts: DataFrame, k: int = 5) -> DataFrame:
    """texts (key long, text) -> node, root for the texts that have near copies: root is the smallest key of the class.

    Null and wordless texts have no copies. Rows with equal keys are one text.
    """
    n_buckets = partitions(texts.sparkSession)

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = buffers(batch.column(1))
            for lo, hi in slices(offsets):
                h, d = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]).shingles(k)
                rows, sig = signatures(h, d)
                if not len(rows):
                    continue
                key, short, sketch = keys[lo + rows], (sig & np.uint32(255)).astype(np.uint8), sketches(h, d)
                own = (-1, b"", key.tobytes(), sketch.tobytes())
                held: dict[int, np.ndarray] = {}
                edge = np.append(np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])), len(d))

                def verified(a: np.ndarray, b: np.ndarray, sketch=sketch, held=held, edge=edge, h=h) -> np.ndarray:
                    share = likeness(sketch[a], sketch[b])
                    out = share >= CLEAR
                    for i in np.flatnonzero((share >= CLEAR_NOT) & ~out).tolist():
                        for row in (int(a[i]), int(b[i])):
                            if row not in held:
                                held[row] = np.unique(h[edge[row] : edge[row + 1]])
                        out[i] = similar(held[int(a[i])], held[int(b[i])])
                    return out

                links_a, links_b, parts = [], [], []
                for j in range(0, PLACES, BAND):
                    band = np.full(len(rows), j + 1, U64)
                    for i in range(j, j + BAND):
                        band = mix(band + sig[:, i].astype(U64))
                    a, b, speaks = linked(band, key, short, verified)
                    links_a.append(a)
                    links_b.append(b)
                    parts.append((band[speaks], key[speaks], short[speaks]))
                band, key, short = (np.concatenate(x) for x in zip(*parts, strict=True))
                bucket = (band >> U64(8)) % U64(n_buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1, dtype=U64))
                out = [(int(x), band[o].tobytes(), key[o].tobytes(), short[o].tobytes()) for x in np.flatnonzero(np.diff(cuts)) for o in [order[cuts[x] : cuts[x + 1]]]]
                a, b = forest(np.concatenate(links_a), np.concatenate(links_b))
                if len(a):  # links need no more than to be passed on
                    out.append((-2, b"", a.tobytes(), b.tobytes()))
                cols = list(zip(*out, own, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "band", "key", "signature"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], [], []]
        for batch in batches:
            for band, key, short in zip(*(batch.column(i).to_pylist() for i in range(1, 4)), strict=True):
                parts[0].append(np.frombuffer(band, U64))
                parts[1].append(np.frombuffer(key, np.int64))
                parts[2].append(np.frombuffer(short, np.uint8).reshape(-1, PLACES))
        if not parts[0]:
            return
        a, b, _ = linked(*(np.concatenate(p) for p in parts))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        yield from _pairs(pairs[:, 0], pairs[:, 1])

    def unpack(width: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for key, value in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                    k = np.frombuffer(key, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(k), [None, pa.py_buffer(value)]).cast(pa.binary())], names=["key", "value"])

        return run

    def known(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                yield from _pairs(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64))

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(likeness(one, other))], names=["a", "b", "share"])

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for lo, hi in slices(offsets):
                h, d = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]).shingles(k)
                rows = np.unique(d)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + rows)), pa.array([x.tobytes() for x in sets_of(h, d)], pa.binary())], names=["key", "value"])

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def beside(pairs: DataFrame, values: DataFrame) -> DataFrame:
        """pairs (a, b) with the values (key, value) of both."""
        one, other = values.select(F.col("key").alias("a"), F.col("value").alias("one")), values.select(F.col("key").alias("b"), F.col("value").alias("other"))
        return pairs.select("a", "b").join(one.hint("merge"), "a").join(other.hint("merge"), "b").select("a", "b", "one", "other")

    def only(values: DataFrame, pairs: DataFrame) -> DataFrame:
        needed = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
        return values.join(needed.hint("merge"), "key", "left_semi")

    path = fresh_path(texts.sparkSession, "copies")
    schema = "bucket int, band binary, key binary, signature binary"
    texts.select("key", "text").mapInArrow(tidy(post), schema).write.parquet(path)
    posted = texts.sparkSession.read.schema(schema).parquet(path)
    maybe = cut(dealt(posted.where("bucket >= 0")).mapInArrow(tidy(meet), "a long, b long").distinct())
    sketch = posted.where("bucket = -1").select("key", "signature").mapInArrow(tidy(unpack(BINS)), "key long, value binary").dropDuplicates(["key"])
    weighed = cut(beside(maybe, cut(only(sketch, maybe))).mapInArrow(tidy(weigh), "a long, b long, share double"))
    unclear = cut(weighed.where((F.col("share") >= CLEAR_NOT) & (F.col("share") < CLEAR)).select("a", "b"))
    sets = cut(only(texts.select("key", "text"), unclear).mapInArrow(tidy(gather), "key long, value binary").dropDuplicates(["key"]))
    links = weighed.where(F.col("share") >= CLEAR).select("a", "b").union(beside(unclear, sets).mapInArrow(tidy(decide), "a long, b long"))
    sure = posted.where("bucket = -2").select("key", "signature").mapInArrow(tidy(known), "a long, b long")
    return connected_components(links.union(sure))


def _pairs(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[lo : lo + 100_000]), pa.array(b[lo : lo + 100_000])], names=["a", "b"])
