"""Suffix-array dedup: remove every byte covered by a `length`-byte string that also starts elsewhere.

1. Anchors. Every window of `length` bytes has an anchor, the k-byte gram in it with the smallest hash
   (leftmost if tied). Equal windows have equal anchors at equal places, so only occurrences of one anchor
   need to be compared. Windows that share an anchor are one run of starts; a run's context is all bytes its
   windows cover. Runs travel as packed arrays of hashes.
2. Equal contexts are one, which is repeated throughout if several runs have it; a task settles the copies that it
   meets in a slice of texts and sends one run for them, so a large group of copies meets nowhere. Where an anchor has
   different contexts, one text of each goes to a shard, and the shard's suffix array, built by induced sorting, with
   permuted common prefixes shows which starts share `length` bytes with another suffix.
3. An anchor with more than `MAX_CONTEXTS` different contexts (a phrase that very many documents hold) would
   not fit one shard; its windows are compared by 64-bit hash instead, spread over all tasks.

All decisions are made on the input; nothing is capped. Scale: the shuffles are one row of hashes per about
170 bytes, the texts twice (to meet their decisions), and the differing contexts of repeated anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, dealt, partitions, release, table
from .suffix import permuted_common_prefixes, suffix_array
from .textops import U64, buffers, mix, powers, rolling, slices

LENGTH = 400
GRAM = 64
MAX_CONTEXTS = 256
SHARD_BYTES = 1 << 17
_LOW = U64((1 << 23) - 1)


def window_hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """Hash of every `size`-byte window."""
    n = len(sums) - size
    if n <= 0:
        return np.zeros(0, U64)
    _, inv = powers(len(sums))
    return mix((sums[size:] - sums[:n]) * inv[:n] + U64(size))


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = powers(len(sums))
    return (sums[end] - sums[start]) * inv[start] + (end - start).astype(U64) * U64(0xA24BAED4963EE407)


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one anchor: (row, first start, last start, anchor hash, context hash), starts in the slice."""
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64))
    if len(data) < length:
        return empty
    sums = rolling(data)
    hashes = window_hashes(sums, gram)
    key = (hashes & ~_LOW) | np.arange(len(hashes), dtype=U64)
    width = length - gram + 1
    best, have = key, 1
    while have * 2 <= width:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if have < width:
        rest = width - have
        best = np.minimum(best[: len(best) - rest], best[rest:])
    anchor = (best & _LOW).astype(np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    start = np.flatnonzero(np.arange(len(anchor)) + length <= ends[: len(anchor)])
    if not len(start):
        return empty
    anchor = anchor[start]
    begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    first, last, at = start[begin], start[np.append(begin[1:], len(start)) - 1], anchor[begin]
    context = mix(spans_hash(sums, first, last + length) + mix((at - first).astype(U64)))
    row = np.searchsorted(offsets, first, side="right") - 1
    return row, first, last, hashes[at], context


def _slices(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, offsets = buffers(column)
    for lo, hi in slices(offsets, 1 << 21):
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """runs() of a slice; a single text longer than the position field is cut into overlapping parts."""
    step = 1 << 22
    if len(data) <= step + length or len(offsets) > 2:
        yield runs(data, offsets, length, gram)
        return
    for at in range(0, len(data), step):
        part = data[at : at + step + length - 1]
        row, first, last, anchor, context = runs(part, np.array([0, len(part)]), length, gram)
        yield row, first + at, last + at, anchor, context


FULL, CHECK, BOTH, HOT, HOT_BOTH = 1, 2, 3, 4, 5
TWICE = 1 << 15  # added to the size of a run (at most length - gram) or of a window hash that speaks for copies


def decisions(texts: DataFrame, length: int, gram: int, max_contexts: int) -> DataFrame:
    """texts (key, text) -> key, first, size, anchor, state of every run whose anchor occurs more than once."""
    n_buckets = partitions(texts.sparkSession)

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, data, offsets in _slices(batch.column(1)):
                rows = []
                for row, first, last, anchor, context in _pieces(data, offsets, length, gram):
                    key, first, size = keys[lo + row], first - offsets[row], last - first
                    order = np.lexsort((first, key, context, anchor))
                    again = np.zeros(len(order), bool)
                    again[1:] = (anchor[order[1:]] == anchor[order[:-1]]) & (context[order[1:]] == context[order[:-1]])
                    size[order[:-1][again[1:] & ~again[:-1]]] += TWICE  # the first of copies speaks for them
                    known, order = order[again], order[~again]
                    if len(known):
                        b = int(mix(key[known[:1]].view(U64))[0] % U64(n_buckets))
                        rows.append((b, b"", b"", key[known].tobytes(), first[known].astype("<u4").tobytes(), size[known].astype("<u2").tobytes()))
                    bucket = (anchor >> U64(20)) % U64(n_buckets)
                    order = order[np.argsort(bucket[order], kind="stable")]
                    cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1, dtype=U64))
                    for b in np.flatnonzero(np.diff(cuts)):
                        o = order[cuts[b] : cuts[b + 1]]
                        rows.append((int(b), anchor[o].tobytes(), context[o].tobytes(), key[o].tobytes(), first[o].astype("<u4").tobytes(), size[o].astype("<u2").tobytes()))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "anchor", "context", "key", "first", "size"])

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[] for _ in range(5)]
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
                columns = [np.frombuffer(x, kind) for x, kind in zip(row, (U64, U64, np.int64, "<u4", "<u2"), strict=True)]
                if row[0]:
                    for part, column in zip(parts, columns, strict=True):
                        part.append(column)
                else:  # settled where they were met
                    yield rows_of(columns[2], columns[3], columns[4] % TWICE, np.zeros(len(columns[2]), U64), np.full(len(columns[2]), FULL))
        if not parts[0]:
            return
        anchor, context, key, first, size = (np.concatenate(p) for p in parts)
        twice, size = size // TWICE, size % TWICE
        order = np.argsort(anchor, kind="stable")
        a = anchor[order]
        same = np.concatenate([[False], a[1:] == a[:-1]])
        many = same | (twice[order] > 0)
        many[:-1] |= same[1:]
        order = order[many]
        if not len(order):
            return
        order = order[np.lexsort((first[order], key[order], context[order], anchor[order]))]
        anchor, context, key, first, size, twice = anchor[order], context[order], key[order], first[order], size[order], twice[order]
        new_a = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        new_c = new_a | np.concatenate([[True], context[1:] != context[:-1]])
        group, cell = np.cumsum(new_a) - 1, np.cumsum(new_c) - 1
        contexts = np.bincount(group[new_c], minlength=group[-1] + 1)[group]
        copies = np.bincount(cell, weights=1 + twice)[cell]
        state = np.where(copies > 1, FULL, 0)
        speaks = new_c & (contexts > 1)
        state[speaks] += np.where(contexts[speaks] > max_contexts, HOT, CHECK)
        keep = state > 0
        for lo in range(0, len(state), 50_000):
            k = np.flatnonzero(keep[lo : lo + 50_000]) + lo
            yield rows_of(key[k], first[k], size[k], anchor[k], state[k])

    def rows_of(key, first, size, anchor, state) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(first.astype(np.int64)), pa.array(size.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(state.astype(np.int32))], names=["key", "first", "size", "anchor", "state"])

    posted = texts.select("key", "text").mapInArrow(post, "bucket int, anchor binary, context binary, key binary, first binary, size binary")
    return dealt(posted).mapInArrow(decide, "key long, first long, size int, anchor long, state int")


def shard_marks(contexts: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """contexts (key, first, anchor, context) -> key, first, size: runs of starts repeated in another place."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        total, last = 0, None

        def close() -> pa.RecordBatch | None:
            if not held:
                return None
            data = np.frombuffer(b"\xff".join(h[2] for h in held), np.uint8)  # no UTF-8 text holds this byte
            sa = suffix_array(data)
            sizes = np.array([len(h[2]) for h in held])
            begins = np.concatenate([[0], np.cumsum(sizes + 1)])
            window = np.zeros(begins[-1] + 1, np.int8)  # 1 where a whole window starts; others reach over a separator
            window[begins[:-1]] += 1
            window[begins[:-1] + np.maximum(sizes - length + 1, 0)] -= 1
            window = np.cumsum(window, dtype=np.int8)[: len(data)] > 0
            phi, plcp = permuted_common_prefixes(data, sa)
            hit = (plcp >= length) & window
            hit[phi[hit]] = True
            at = np.flatnonzero(hit)
            which = np.searchsorted(begins, at, side="right") - 1
            starts = at - begins[which]
            edge = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(which) != 0)])) if len(at) else np.zeros(0, int)
            ends = np.append(edge[1:], len(at)) - 1 if len(at) else edge
            if not len(edge):
                return None
            w = which[edge]
            return pa.RecordBatch.from_arrays([pa.array([held[i][0] for i in w], pa.int64()), pa.array(np.array([held[i][1] for i in w], np.int64) + starts[edge]), pa.array((starts[ends] - starts[edge]).astype(np.int32))], names=["key", "first", "size"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for anchor, key, first, context in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    if anchor != last and total >= shard_bytes:
                        if (out := close()) is not None:
                            yield out
                        held, total = [], 0
                    last = anchor
                    held.append((key, first, context))
                    total += len(context) + 1
        if (out := close()) is not None:
            yield out

    ordered = contexts.select("anchor", "key", "first", "context").repartition(partitions(contexts.sparkSession), "anchor").sortWithinPartitions("anchor", "key", "first")
    return ordered.mapInArrow(run, "key long, first long, size int")


def hash_marks(texts: DataFrame, length: int) -> DataFrame:
    """texts (key, text, runs array<struct<first,size>>) -> key, first, size: starts whose window occurs twice among them."""
    n_buckets = partitions(texts.sparkSession)

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list] = [[], [], []]
            held = 0
            for i in range(batch.num_rows):
                key, text, spans = (batch.column(c)[i].as_py() for c in range(3))
                data = np.frombuffer((text or "").encode(), np.uint8)
                for x in spans:
                    part = data[x["first"] : x["first"] + x["size"] + length]
                    h = window_hashes(rolling(part), length)
                    parts[0].append(h)
                    parts[1].append(np.full(len(h), key, np.int64))
                    parts[2].append(x["first"] + np.arange(len(h), dtype=np.int64))
                    held += len(h)
                if held > 1 << 20:
                    yield pack(parts)
                    parts, held = [[], [], []], 0
            if held:
                yield pack(parts)

    def pack(parts: list[list]) -> pa.RecordBatch:
        h, key, first = (np.concatenate(p) for p in parts)
        order = np.argsort(h, kind="stable")
        again = np.zeros(len(order), bool)
        again[1:] = h[order[1:]] == h[order[:-1]]
        speaks = np.zeros(len(h), np.uint8)
        speaks[order[:-1][again[1:] & ~again[:-1]]] = 1
        known, order = order[again], order[~again]
        rows = [(int(mix(key[known[:1]].view(U64))[0] % U64(n_buckets)), b"", key[known].tobytes(), first[known].astype("<u4").tobytes(), b"")] if len(known) else []
        bucket = (h >> U64(20)) % U64(n_buckets)
        order = order[np.argsort(bucket[order], kind="stable")]
        cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1, dtype=U64))
        rows += [(int(b), h[o].tobytes(), key[o].tobytes(), first[o].astype("<u4").tobytes(), speaks[o].tobytes()) for b in np.flatnonzero(np.diff(cuts)) for o in [order[cuts[b] : cuts[b + 1]]]]
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "h", "key", "first", "speaks"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                columns = [np.frombuffer(x, kind) for x, kind in zip(row, (U64, np.int64, "<u4", np.uint8), strict=True)]
                if row[0]:
                    for part, column in zip(parts, columns, strict=True):
                        part.append(column)
                else:
                    yield rows_of(columns[1], columns[2])
        if not parts[0]:
            return
        h, key, first, speaks = (np.concatenate(p) for p in parts)
        _, inverse = np.unique(h, return_inverse=True)
        k = np.flatnonzero(np.bincount(inverse, weights=1 + speaks.astype(np.int64))[inverse] > 1)
        for lo in range(0, len(k), 50_000):
            o = k[lo : lo + 50_000]
            yield rows_of(key[o], first[o])

    def rows_of(key, first) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(first.astype(np.int64)), pa.array(np.zeros(len(key), np.int32))], names=["key", "first", "size"])

    posted = texts.select("key", "text", "runs").mapInArrow(post, "bucket int, h binary, key binary, first binary, speaks binary")
    return dealt(posted).mapInArrow(meet, "key long, first long, size int")


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, max_contexts: int = MAX_CONTEXTS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """texts (key, text) -> key, first, size: windows first..first+size of `length` bytes occur elsewhere too."""
    found = cut(decisions(texts, length, gram, max_contexts))
    full = found.where(F.col("state").isin(FULL, BOTH, HOT_BOTH)).select("key", "first", "size")
    ask = found.where("state > 1").groupBy("key").agg(F.collect_list(F.when(F.col("state") < HOT, F.struct("first", "size", "anchor"))).alias("check"), F.collect_list(F.when(F.col("state") >= HOT, F.struct("first", "size"))).alias("hot"))
    both = texts.select("key", "text").join(ask, "key").dropDuplicates(["key"])

    def contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, spans = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                if spans:
                    raw = (batch.column(1)[i].as_py() or "").encode()
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(spans), pa.int64()), pa.array([x["first"] for x in spans], pa.int64()), pa.array([x["anchor"] for x in spans], pa.int64()), pa.array([raw[x["first"] : x["first"] + x["size"] + length] for x in spans], pa.binary())], names=["key", "first", "anchor", "context"])

    checked = shard_marks(both.select("key", "text", "check").mapInArrow(contexts, "key long, first long, anchor long, context binary"), length, shard_bytes)
    marks = full.unionAll(cut(checked))
    del checked
    release(texts.sparkSession)
    if found.where(F.col("state") >= HOT).limit(1).count():
        marks = marks.unionAll(cut(hash_marks(both.where(F.size("hot") > 0).select("key", "text", F.col("hot").alias("runs")), length)))
    del both
    release(texts.sparkSession)
    return marks


def remove_repeats(docs: DataFrame, length: int = LENGTH, **settings) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256.

    A null text is empty. Rows that are equal in id and text are copies of each other like any others. The
    kept bytes are those of the input, so they need not be valid UTF-8 where a removed run cuts a character.
    """
    texts = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    marks = repeated_spans(texts, length, **settings).groupBy("key").agg(F.collect_list(F.struct("first", "size")).alias("marks"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for doc_id, text, spans in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    raw = (text or "").encode()
                    kept, removed, n, at = [], 0, 0, 0
                    end = 0
                    for first, size in sorted((x["first"], x["size"]) for x in spans or ()):
                        if first > end or n == 0:
                            kept.append(raw[at:first])
                            n += 1
                            end = at = first
                        stop = first + size + length
                        if stop > end:
                            removed += stop - end
                            end = at = stop
                    kept.append(raw[at:])
                    left = b"".join(kept)
                    rows.append((doc_id, len(raw), removed, n, left, hashlib.sha256(left).hexdigest()))
                cols = list(zip(*rows, strict=True))
                types = [part.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return texts.join(marks, "key", "left").select("doc_id", "text", "marks").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept").withColumn("has_repeats", F.col("n_removed") > 0)
