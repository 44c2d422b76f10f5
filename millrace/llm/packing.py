"""Packing by minimum bin slack.

A document is cut into whole windows and one remainder. Remainders of a task share a pool of
lengths; a bitset subset-sum dynamic program over the multiset of lengths (binary-split counts) finds
the fill of each window closest to its capacity, always with the longest piece that is left, and
backtracking gives how many pieces of each length it takes. Windows with slack wait until the task's
input ends; then a piece is cut to close the gap, and what is left goes into sequences whose length is
a power of two, which need no padding.

Scale: no shuffle. Every task packs what it reads, with a pool of at most `pool` remainders.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import table, tidy
from .tokens import tokenizer, vocabulary

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Pieces (length -> how many), the longest included, whose sum is closest to capacity from below."""
    longest = max((n for n in counts if n <= capacity), default=0)
    if not longest:
        return {}
    room = capacity - longest
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, k = min(counts[length] - (length == longest), room // length), 1
        while left > 0 and not reach >> room & 1:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    target = reach.bit_length() - 1
    fill = {longest: 1}
    for length, k, before in reversed(steps):
        if not before >> target & 1:
            fill[length] = fill.get(length, 0) + k
            target -= length * k
    return fill


class Packer:
    """Gathers pieces (ids, doc_id, start, doc_tokens) and emits output rows."""

    def __init__(self, capacity: int, first_sequence: int, pool: int = 4096):
        self.capacity, self.pool, self.next = capacity, pool, first_sequence
        self.by_length: dict[int, list] = {}
        self.held = 0
        self.rows: list[tuple] = []

    def _emit(self, pieces: list) -> None:
        offset = 0
        for ids, doc_id, start, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, cap = len(ids), self.capacity
        whole = total - total % cap
        for start in range(0, whole, cap):
            self._emit([(ids[start : start + cap], doc_id, start, total)])
        if whole < total:
            self._hold((ids[whole:].copy(), doc_id, whole, total))
            if self.held >= self.pool:
                self._exact()

    def _hold(self, piece) -> None:
        self.by_length.setdefault(len(piece[0]), []).append(piece)
        self.held += 1

    def _take(self, fill: dict[int, int]) -> list:
        out = []
        for length, k in fill.items():
            for _ in range(k):
                out.append(self.by_length[length].pop())
            if not self.by_length[length]:
                del self.by_length[length]
        self.held -= len(out)
        return out

    def _exact(self) -> None:
        """Close windows until half of the pool is left, or none fills exactly any more."""
        while self.held > self.pool // 2:
            fill = best_fill({n: len(x) for n, x in self.by_length.items()}, self.capacity)
            pieces = self._take(fill)
            slack = self.capacity - sum(len(p[0]) for p in pieces)
            if slack:
                pieces += self._cut(slack)
            self._emit(pieces)

    def _cut(self, size: int) -> list:
        """Exactly `size` ids (fewer only if no more are held), cutting the last piece taken."""
        out = []
        while size and self.by_length:
            shorter = [n for n in self.by_length if n <= size]
            length = max(shorter) if shorter else min(self.by_length)
            ids, doc_id, start, total = self._take({length: 1})[0]
            out.append((ids[:size], doc_id, start, total))
            if len(ids) > size:
                self._hold((ids[size:], doc_id, start + size, total))
            size -= min(size, len(ids))
        return out

    def finish(self) -> None:
        left = sum(n * len(x) for n, x in self.by_length.items())
        while left >= self.capacity:
            pieces = self._take(best_fill({n: len(x) for n, x in self.by_length.items()}, self.capacity))
            slack = self.capacity - sum(len(p[0]) for p in pieces)
            pieces += self._cut(slack) if slack else []
            self._emit(pieces)
            left -= self.capacity
        while left:
            size = 1 << (left.bit_length() - 1)
            self._emit(self._cut(size))
            left -= size

    def drain(self) -> pa.RecordBatch | None:
        rows, self.rows = self.rows, []
        if not rows:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, vocab: str = "byte_bpe_50k.json", kind: str = "byte", end_id: int = 0, capacity: int = 1024) -> DataFrame:
    """Pieces of all documents (doc_id, text) with their place in sequences of at most `capacity` ids.

    A null text is empty (one piece: the end id). Null and repeated ids are packed like others; other
    columns are ignored; an empty table gives no rows.
    """
    path = vocabulary(vocab)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, kind)
        packer = Packer(capacity, TaskContext.get().partitionId() << 36)
        end = np.array([end_id], np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), tok.encode(texts), strict=True):
                    packer.add(doc_id, np.concatenate([ids.astype(np.int64), end]).astype(np.uint32))
            if (out := packer.drain()) is not None:
                yield out
        packer.finish()
        if (out := packer.drain()) is not None:
            yield out

    return docs.select("doc_id", "text").mapInArrow(tidy(run, keep=True), SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
