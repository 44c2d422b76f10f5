"""N-gram Jaccard join with a token-group matrix.

Exact classes of linked documents: two documents link when the Jaccard similarity of their sets of
5-word shingles is at least `percent` hundredths.

1. Every text becomes a set of 64-bit shingle hashes; documents with equal sets are one class.
2. Shared shingles. All shingles of the classes are dealt out, packed, by hash; those that a single class holds
   cannot be shared and stay behind, the others go back to their classes with their frequency. The
   union of all other sets bounds a class's overlap: a class that keeps fewer shingles than its required overlap
   links with nothing.
3. Candidate graph. The remaining classes post a prefix of what they share, rarest first; two sets that link
   have a shingle of their prefixes in common. Size and overlap filters thin the posting lists, and
   long lists give a chain of edges, never all pairs. No link leaves a component of this graph.
4. Token-group matrix. The sets of a candidate component meet in one cell: similar sets form groups,
   each group keeps the union of its tokens, a query's overlap with every union bounds its similarity
   to all members, and only groups that can qualify are opened. Members that are already joined to the query
   are not compared again.
5. A component that is too large for a cell is split into blocks. Each block is joined with itself and with a
   few hub sets; documents that are then not in the component's main class are compared, as queries, with every
   block. So nothing is capped, and no task holds more than a block and a share of the queries.

Scale: texts never move. The shuffles are all shingles once (about six bytes each), the shared ones twice, and
narrow rows of ids. Nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.graph import connected_components

from .common import cut, dealt, partitions, release, table, tidy
from .textops import U64, Words, buffers, distinct_per_doc, mix, slices

PERCENT = 75
WORDS = 5
CELL_SETS = 2048
CELL_TOKENS = 1 << 21
HUBS = 4
QUERY_CHUNK = 256


def _sets(column, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, tokens, offsets, class) for slices of texts; the class of an empty set is 0."""
    data, offsets = buffers(column)
    for lo, hi in slices(offsets):
        words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        h, d = words.shingles(k)
        tokens, first = distinct_per_doc(h, d, hi - lo)
        sums = np.concatenate([[U64(0)], np.cumsum(mix(tokens), dtype=U64)])
        n = np.diff(first)
        cls = mix((sums[first[1:]] - sums[first[:-1]]) * U64(0x9E3779B97F4A7C15) + n.astype(U64))
        cls[n == 0] = 0
        yield lo, tokens, first, cls


def shingle_classes(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, cls (0 for the empty set) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, first, cls in _sets(batch.column(1), k):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(cls)).cast(pa.int64()), pa.array(np.diff(first).astype(np.int64)), pa.array(cls.view(np.int64))], names=["doc_id", "n_shingles", "cls"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, cls long")


def needed(n: np.ndarray, part: int, whole: int) -> np.ndarray:
    return -(-n * part // whole)


DEALT = "bucket int, low binary, high binary, cls binary, n binary, count binary"


def _deal(bucket: np.ndarray, cls_row: np.ndarray, columns: list[np.ndarray], cls: np.ndarray, n: np.ndarray, n_buckets: int) -> list[tuple]:
    """Rows (bucket, packed columns..., class, set size, count of each class) of entries sorted by bucket and class row."""
    order = np.lexsort((cls_row, bucket))
    bucket, cls_row = bucket[order], cls_row[order]
    columns = [c[order] for c in columns]
    cuts = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=bucket.dtype))
    rows = []
    for b in np.flatnonzero(np.diff(cuts)):
        lo, hi = cuts[b], cuts[b + 1]
        begin = np.flatnonzero(np.concatenate([[True], cls_row[lo + 1 : hi] != cls_row[lo : hi - 1]]))
        used = cls_row[lo + begin]
        count = np.diff(np.append(begin, hi - lo))
        rows.append((int(b), *(c[lo:hi].tobytes() for c in columns), cls[used].tobytes(), _narrow(n[used]), _narrow(count)))
    return rows


def _dealt_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(x, pa.binary()) for x in cols[1:])], names=["bucket", "low", "high", "cls", "n", "count"])


def shared_sets(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """cls, n, tokens of the classes that share at least their required overlap with other classes.

    tokens (uint64) are the shared shingles only, rarest first; a token is 40 bits of its shingle's hash and the bucket it
    was dealt to, which is enough to tell any two shingles of two sets apart.
    """
    n_buckets = partitions(docs.sparkSession)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, tokens, first, cls in _sets(batch.column(0), k):
                n = np.diff(first)
                one = np.zeros(len(n), bool)
                one[np.unique(cls, return_index=True)[1]] = True
                one &= n > 0
                tokens = tokens[np.repeat(one, n)]
                n, cls = n[one], cls[one]
                if not len(n):
                    continue
                mixed = mix(tokens)
                rows = _deal((mixed >> U64(40)) % U64(n_buckets), np.repeat(np.arange(len(n)), n), [mixed.astype("<u4"), (mixed >> U64(32)).astype(np.uint8)], cls, n, n_buckets)
                yield _dealt_batch(rows)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        at = 0
        for batch in batches:
            for bucket, low, high, cls, n, c in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                cls = np.frombuffer(cls, U64)
                c = _wide(c, len(cls))
                parts[0].append(np.frombuffer(low, "<u4").astype(U64) | np.frombuffer(high, np.uint8).astype(U64) << U64(32) | U64(bucket) << U64(40))
                parts[1].append(np.repeat(np.arange(at, at + len(c), dtype=np.int32), c))
                parts[2].append(cls)
                parts[3].append(_wide(n, len(cls)))
                at += len(c)
        if not at:
            return
        all_cls, place = np.unique(np.concatenate(parts[2]), return_inverse=True)
        size = np.zeros(len(all_cls), np.int64)
        size[place] = np.concatenate(parts[3])
        token, row = np.concatenate(parts[0]), place.astype(np.int32)[np.concatenate(parts[1])]
        del parts, place
        target = (mix(all_cls) >> U64(20)) % U64(n_buckets)
        for r in range(4):  # a quarter at a time, which bounds the memory of the sorts
            pick = np.flatnonzero((token & U64(3)) == r)
            t, d = token[pick], row[pick]
            order = np.lexsort((d, t))
            t, d = t[order], d[order]
            fresh = np.ones(len(t), bool)
            fresh[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
            t, d = t[fresh], d[fresh]
            begin = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, int)
            df = np.diff(np.append(begin, len(t)))
            df = np.repeat(df, df)
            keep = df > 1
            t, d, df = t[keep], d[keep], df[keep]
            if len(t):
                yield _dealt_batch(_deal(target[d], d, [t, np.minimum(df, 65535).astype("<u2")], all_cls, size, n_buckets))

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        at = 0
        for batch in batches:
            for low, high, cls, n, c in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
                cls = np.frombuffer(cls, U64)
                c = _wide(c, len(cls))
                parts[0].append(np.frombuffer(low, U64))
                parts[1].append(np.frombuffer(high, "<u2"))
                parts[2].append(np.repeat(cls, c))
                parts[3].append(np.repeat(_wide(n, len(cls)), c))
                at += len(c)
        if not at:
            return
        token, df, cls, n = (np.concatenate(p) for p in parts)
        order = np.lexsort((token, df, cls))
        token, cls, n = token[order], cls[order], n[order].astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
        end = np.append(begin[1:], len(cls))
        stay = np.flatnonzero(end - begin >= needed(n[begin], percent, 100))
        for lo in range(0, len(stay), 2048):
            i = stay[lo : lo + 2048]
            yield pa.RecordBatch.from_arrays([pa.array(cls[begin[i]].view(np.int64)), pa.array(n[begin[i]]), pa.array([token[a:b].tobytes() for a, b in zip(begin[i], end[i], strict=True)], pa.binary())], names=["cls", "n", "tokens"])

    counted = dealt(docs.select("text").mapInArrow(tidy(deal), DEALT)).mapInArrow(tidy(count), DEALT)
    return dealt(counted).mapInArrow(tidy(gather), "cls long, n long, tokens binary")


def candidate_edges(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """sets (cls, n, tokens) -> edges (a, b); every pair of classes that links is connected by them."""
    n_buckets = partitions(sets.sparkSession)

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cls, n = part.column(0).to_numpy().view(U64), part.column(1).to_numpy()
                tokens, doc, rest = [], [], []
                for i, raw in enumerate(part.column(2).to_pylist()):
                    t = np.frombuffer(raw, U64)
                    p = len(t) - int(needed(n[i], percent, 100)) + 1
                    tokens.append(mix(t[:p]))
                    rest.append(len(t) - np.arange(p))
                    doc.append(np.full(p, i))
                if tokens and (out := pack(np.concatenate(tokens), np.concatenate(doc), np.concatenate(rest), cls, n, n_buckets)) is not None:
                    yield out

    return _meet(sets.select("cls", "n", "tokens").mapInArrow(tidy(post), POSTING), percent)


POSTING = "bucket int, token binary, local binary, rest binary, cls binary, n binary"


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in the least width that holds them all."""
    most = x.max(initial=0)
    return x.astype("<u1" if most < 256 else "<u2" if most < 65536 else "<u4").tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64)


def pack(tokens: np.ndarray, doc: np.ndarray, rest: np.ndarray, cls: np.ndarray, n: np.ndarray, n_buckets: int) -> pa.RecordBatch | None:
    """Postings (token, document, rest) by bucket of token, with a table of the documents in each."""
    bucket = (tokens >> U64(32)) % U64(n_buckets)
    order = np.argsort(bucket, kind="stable")
    tokens, doc, rest, bucket = tokens[order], doc[order], rest[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=U64))
    rows = []
    for b in np.flatnonzero(np.diff(cuts)):
        lo, hi = cuts[b], cuts[b + 1]
        used, local = np.unique(doc[lo:hi], return_inverse=True)
        rows.append((int(b), tokens[lo:hi].astype("<u4").tobytes(), _narrow(local), _narrow(rest[lo:hi]), cls[used].tobytes(), n[used].astype("<u4").tobytes()))
    if not rows:
        return None
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(x, pa.binary()) for x in cols[1:])], names=["bucket", "token", "local", "rest", "cls", "n"])


def unpack(batches: Iterable[pa.RecordBatch]) -> tuple[np.ndarray, ...] | None:
    """(bucket and token, class, set size, rest) of all postings of a task."""
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for batch in batches:
        for bucket, token, local, rest, cls, n in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            t = np.frombuffer(token, "<u4")
            w = _wide(local, len(t))
            parts[0].append(t.astype(U64) | U64(bucket) << U64(32))
            parts[1].append(np.frombuffer(cls, U64)[w])
            parts[2].append(np.frombuffer(n, "<u4").astype(np.int64)[w])
            parts[3].append(_wide(rest, len(t)))
    return tuple(np.concatenate(p) for p in parts) if parts[0] else None


def _meet(posted: DataFrame, percent: int) -> DataFrame:
    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := unpack(batches)) is not None:
            a, b = list_edges(*found, percent)
            for lo in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[lo : lo + 100_000].view(np.int64)), pa.array(b[lo : lo + 100_000].view(np.int64))], names=["a", "b"])

    return dealt(posted).mapInArrow(tidy(meet), "a long, b long")


def list_edges(token: np.ndarray, cls: np.ndarray, n: np.ndarray, rest: np.ndarray, percent: int, small: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Candidate edges of posting lists: filtered pairs of lists of up to `small` sets, a chain by size of longer ones.

    Both connect all sets that link, which cells decide exactly; a chain only leaves more to the cells.
    rest: how many tokens of the set come from this one on; a pair's overlap is at most the smaller rest.
    """
    order = np.argsort(token, kind="stable")
    token = token[order]
    same = np.zeros(len(token), bool)
    same[1:] = token[1:] == token[:-1]
    multi = same.copy()
    multi[:-1] |= same[1:]
    order = order[multi]
    token, cls, n, rest = token[multi], cls[order], n[order], rest[order]
    order = np.lexsort((cls, n, token))
    token, cls, n, rest = token[order], cls[order], n[order], rest[order]
    keep = np.ones(len(token), bool)
    keep[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
    token, cls, n, rest = token[keep], cls[keep], n[keep], rest[keep]
    begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, int)
    sizes = np.diff(np.append(begins, len(token)))
    size = np.repeat(sizes, sizes)
    out_a, out_b = [], []
    both = 100 + percent
    for d in range(1, small):
        i = np.flatnonzero(token[:-d] == token[d:]) if len(token) > d else np.zeros(0, int)
        i = i[(size[i] <= small) | (d == 1)]
        if not len(i):
            break
        j = i + d  # n[i] <= n[j]
        ok = n[i] * 100 >= n[j] * percent
        need = -(-(n[i] + n[j]) * percent // both)
        ok &= (size[i] > small) | (np.minimum(rest[i], rest[j]) >= need)
        out_a.append(cls[i[ok]])
        out_b.append(cls[j[ok]])
    a = np.concatenate(out_a) if out_a else np.zeros(0, U64)
    b = np.concatenate(out_b) if out_b else np.zeros(0, U64)
    return forest(a, b)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges with the same components as the given edges."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    x, y = inv[: len(a)], inv[len(a) :]
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        label = label[label]
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


# ---------------------------------------------------------------- token-group matrix


def similar(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, percent: int) -> bool:
    """a, b: sorted shared tokens of sets of n_a and n_b."""
    if 100 * min(n_a, n_b) < percent * max(n_a, n_b):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (n_a + n_b - both)


class TokenGroupMatrix:
    """Groups of similar sets; each group's token union bounds any query's overlap with its members."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int], percent: int, group_size: int = 16):
        self.sets, self.sizes, self.percent = sets, sizes, percent
        order = sorted(range(len(sets)), key=lambda i: (int(mix(sets[i]).min()) if len(sets[i]) else 0, len(sets[i])))
        self.groups = [order[i : i + group_size] for i in range(0, len(order), group_size)]
        token = np.concatenate([sets[i] for g in self.groups for i in g]) if sets else np.zeros(0, U64)
        group = np.repeat(np.arange(len(self.groups)), [sum(len(sets[i]) for i in g) for g in self.groups])
        self.tokens, inv = np.unique(token, return_inverse=True)
        cells = np.unique(inv.astype(np.int64) * max(1, len(self.groups)) + group)
        self.member = cells % max(1, len(self.groups))
        self.first = np.searchsorted(cells // max(1, len(self.groups)), np.arange(len(self.tokens) + 1))

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """For each group, how many of the query's tokens its union holds."""
        if not len(self.tokens) or not len(query):
            return np.zeros(len(self.groups), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        lengths = self.first[at + 1] - self.first[at]
        if not len(at):
            return np.zeros(len(self.groups), np.int64)
        index = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        return np.bincount(self.member[index], minlength=len(self.groups))

    def open(self, query: np.ndarray, size: int) -> Iterator[int]:
        """Members of the groups whose bound lets them qualify: overlap with the union >= percent of the query's size."""
        for g in np.flatnonzero(100 * self.bounds(query) >= self.percent * size):
            yield from self.groups[g]


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def cell_links(ids: np.ndarray, sets: list[np.ndarray], sizes: list[int], queries: list[int], percent: int) -> list[tuple[int, int]]:
    """Edges that join what links: every query against all sets of the cell (queries are among the sets)."""
    union = Union(len(sets))
    matrix = TokenGroupMatrix(sets, sizes, percent)
    for i in queries:
        for j in matrix.open(sets[i], sizes[i]):
            if union.find(i) != union.find(j) and similar(sets[i], sets[j], sizes[i], sizes[j], percent):
                union.join(i, j)
    return [(int(ids[i]), int(ids[union.find(i)])) for i in range(len(sets)) if union.find(i) != i]


def _cells(sets: DataFrame, percent: int, n: int) -> DataFrame:
    """sets (cell string, cls, query boolean, n, tokens binary) -> links (a, b) found inside each cell."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            links = cell_links(np.array([h[0] for h in held], np.int64), [h[2] for h in held], [h[3] for h in held], [i for i, h in enumerate(held) if h[1]], percent)
            if not links:
                return None
            a, b = zip(*links, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        cell, held = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for c, cls, query, n_, tokens in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                    if c != cell:
                        if (out := close()) is not None:
                            yield out
                        cell, held = c, []
                    if held and held[-1][0] == cls:
                        held[-1] = (cls, query or held[-1][1], *held[-1][2:])
                    else:
                        held.append((cls, query, np.sort(np.frombuffer(tokens, U64)), n_))
        if (out := close()) is not None:
            yield out

    ordered = sets.select("cell", "cls", "query", "n", "tokens").repartition(n, "cell").sortWithinPartitions("cell", "cls")
    return ordered.mapInArrow(tidy(run), "a long, b long")


def linked_classes(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(cls, root) for the classes that link with another one."""
    spark = docs.sparkSession
    sets = cut(shared_sets(docs.where("doc_id is not null"), k, percent))
    release(spark)
    graph = connected_components(candidate_edges(sets, percent))
    member = sets.select("cls", "n").join(graph.withColumnRenamed("node", "cls"), "cls")
    plan = cut(member.join(_blocks(member), "root").select("cls", "root", "blocks").withColumn("block", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("blocks")).cast("int")))
    release(spark)
    n = partitions(spark)
    sets = sets.join(plan, "cls")
    cell = F.concat_ws("-", F.col("root").cast("string"), F.col("block").cast("string"))
    first = sets.select(cell.alias("cell"), "cls", F.lit(True).alias("query"), "n", "tokens")
    split = plan.where("blocks > 1")
    if not split.limit(1).count():  # the usual case: every component fits a cell
        return connected_components(_cells(first, percent, n)).select(F.col("node").alias("cls"), "root")
    to_all = sets.join(_hubs(split), ["root", "cls"]).select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "cls", "n", "tokens")
    first = first.unionAll(to_all.select(cell.alias("cell"), "cls", F.lit(False).alias("query"), "n", "tokens"))
    links = cut(_cells(first, percent, n))
    joined = cut(connected_components(links))
    # What is not in the main class of a split component is compared with all of its blocks.
    label = split.join(joined.select(F.col("node").alias("cls"), F.col("root").alias("c")), "cls", "left").withColumn("c", F.coalesce("c", "cls"))
    main = label.groupBy("root", "c").count().groupBy("root").agg(F.max_by("c", F.struct("count", "c")).alias("main"))
    rest = cut(label.join(main, "root").where("c <> main").select("root", "cls"))
    if rest.limit(1).count():
        chunks = rest.groupBy("root").agg(F.ceil(F.count("*") / QUERY_CHUNK).cast("int").alias("chunks"))
        asked = sets.join(rest.join(chunks, "root"), ["root", "cls"]).withColumn("chunk", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("chunks")).cast("int"))
        name = F.concat_ws("-", F.col("root").cast("string"), F.col("block").cast("string"), F.col("chunk").cast("string"))
        asking = asked.select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "chunk", "cls", "n", "tokens").select(name.alias("cell"), "cls", F.lit(True).alias("query"), "n", "tokens")
        held = sets.join(chunks, "root").select("root", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "cls", "n", "tokens").select(name.alias("cell"), "cls", F.lit(False).alias("query"), "n", "tokens")
        links = links.unionAll(_cells(asking.unionAll(held), percent, n))
        joined = connected_components(links)
    return joined.select(F.col("node").alias("cls"), "root")


def _blocks(member: DataFrame) -> DataFrame:
    """How many cells a component needs."""
    return member.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / CELL_SETS), F.ceil(F.sum("n") / CELL_TOKENS)).cast("int").alias("blocks"))


def _hubs(large: DataFrame) -> DataFrame:
    """A few sets of every large component: the smallest of each residue of a hash."""
    part = F.pmod(F.xxhash64("cls", F.lit(4)), F.lit(HUBS))
    return large.groupBy("root", part.alias("p")).agg(F.min_by("cls", F.xxhash64("cls", F.lit(2))).alias("cls")).select("root", "cls")


def jaccard_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text).

    A null or wordless text has the empty set and is its own component. Rows with equal ids each get a
    row; rows with a null id are linked with nothing and have a null component. Other columns are ignored.
    """
    rows = cut(shingle_classes(docs, k))
    linked = linked_classes(docs, k, percent)
    some = rows.where("n_shingles > 0 and doc_id is not null").join(linked, "cls", "left").select("doc_id", "n_shingles", F.coalesce("root", "cls").alias("c"))
    some = cut(some)
    lowest = cut(some.groupBy("c").agg(F.min("doc_id").alias("component_id")))  # apart from the join, so that can split a large class
    full = some.join(lowest, "c").select("doc_id", "n_shingles", "component_id")
    return full.unionAll(rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
