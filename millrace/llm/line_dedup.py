"""Line dedup with a log-template tree.

A line is parsed at fixed depth: token count, then its leading tokens, with tokens that hold a digit as a
variable field. The lines of a leaf that recurs form groups: all of them, those that share a quarter of the line,
and those that are equal. Each group that recurs is generalised: a position whose most frequent token holds at least
half of the group's lines is constant, any other is a variable field. So a leaf has as many templates as it needs, however much
prose shares it. Lines that agree with the constants of a recurring template are dropped, but for those of the document with
the smallest id that holds it.

A template recurs when at least `min_documents` independent documents hold it; a line of LONG_TOKENS tokens or more that is
the same but for tokens with digits recurs when LONG_DOCUMENTS do. Lines of under `min_tokens` tokens are compared as they are. Near
copies (module `copies`: an estimated shingle similarity of 0.75) have one vote together, so copies of one
text do not make its lines recur: near-duplicate removal is another operator's task.

Scale: signatures and line keys travel packed; lines of leaves that do not recur are kept back by a bit filter of
fixed size. What a leaf, a group or a template has is counted first and checkpointed, so the join that brings it back to
the lines has no aggregate on it and can be split where one of them holds many lines. The texts are shuffled once, to
meet their drop lists.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, dealt, partitions, release, table, tidy, unused
from .copies import near_copies
from .textops import U64, buffers, slices

DEPTH = 3
QUARTERS = 4
MIN_TOKENS = 4
MIN_DOCUMENTS = 10
LONG_TOKENS = 50
LONG_DOCUMENTS = 2
FIELD = "<*>"
_DIGIT = re.compile(r"\d")


def leaf_of(tokens: list[str], depth: int = DEPTH) -> int:
    """Leaf of a line: token count and leading tokens, a token with a digit being a variable field."""
    return xxhash.xxh64_intdigest(f"{len(tokens)}\x1f" + "\x1f".join([FIELD if _DIGIT.search(t) else t for t in tokens[:depth]])) - (1 << 63)


FILTER_BITS = 1 << 20


def _leaves(text: str, depth: int, min_tokens: int) -> Iterator[tuple[int, int, list[str]]]:
    """(line number, leaf, unmasked tokens) of the lines that are not blank. A short line's leaf is the line itself.

    The lowest bit of a leaf tells long lines.
    """
    for i, line in enumerate(text.split("\n")):
        tokens = line.split()
        if len(tokens) >= min_tokens:
            yield i, leaf_of(tokens, depth) & ~1 | (len(tokens) >= LONG_TOKENS), tokens
        elif tokens:
            yield i, (xxhash.xxh64_intdigest("\x1e" + "\x1f".join(tokens)) - (1 << 63)) & ~1, tokens


def with_voice(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """rows (key, ...) and their voice; a text without near copies is its own."""
    return rows.join(copies, "key", "left").withColumn("voice", F.coalesce("voice", "key"))


def leaf_votes(texts: DataFrame, depth: int, min_tokens: int, min_documents: int) -> DataFrame:
    """texts (key, text) -> leaf, key: the leaves held by enough documents for their length. Values travel packed by bucket."""
    n_buckets = partitions(texts.sparkSession)

    def packed(value: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        bucket = (value >> U64(8)) % U64(n_buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1, dtype=U64))
        rows = [(int(b), value[o].tobytes(), key[o].tobytes()) for b in np.flatnonzero(np.diff(cuts)) for o in [order[cuts[b] : cuts[b + 1]]]]
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["bucket", "value", "key"])

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            column = batch.column(1)
            _, offsets = buffers(column)
            for lo, hi in slices(offsets):
                leaf, owner = [], []
                for key, text in zip(keys[lo:hi].tolist(), column.slice(lo, hi - lo).to_pylist(), strict=True):
                    found = {x for _, x, _ in _leaves(text or "", depth, min_tokens)}
                    leaf += found
                    owner += [key] * len(found)
                if leaf:
                    yield packed(np.array(leaf, np.int64).view(U64), np.array(owner, np.int64))

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        for batch in batches:
            values += [np.frombuffer(x, U64) for x in batch.column(1).to_pylist()]
            keys += [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
        if not values:
            return
        value, key = np.concatenate(values), np.concatenate(keys)
        _, inverse, counts = np.unique(value, return_inverse=True, return_counts=True)
        keep = counts[inverse] >= np.where(value & U64(1), min(LONG_DOCUMENTS, min_documents), min_documents)
        value, key = value[keep], key[keep]
        for at in range(0, len(key), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(value[part].view(np.int64)), pa.array(key[part])], names=["leaf", "key"])

    posted = texts.select("key", "text").mapInArrow(tidy(post), "bucket int, value binary, key binary")
    return dealt(posted).mapInArrow(tidy(meet), "leaf long, key long")


LINE = "key long, doc_id long, line int, mask long, leaf long, tokens array<string>"


def lines_of(texts: DataFrame, leaves: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """texts (key, doc_id, text) -> LINE of the lines whose leaf may be among leaves (leaf).

    mask is the masked line's hash; its tokens are given where a slice of texts meets it first, else null. A bit filter
    of fixed size, folded natively, keeps most other lines from being sent; the join decides.
    """
    bit = F.col("leaf").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = leaves.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits")).collect()
    filter_ = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words:  # at most FILTER_BITS / 64 rows
        filter_[r.w] = r.bits
    shipped = texts.sparkSession.sparkContext.broadcast(filter_)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shipped.value.view(np.uint8), bitorder="little").view(bool)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows, met = [], set()
                for key, doc_id, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    for i, leaf, tokens in _leaves(text or "", depth, min_tokens):
                        if bits[leaf & (FILTER_BITS - 1)]:
                            if len(tokens) >= min_tokens:
                                tokens = [FIELD if _DIGIT.search(t) else t for t in tokens]
                            mask = xxhash.xxh64_intdigest(f"{leaf}\x1f" + "\x1f".join(tokens)) - (1 << 63)
                            rows.append((key, doc_id, i, mask, leaf, None if mask in met else tokens))
                            met.add(mask)
                if rows:
                    cols = list(zip(*rows, strict=True))
                    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["key", "doc_id", "line", "mask", "leaf", "tokens"])

    return texts.select("key", "doc_id", "text").mapInArrow(tidy(run), LINE)


def groups_of(leaf: str, tokens: str, min_documents: int, fewest: int):
    """Groups of a masked line and the votes each needs: its leaf, the leaf with each quarter of the line, the whole line."""
    edge = [F.floor(F.size(tokens) * F.lit(j) / QUARTERS).cast("int") for j in range(QUARTERS + 1)]
    quarters = [F.slice(tokens, edge[j] + 1, edge[j + 1] - edge[j]) for j in range(QUARTERS)]
    ids = [F.col(leaf), *[F.xxhash64(leaf, F.lit(j), part) for j, part in enumerate([*quarters, F.col(tokens)])]]
    need = [F.lit(min_documents)] * (len(ids) - 1) + [F.when(F.size(tokens) >= LONG_TOKENS, fewest).otherwise(min_documents)]
    return F.array(*[F.struct(g.alias("group"), n.alias("need")) for g, n in zip(ids, need, strict=True)])


def spots_of(lines: DataFrame, most: int = 200_000) -> DataFrame:
    """lines (group, n, tokens) -> group, at, token, n: how often a token stands at a position, added up in each task.

    Lines of a group are alike, so a task sends little more than one line's tokens for each group. A task holds `most`
    counts at a time.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[tuple[int, int, str], int] = {}

        def full() -> pa.RecordBatch:
            group, at, token = zip(*tally, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(at, pa.int32()), pa.array(token, pa.string()), pa.array(list(tally.values()), pa.int64())], names=["group", "at", "token", "n"])
            tally.clear()
            return out

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for group, n, tokens in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    for at, token in enumerate(tokens):
                        spot = (group, at, token)
                        tally[spot] = tally.get(spot, 0) + n
                if len(tally) >= most:
                    yield full()
        if tally:
            yield full()

    return lines.select("group", "n", "tokens").mapInArrow(tidy(run), "group long, at int, token string, n long")


def dropped_lines(texts: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_documents: int = MIN_DOCUMENTS, agree: float = 0.8) -> DataFrame:
    """texts (key, doc_id, text) -> key, line numbers to drop.

    Groups, templates and what fits them depend on the masked line alone, so they are found once for each masked line,
    weighted by its voices; lines themselves travel as numbers.
    """
    fewest = min(LONG_DOCUMENTS, min_documents)
    copies = cut(near_copies(texts).where("node <> root").select(F.col("node").alias("key"), F.col("root").alias("voice")))
    release(texts.sparkSession)
    told = with_voice(leaf_votes(texts, depth, min_tokens, min_documents), copies).select("leaf", "voice").distinct()
    leaves = cut(told.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= F.when(F.col("leaf").bitwiseAND(F.lit(1)) == 1, fewest).otherwise(min_documents)).select("leaf"))
    found = cut(lines_of(texts, leaves, depth, min_tokens))
    masks = cut(found.where("tokens is not null").groupBy("mask").agg(F.first("leaf").alias("leaf"), F.first("tokens").alias("tokens")).join(leaves, "leaf"))
    held = cut(with_voice(found.select("key", "doc_id", "line", "mask").join(masks.select("mask"), "mask"), copies))
    del found
    release(texts.sparkSession)
    heard = cut(held.select("mask", "voice").distinct())
    weight = cut(heard.groupBy("mask").agg(F.count("*").alias("n")))
    parts = cut(masks.select("mask", F.explode(groups_of("leaf", "tokens", min_documents, fewest)).alias("part")).select("mask", "part.*"))
    common = heard.join(parts, "mask").select("group", "need", "voice").distinct().groupBy("group", "need").count().where("count >= need").select("group")
    parts = cut(parts.join(cut(common), "group"))
    lines = parts.join(masks.select("mask", "tokens"), "mask")
    spots = spots_of(lines.join(weight, "mask")).groupBy("group", "at", "token").agg(F.sum("n").alias("n"))
    mode = spots.groupBy("group", "at").agg(F.sum("n").alias("all"), F.max(F.struct("n", "token")).alias("top"))
    constant = (2 * F.col("top.n") >= F.col("all")) & (F.col("top.token") != FIELD)
    template = mode.groupBy("group").agg(F.map_from_entries(F.collect_list(F.when(constant, F.struct(F.col("at"), F.col("top.token").alias("token"))))).alias("template"))
    template = cut(template.where(F.size("template") > 0))
    same = F.size(F.filter(F.map_entries("template"), lambda e: F.get("tokens", e["key"]) == e["value"]))
    fits = cut(lines.join(template, "group").where((2 * F.size("template") >= F.size("tokens")) & (same >= agree * F.size("template"))).select("group", "need", "mask"))
    voices = heard.join(fits, "mask").select("group", "need", "voice").distinct().groupBy("group", "need").agg(F.count("*").alias("n")).where("n >= need").drop("need")
    # A line belongs to one template, the one with the most voices, so every template that drops lines has a keeper.
    chosen = cut(fits.join(cut(voices), "group").groupBy("mask").agg(F.max(F.struct("n", "group")).alias("top")).select("mask", F.col("top.group").alias("group")))
    placed = cut(held.join(chosen, "mask").select("key", "doc_id", "line", "group"))
    first = cut(placed.groupBy("group").agg(F.min(F.struct("doc_id", "key")).alias("owner")).select("group", F.col("owner.key").alias("owner")))
    return placed.join(first, "group").where("key <> owner").groupBy("key").agg(F.collect_set("line").alias("drop"))


def dedup_lines(docs: DataFrame, counts: bool = True, **settings) -> DataFrame:
    """docs with recurring template lines dropped from `text`, plus n_lines and n_dropped where `counts` is set.

    A null text stays null and has no lines; blank lines are kept, lines of under `min_tokens` tokens recur only as they are.
    Rows that are equal in id and text are treated alike. All other columns pass through; the counts replace
    columns of their names, so without them those pass through too.
    """
    named = docs.drop("n_lines", "n_dropped") if counts else docs
    key, drop, lines = unused(named, "key", "drop", "lines")
    keyed = named.withColumn(key, F.xxhash64("doc_id", "text"))
    texts = keyed.select(F.col(key).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    drops = dropped_lines(texts, **settings).select(F.col("key").alias(key), F.col("drop").alias(drop))
    rest = F.filter(F.col(lines), lambda _, i: ~F.array_contains(F.col(drop), i))
    out = keyed.join(drops, key, "left").withColumn(lines, F.split("text", "\n"))
    n = F.coalesce(F.size(drop), F.lit(0))
    numbers = [F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), F.when(n > 0, n).otherwise(0).cast("long").alias("n_dropped")]
    return out.select(
        *[F.when(F.col(drop).isNull(), F.col("text")).otherwise(F.array_join(rest, "\n")).alias("text") if c == "text" else F.col(c) for c in named.columns],
        *(numbers if counts else []),
    )


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
