"""Language-model scoring: causal self-attention over subword ids, and the smoothed unigram base over words.

A text is its words (runs of other bytes than ASCII white space) in lower-case A-Z, joined by single spaces, and an end.
The byte-level vocabulary loses nothing of that, so the model's score is a log probability of the text. The model (`attention`) is trained on all windows of
all training texts: it starts in the driver from a sample (`Shape.windows`), then tasks add up the gradients of every window, in `Shape.rounds` rounds with a step
behind each. A text's round hangs on its id alone. All counts behind the model, and the word counts of the base, are of all training texts too.

Scale: texts are read and encoded once, in blocks of about 2 MB, which are written to the shared folder; symbols of the training texts are written there by round, so
a round reads its own share and each window is learned once. A task sends one sum of gradients, whatever it reads. Scoring passes over the
blocks without a shuffle: windows overlap, each token is scored in one of them, and a batch of windows is one masked attention. A word's count is found by its 64-bit
hash: every block sends its distinct words to the words' buckets and gets their counts back, so what moves follows the
distinct words of blocks, no word is in one bucket more often than there are blocks, and nothing that grows is broadcast.
The driver gets the counts of ids and of pairs of symbols (at most vocabulary and Shape.symbols squared), the sample, a sum of gradients for each round, and three totals.

Nulls: a null text is empty, an empty text has only its end; a row without id is not held out and not learned from. Repeated rows are
scored and counted each. Without training texts every word has the base's probability of 1 and the model knows nothing but its groups.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .attention import Adam, Attention, Scorer, Shape, Sums, learn, symbols_of, untrained, window_starts, windows_of
from .common import dealt, fresh_path, partitions, release, remainder, table
from .textops import U64, Words, buffers, mix, slices
from .tokens import tokenizer, vocabulary

VOCABULARY = "byte_bpe_50k.json"
BLOCK = 1 << 21
PARTS = 8  # of a sum of gradients, which are added in tasks of their own
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def planes(x: np.ndarray) -> bytes:
    """Bytes of unsigned numbers, all lowest bytes first: high bytes, which are mostly 0, then compress to little."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def from_planes(raw: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def narrow(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs; the width is the length over their number."""
    top = int(x.max()) if len(x) else 0
    return x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8").tobytes()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """One row for each block of documents: ids of their subwords, slots of their words in the block's distinct words, and how often training texts hold those.

    docs: doc_id, text. learn, held and seed (for the sample) are of the documents.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block long, doc_id array<{kind}>, held array<boolean>, learn array<boolean>, seed binary, ids binary, n_ids binary, slots binary, n_words binary, words binary, counts binary"
    path_of, n_buckets = vocabulary(VOCABULARY), partitions(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, block = tokenizer(path_of, "byte"), TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            learn_, seed = batch.column(3).to_numpy(zero_copy_only=False).astype(bool), batch.column(4).to_numpy(zero_copy_only=False)
            for lo, hi in slices(offsets, BLOCK):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                words = Words(part, at)
                known, slot = np.unique(words.hash, return_inverse=True)
                order = np.argsort((known % U64(n_buckets)).astype(np.uint32), kind="stable")  # slots run by bucket, so answers need no words
                place = np.empty(len(order), np.uint32)
                place[order] = np.arange(len(order), dtype=np.uint32)
                known, slot = known[order], place[slot]
                counts = np.bincount(slot[learn_[lo:hi][words.doc]], minlength=len(known)).astype("<u4")
                raw = part.tobytes()
                ids = tok.encode([b" ".join(raw[a:b].translate(_LOWER).split()).decode() for a, b in zip(at[:-1], at[1:], strict=True)])
                head = [pa.array([block], pa.int64()), *(pa.ListArray.from_arrays([0, hi - lo], c.slice(lo, hi - lo)) for c in (batch.column(0), batch.column(2), batch.column(3)))]
                flat = np.concatenate([*ids, np.zeros(0, tok.dtype)]).astype(tok.dtype)
                tail = [seed[lo:hi].tobytes(), flat.tobytes(), np.array([len(x) for x in ids], "<u4").tobytes(), planes(slot.astype("<u4")), np.bincount(words.doc, minlength=hi - lo).astype("<u4").tobytes(), known.tobytes(), counts.tobytes()]
                tail = [pa.array([x], pa.binary()) for x in tail]
                yield pa.RecordBatch.from_arrays([*head, *tail], names=["block", "doc_id", "held", "learn", "seed", "ids", "n_ids", "slots", "n_words", "words", "counts"])
                block += 1

    part = remainder(F.col("doc_id"), 10)
    rows = docs.select("doc_id", "text", F.coalesce(part == 0, F.lit(False)).alias("held"), F.coalesce(part != 0, F.lit(False)).alias("learn"), F.xxhash64("doc_id").alias("seed"))
    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


class _Block:
    """Ids of a block's documents, an end behind each."""

    def __init__(self, row: dict, size: int):
        n = np.frombuffer(row["n_ids"], "<u4").astype(np.int64)
        ids = np.frombuffer(row["ids"], "<u2" if size <= 1 << 16 else "<u4")
        self.offsets = np.concatenate([[0], np.cumsum(n + 1)])
        self.ids = np.full(int(self.offsets[-1]), size, np.int64)
        inside = np.ones(len(self.ids), bool)
        inside[self.offsets[1:] - 1] = False
        self.ids[inside] = ids
        self.learn = np.array(row.get("learn") or [], bool)

    def learned(self) -> np.ndarray:
        return np.repeat(self.learn, np.diff(self.offsets))


def _blocks(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[dict, _Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row, _Block(row, size)


def fit(encoded: DataFrame, size: int, s: Shape = Shape()) -> tuple[Attention, np.ndarray, np.ndarray]:
    """(model, symbol of each id, log probability of the id in its symbol) from the training texts; size: ids of the vocabulary."""
    spark = encoded.sparkSession
    texts = encoded.select("ids", "n_ids", "learn")

    def count_ids(batches):
        total, windows = np.zeros(size + 1, np.int64), 0
        for _, b in _blocks(batches, size):
            total += np.bincount(b.ids[b.learned()], minlength=size + 1)
            windows += int((-(-np.diff(b.offsets) // s.chunk))[b.learn].sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(total[at], windows), pa.int64())], names=["id", "n"])

    got = texts.mapInArrow(count_ids, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = got.column("id").to_numpy(), got.column("n").to_numpy()
    counts = np.zeros(size + 1)
    counts[ids[ids >= 0]] = n[ids >= 0]
    windows = int(n[ids < 0].sum())
    symbol, inside = symbols_of(counts, s)
    spread = by_round(encoded, symbol, size, s, fresh_path(spark, "lm-symbols"))

    def count_pairs(batches):
        total = np.zeros(s.symbols**2, np.int64)
        for x, _, _ in _texts(batches):
            last = np.concatenate([[0], x[:-1]])  # a text's first symbol stands behind the end of the text before it
            total += np.bincount(last * s.symbols + x, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    got = spread.select("symbols", "n", "seed").mapInArrow(count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(s.symbols**2)
    pairs[got.column("pair").to_numpy()] = got.column("n").to_numpy()

    share = min(1.0, 1.5 * s.windows / max(1, windows))

    def sample(batches):
        for x, offsets, seed in _texts(batches):
            starts = window_starts(offsets, s)
            text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            key = mix(seed.astype(U64)[text] + (np.arange(len(text)) - starts[text]).astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(1)
            which = np.flatnonzero(key <= U64(int(share * ((1 << 63) - 1))))
            before, target, first = windows_of(x, offsets, which, s)
            rows = [x.tobytes() for x in np.hstack([before, target, first[:, None]]).astype("<i2")]
            yield pa.RecordBatch.from_arrays([pa.array(key[which].astype(np.int64)), pa.array(rows, pa.binary())], names=["key", "window"])

    picked = spread.select("symbols", "n", "seed").mapInArrow(sample, "key long, window binary").orderBy("key", "window").limit(s.windows).toArrow()
    rows = np.frombuffer(b"".join(picked.column("window").to_pylist()), "<i2").reshape(-1, 3 * s.chunk + 1).astype(np.int64)
    model = learn(untrained(pairs.reshape(s.symbols, s.symbols), s), rows[:, : 2 * s.chunk], rows[:, 2 * s.chunk : 3 * s.chunk], rows[:, -1] > 0)
    return (learn_all(spread, model) if windows > len(rows) else model), symbol, inside


def by_round(encoded: DataFrame, symbol: np.ndarray, size: int, s: Shape, path: str) -> DataFrame:
    """The training texts of each block as symbols, one row for each round of learning: symbols, n (of each text, with its end), seed, round."""
    shared = encoded.sparkSession.sparkContext.broadcast(symbol)

    def run(batches):
        for row, b in _blocks(batches, size):
            n, seed, x = np.diff(b.offsets), np.frombuffer(row["seed"], "<i8"), shared.value[b.ids].astype("<u2")
            of = np.where(b.learn, (mix(seed.astype(U64)) % U64(s.rounds)).astype(np.int64), -1)
            each = np.repeat(of, n)
            found = [r for r in range(s.rounds) if (of == r).any()]
            parts = [[x[each == r].tobytes() for r in found], [n[of == r].astype("<u4").tobytes() for r in found], [seed[of == r].tobytes() for r in found]]
            yield pa.RecordBatch.from_arrays([*(pa.array(p, pa.binary()) for p in parts), pa.array(found, pa.int32())], names=["symbols", "n", "seed", "round"])

    schema = "symbols binary, n binary, seed binary, round int"
    encoded.select("ids", "n_ids", "learn", "seed").mapInArrow(run, schema).write.partitionBy("round").option("compression", "zstd").parquet(path)
    return encoded.sparkSession.read.schema(schema).parquet(path)


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, offsets, seed) of each row of by_round."""
    for batch in batches:
        for symbols, n, seed in zip(*(batch.column(i) for i in range(3)), strict=True):
            offsets = np.concatenate([[0], np.cumsum(np.frombuffer(n.as_py(), "<u4").astype(np.int64))])
            yield np.frombuffer(symbols.as_py(), "<u2").astype(np.int64), offsets, np.frombuffer(seed.as_py(), "<i8")


def learn_all(spread: DataFrame, model: Attention) -> Attention:
    """Steps along the gradients of all windows, each of which is in the sum of one round."""
    s, adam = model.shape, Adam(model.weights)
    tables = spread.sparkSession.sparkContext.broadcast((model.group, model.start))
    for r in range(s.rounds):
        if (flat := _sum_of_round(spread.where(F.col("round") == r), model, tables)) is not None:
            adam.step(model.weights, Sums(model).gradient(flat), s.rate * (1 - r / s.rounds))
    return model


def _sum_of_round(rows: DataFrame, model: Attention, tables) -> np.ndarray | None:
    s, weights = model.shape, rows.sparkSession.sparkContext.broadcast(model.weights)

    def add(batches):
        sums = None
        for x, offsets, _ in _texts(batches):
            if sums is None:
                group, start = tables.value
                sums = Sums(Attention(s, group, start, None, weights.value))
            sums.texts(x, offsets)
        if sums is not None:
            parts = np.array_split(sums.flat(), PARTS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "sums"])

    def total(batches):
        found = {}
        for batch in batches:
            for part, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[part] = found.get(part, 0) + np.frombuffer(sums)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["part", "sums"])

    schema = "part int, sums binary"
    got = rows.select("symbols", "n", "seed").mapInArrow(add, schema).repartition("part").mapInArrow(total, schema).toArrow().sort_by("part")
    weights.unpersist()
    return np.concatenate([np.frombuffer(x) for x in got.column("sums").to_pylist()]) if got.num_rows else None


def model_scores(encoded: DataFrame, fitted: tuple[Attention, np.ndarray, np.ndarray], size: int) -> DataFrame:
    """block, place (of the document in its block), score: log10 of the text's probability, n_ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(fitted)

    def run(batches):
        model, symbol, inside = shared.value
        scorer = Scorer(model)
        for row, b in _blocks(batches, size):
            found = scorer.texts(symbol[b.ids], b.offsets) + np.add.reduceat(inside[b.ids], b.offsets[:-1])
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["block"])), pa.array(np.arange(n, dtype=np.int32)), pa.array(found / np.log(10)), pa.array(np.diff(b.offsets))], names=["block", "place", "score", "n_ids"])

    return encoded.select("block", "ids", "n_ids").mapInArrow(run, "block long, place int, score double, n_ids long")


def word_counts(encoded: DataFrame, path: str) -> DataFrame:
    """block, bucket, n, counts: how often training texts hold the n words of the block in the bucket, in the order of the block's words.

    Rows without a block carry what a bucket adds to the totals: distinct words and words of training texts.
    """
    n, names = partitions(encoded.sparkSession), ["block", "bucket", "n", "counts", "distinct", "tokens"]

    def send(batches):
        for batch in batches:
            for block, words, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words, counts = np.frombuffer(words, "<u8"), np.frombuffer(counts, "<u4")
                edge = np.searchsorted((words % U64(n)).astype(np.int64), np.arange(n + 1))
                some = np.flatnonzero(np.diff(edge))
                parts = [slice(edge[b], edge[b + 1]) for b in some]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), block)), pa.array([words[p].tobytes() for p in parts], pa.binary()), pa.array([narrow(counts[p]) for p in parts], pa.binary())], names=["bucket", "block", "words", "counts"])

    def total(batches):
        packets = list(batches)
        if not packets:
            return
        found = pa.Table.from_batches(packets)
        words = [np.frombuffer(x, "<u8") for x in found.column("words").to_pylist()]
        counts = [np.frombuffer(x, f"<u{len(x) // len(w)}") for x, w in zip(found.column("counts").to_pylist(), words, strict=True)]
        known, slot = np.unique(np.concatenate(words), return_inverse=True)
        sums = np.bincount(slot, weights=np.concatenate(counts), minlength=len(known)).astype(np.int64)
        bucket, blocks = found.column("bucket").to_numpy(), found.column("block").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array(bucket[:1]), pa.array([0]), pa.array([b""], pa.binary()), pa.array([int((sums > 0).sum())]), pa.array([int(sums.sum())])], names=names)
        size = np.array([len(w) for w in words], np.int64)
        edge = np.concatenate([[0], np.cumsum(size)])
        for lo in range(0, len(blocks), 256):
            hi = min(lo + 256, len(blocks))
            answers = [narrow(sums[slot[a:b]]) for a, b in zip(edge[lo:hi], edge[lo + 1 : hi + 1], strict=True)]
            none = pa.nulls(hi - lo, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(blocks[lo:hi]), pa.array(bucket[lo:hi]), pa.array(size[lo:hi]), pa.array(answers, pa.binary()), none, none], names=names)

    schema = "block long, bucket long, n long, counts binary, distinct long, tokens long"
    dealt(encoded.select("block", "words", "counts").mapInArrow(send, "bucket long, block long, words binary, counts binary"), F.col("bucket").cast("int")).mapInArrow(total, schema).write.option("compression", "zstd").parquet(path)
    return encoded.sparkSession.read.schema(schema).parquet(path)


def base_scores(encoded: DataFrame, counts: DataFrame) -> DataFrame:
    """block, place, doc_id, held_out, words, known, logs: number of words, of those that training texts hold, and the sum of log10(count + 0.1)."""
    kind = encoded.schema["doc_id"].dataType.elementType.simpleString()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        row, right = left.to_pylist()[0], right.sort_by("bucket")
        answers = [np.frombuffer(x, f"<u{len(x) // n}").astype(np.int64) for x, n in zip(right.column("counts").to_pylist(), right.column("n").to_pylist(), strict=True)]
        c = np.concatenate([*answers, np.zeros(0, np.int64)])
        many = np.frombuffer(row["n_words"], "<u4").astype(np.int64)
        slots = from_planes(row["slots"], "<u4")
        doc = np.repeat(np.arange(len(many)), many)
        logs = np.bincount(doc, weights=np.log10(c + 0.1)[slots], minlength=len(many))
        known = np.bincount(doc[c[slots] > 0], minlength=len(many))
        return pa.table({"block": pa.array(np.full(len(many), row["block"])), "place": pa.array(np.arange(len(many), dtype=np.int32)), "doc_id": pa.array(row["doc_id"], left.schema.field("doc_id").type.value_type), "held_out": pa.array(row["held"], pa.bool_()), "words": pa.array(many), "known": pa.array(known), "logs": pa.array(logs)})

    left = encoded.select("block", "doc_id", "held", "slots", "n_words").groupBy("block")
    right = counts.where("block is not null").select("block", "bucket", "n", "counts").groupBy("block")
    return left.cogroup(right).applyInArrow(meet, f"block long, place int, doc_id {kind}, held_out boolean, words long, known long, logs double")


def lm_scores(docs: DataFrame, s: Shape = Shape()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_ids of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    size = tokenizer(vocabulary(VOCABULARY), "byte").tok.get_vocab_size()
    encoded = encode(docs.select("doc_id", "text"), fresh_path(spark, "lm-blocks"))
    counts = word_counts(encoded, fresh_path(spark, "lm-counts"))
    release(spark)  # what words were sent with
    ends = encoded.select(F.sum(F.size(F.filter("learn", lambda x: x))).alias("ends")).first().ends or 0
    sums = counts.where("block is null").agg(F.sum("distinct").alias("v"), F.sum("tokens").alias("n")).first()
    n, v = int(sums.n or 0) + int(ends), int(sums.v or 0) + (1 if ends else 0)
    per, end = float(np.log10(n + 0.1 * (v + 1))), float(np.log10(ends + 0.1))
    fitted = fit(encoded, size, s)
    release(spark)  # what was counted and learned with
    tokens = F.col("words") + 1
    return base_scores(encoded, counts).join(model_scores(encoded, fitted, size), ["block", "place"]).select(
        "doc_id", "held_out", tokens.alias("n_tokens"), (F.col("known") + (1 if ends else 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.lit(end) - tokens * F.lit(per)).alias("base_score"), "score", "n_ids",
    )


def op12_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
