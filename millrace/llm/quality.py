"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words (as written, their shape, and whether they repeat the word before) and character
n-grams (3 to 5 bytes). A softmax over two classes stands on that average; vectors and output layer
are trained together by minibatch stochastic gradient descent in numpy.

Scale: the model is fitted on a bounded, documented sample of labelled rows (`Settings.sample_per_class`);
the labels are sampled before they meet the texts, so that side of the join is bounded and is
broadcast. Scoring is one pass without a shuffle: since average and output layer are linear, each
bucket's vector folds into one number, and a text's score is the mean of its buckets' numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, rows_with, table, tidy
from .textops import U64, Words, buffers, mix, rolling, slices, span_hash

THRESHOLD = 0.3


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 14
    dim: int = 16
    ngrams: tuple[int, ...] = (3, 4, 5)
    sample_per_class: int = 1500
    epochs: int = 12
    batch: int = 32
    rate: float = 4.0
    seed: int = 7


def features(data: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every feature of a slice of texts. Texts of under 3 bytes have only words."""
    words = Words(data, offsets, lower=False)
    shape = np.zeros(256, np.uint8)
    shape[65:91], shape[97:123], shape[48:58], shape[128:] = 1, 2, 3, 2
    marks = np.flatnonzero(shape == 0)
    shape[marks] = marks
    shapes = shape[data]
    parts_b, parts_d = [], []
    keep = U64(s.buckets - 1)
    for salt, h in ((1, words.hash), (2, span_hash(rolling(shapes), words.start, np.minimum(words.end, words.start + 6)))):
        parts_b.append((mix(h + U64(salt)) & keep).astype(np.int32))
        parts_d.append(words.doc)
    again = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1]))
    parts_b.append(np.repeat((mix(np.arange(3, 7, dtype=U64)) & keep).astype(np.int32), len(again)))  # a word said twice in a row
    parts_d.append(np.tile(words.doc[:-1][again], 4))
    n = len(data)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)).astype(np.int32)
    sums = rolling(data) if n else np.zeros(1, U64)
    for k in s.ngrams:
        if n >= k:
            at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
            parts_b.append((span_hash(sums, at, at + k) & keep).astype(np.int32))
            parts_d.append(doc[at])
    return np.concatenate(parts_b), np.concatenate(parts_d)


def sparse_rows(batch_column, s: Settings) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, buckets, counts) of each text."""
    data, offsets = buffers(batch_column)
    for lo, hi in slices(offsets, 1 << 18):
        part = data[offsets[lo] : offsets[hi]]
        b, d = features(part, offsets[lo : hi + 1] - offsets[lo], s)
        key, counts = np.unique(d.astype(np.int64) * s.buckets + b, return_counts=True)
        cut = np.searchsorted(key, np.arange(hi - lo + 1) * s.buckets)
        for i in range(hi - lo):
            yield lo + i, (key[cut[i] : cut[i + 1]] % s.buckets).astype(np.uint16), counts[cut[i] : cut[i + 1]]


@dataclass
class Model:
    vectors: np.ndarray  # buckets x dim
    output: np.ndarray  # dim x 2
    bias: np.ndarray  # 2

    def folded(self) -> tuple[np.ndarray, float]:
        """Per-bucket contribution to logit(label 1), and the intercept."""
        return self.vectors @ (self.output[:, 1] - self.output[:, 0]), float(self.bias[1] - self.bias[0])


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> Model:
    """rows: (buckets, counts, label). Without both classes the score is their prior."""
    rng = np.random.default_rng(s.seed)
    model = Model(rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32), np.zeros((s.dim, 2), np.float32), np.zeros(2, np.float32))
    labels = np.array([r[2] for r in rows], np.int64)
    share = np.bincount(labels, minlength=2)[:2] if rows else np.zeros(2, np.int64)
    if min(share) == 0:
        model.bias[:] = np.log(np.maximum(share, 1) + 0.0)
        return model
    model.output[:] = rng.normal(0, 0.1, model.output.shape)
    weight = len(rows) / (2.0 * share)
    steps, done = s.epochs * -(-len(rows) // s.batch), 0
    for _ in range(s.epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), s.batch):
            pick = order[lo : lo + s.batch]
            x = np.zeros((len(pick), s.buckets), np.float32)
            for i, r in enumerate(pick):
                total = rows[r][1].sum()
                if total:
                    x[i, rows[r][0]] = rows[r][1] / total
            hidden = x @ model.vectors
            logits = hidden @ model.output + model.bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            p *= weight[labels[pick]][:, None] / len(pick)
            rate = s.rate * (1 - done / steps)
            back = p @ model.output.T
            model.output -= rate * (hidden.T @ p)
            model.bias -= 0.1 * rate * p.sum(0)
            used = np.flatnonzero(x.any(0))
            model.vectors[used] -= rate * 50 * (x[:, used].T @ back)
            done += 1
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, held_out, per_class: int) -> DataFrame:
    """(doc_id, text, label): at most `per_class` rows of each label, chosen by a hash of doc_id.

    Rows whose id or label is null, or held out, never enter. The sample is bounded by 2 * per_class
    label rows, so broadcasting it is safe at any scale.
    """
    spark = docs.sparkSession
    known = labels.select("doc_id", F.col(column).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    ids = []
    for value in (0, 1):
        ids += [(r.doc_id, value) for r in known.where(F.col("label") == value).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    side = spark.createDataFrame(ids, "doc_id long, label int")
    return docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).join(F.broadcast(side), "doc_id")


def held_out(doc_id):
    return F.coalesce(remainder(doc_id, 5) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    def sparse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(sparse_rows(batch.column(1), s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([b.tobytes() for _, b, _ in found], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, _, c in found], pa.binary())],
                names=["doc_id", "label", "buckets", "counts"],
            )

    sample = labelled_sample(docs, labels, "quality", held_out, s.sample_per_class).select("doc_id", "text", "label")
    got = sample.mapInArrow(tidy(sparse), "doc_id long, label int, buckets binary, counts binary").toArrow()
    rows = sorted(zip(*(got.column(c).to_pylist() for c in ("doc_id", "label", "buckets", "counts")), strict=True))
    del got
    return train([(np.frombuffer(b, np.uint16), np.frombuffer(c, "<u4"), label) for _, label, b, c in rows], s)


def score(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """docs plus a double column `score` in (0, 1), in place of one that is there; a null or empty text scores by the intercept alone."""
    docs = docs.drop("score")
    weights, bias = model.folded()
    shipped = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float64), bias))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shipped.value
        for batch in batches:
            data, offsets = buffers(batch.column(batch.schema.get_field_index("text")))
            out = np.empty(batch.num_rows)
            for lo, hi in slices(offsets, 1 << 19):
                bucket, doc = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], s)
                n = np.bincount(doc, minlength=hi - lo)
                total = np.bincount(doc, weights=w[bucket], minlength=hi - lo)
                out[lo:hi] = 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + b, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(tidy(run), rows_with(docs, "score double"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
