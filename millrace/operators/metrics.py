"""Evaluation: confusion, F1, log loss, calibration, temperature, percentiles, votes, deltas, roll-ups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.vectors import FLOOR, argmax, temperature_scale
from millrace.operators.sampling import group_ordinals
from millrace.sources.storage import cut

LABEL_ROWS = "label string, idx int"


def label_table(spark, labels: Sequence[str]) -> DataFrame:
    """The closed, ordered label domain."""
    return spark.createDataFrame([(x, i) for i, x in enumerate(labels)], LABEL_ROWS)


def predicted(rows: DataFrame) -> DataFrame:
    """rows (truth int, p array<double>) plus `pred`, the lowest index of the largest probability."""
    return rows.withColumn("pred", argmax(F.col("p")))


def confusion(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """truth, pred, n for every pair of labels, zero-filled. The label table's square is a fixed size."""
    dim = label_table(rows.sparkSession, labels)
    cells = dim.select(F.col("label").alias("truth"), F.col("idx").alias("t")).join(dim.select(F.col("label").alias("pred"), F.col("idx").alias("q")), F.lit(True))
    counts = predicted(rows).groupBy(F.col("truth").alias("t"), F.col("pred").alias("q")).agg(F.count("*").alias("n"))
    return cells.join(counts, ["t", "q"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def _per_label(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    seen = predicted(rows).select("truth", "pred")
    counts = seen.groupBy("truth", "pred").agg(F.count("*").alias("n"))
    flat = counts.select(F.explode(F.array(*[F.struct(F.lit(i).alias("idx"), F.when((F.col("truth") == i) & (F.col("pred") == i), F.col("n")).otherwise(0).alias("tp"), F.when((F.col("truth") != i) & (F.col("pred") == i), F.col("n")).otherwise(0).alias("fp"), F.when((F.col("truth") == i) & (F.col("pred") != i), F.col("n")).otherwise(0).alias("fn")) for i in range(len(labels))])).alias("s")).select("s.*")
    sums = flat.groupBy("idx").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return label_table(rows.sparkSession, labels).join(sums, "idx", "left").na.fill(0, ["tp", "fp", "fn"]).withColumn("support", F.col("tp") + F.col("fn"))


def label_scores(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """label, support, precision, recall (null without support), f1 (0 where undefined)."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return _per_label(rows, labels).select("label", "idx", "support", F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"))


def macro_f1_target(rows: DataFrame, labels: Sequence[str], targets: int) -> DataFrame:
    """Mean F1 of the first `targets` labels over rows whose truth is one of them; unsupported labels count as 0."""
    scores = label_scores(rows.where(F.col("truth") < targets), labels)
    return scores.where(F.col("idx") < targets).agg(F.avg("f1").alias("macro_f1"))


def macro_f1_supported(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Mean F1 over the labels that have support, all rows counted."""
    return label_scores(rows, labels).where("support > 0").agg(F.avg("f1").alias("macro_f1"))


def accuracy(rows: DataFrame, targets: int) -> DataFrame:
    """n, accuracy, target accuracy, recall of the reject label (null without support)."""
    hit = (F.col("truth") == F.col("pred")).cast("int")
    target = F.col("truth") < targets
    return predicted(rows).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg(F.when(target, hit)).alias("target_accuracy"), F.avg(F.when(~target, hit)).alias("rejection_rate"))


def true_probability(p: Column, truth: Column) -> Column:
    return F.greatest(F.get(p, truth), F.lit(FLOOR))


def negative_log_likelihood(rows: DataFrame, t: float = 1.0) -> DataFrame:
    return rows.select(temperature_scale(F.col("p"), t).alias("q"), "truth").agg(F.avg(-F.log(true_probability(F.col("q"), F.col("truth")))).alias("nll"))


def calibration_error(rows: DataFrame, t: float = 1.0, bins: int = 15) -> DataFrame:
    """Expected calibration error over equal-width bins of the largest probability."""
    q = rows.select(temperature_scale(F.col("p"), t).alias("q"), "truth")
    conf = q.select(F.array_max("q").alias("conf"), (argmax(F.col("q")) == F.col("truth")).cast("double").alias("ok"))
    binned = conf.withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.col("conf") * bins)))
    per = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("conf").alias("c"), F.avg("ok").alias("a"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"))


def temperature_losses(rows: DataFrame, grid: Sequence[float]) -> DataFrame:
    """t, nll: mean loss of rows (truth int, p array<double>) at every temperature, in one scan.

    Every task sums the losses of its rows at all temperatures, so a row is read once and one short row for each task
    is shuffled. Rows without a vector, or with a truth outside of it, have no loss.
    """
    ts = np.array(grid, np.float64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(ts)), 0
        for batch in batches:
            p, truth = batch.column(1), batch.column(0)
            sizes = pc.list_value_length(p).fill_null(0).to_numpy(zero_copy_only=False)
            at = truth.fill_null(-1).to_numpy(zero_copy_only=False)
            flat = pc.list_flatten(p).to_numpy(zero_copy_only=False)
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            for size in np.unique(sizes[sizes > 0]):
                here = np.flatnonzero((sizes == size) & (at >= 0) & (at < sizes))
                for lo in range(0, len(here), 4096):
                    k = here[lo : lo + 4096]
                    z = np.log(np.maximum(flat[begin[k][:, None] + np.arange(size)], FLOOR))
                    own = z[np.arange(len(k)), at[k]]
                    top = z.max(axis=1)
                    for i, t in enumerate(ts):
                        x = top / t
                        q = np.exp(own / t - x) / np.exp(z / t - x[:, None]).sum(axis=1)
                        total[i] += -np.log(np.maximum(q, FLOOR)).sum()
                n += len(here)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["n", "sums"])

    parts = rows.select(F.col("truth").cast("int"), "p").mapInArrow(run, "n long, sums array<double>")
    each = parts.select("n", F.posexplode("sums").alias("at", "s")).groupBy("at").agg((F.sum("s") / F.sum("n")).alias("nll"))
    return each.select(F.get(F.array(*[F.lit(float(t)) for t in grid]), F.col("at")).alias("t"), "nll")


def even_grid(low: float, high: float, steps: int) -> list[float]:
    return [low + i * (high - low) / (steps - 1) for i in range(steps)]


def fit_temperature(rows: DataFrame, low: float = 0.5, high: float = 5.0, steps: int = 451) -> DataFrame:
    """t and nll of the least loss on an even grid, the smaller t of equals."""
    return temperature_losses(rows, even_grid(low, high, steps)).agg(F.min_by(F.struct("t", "nll"), F.struct("nll", "t")).alias("b")).select("b.*")


def reproduction_differences(frozen: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """key, frozen and current value of the rows whose value is another now; missing rows show as null."""
    both = frozen.select(key, F.col(value).alias("frozen")).join(now.select(key, F.col(value).alias("now")), key, "full_outer")
    return both.where(~F.col("frozen").eqNullSafe(F.col("now")))


# ---------------------------------------------------------------- counts and roll-ups


def zero_filled_counts(rows: DataFrame, label_col: str, labels: Sequence[str]) -> DataFrame:
    counts = rows.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("n"))
    return label_table(rows.sparkSession, labels).join(counts, "label", "left").select("label", "idx", F.coalesce("n", F.lit(0)).alias("n"))


def split_label_pivot(rows: DataFrame, split_col: str, label_col: str, labels: Sequence[str]) -> DataFrame:
    """One row per split, one zero-filled column per label."""
    return rows.groupBy(split_col).pivot(label_col, list(labels)).count().na.fill(0)


def rollup_summary(rows: DataFrame, key: str, hit: Column, found: Column) -> DataFrame:
    """Per key and for `all`: rows, hits, share of hits, mean of found."""
    out = rows.groupingSets([[key], []], key).agg(F.grouping(key).alias("g"), F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.avg(found).alias("mean_found"))
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col(key).cast("string")).alias("scope"), "n", "hits", F.try_divide("hits", "n").alias("rate"), "mean_found")


def percentile(rows: DataFrame, value: str, q: float, kind: str, by: list[str] | None = None) -> DataFrame:
    """Three rules for a percentile of n ordered values: nearest ceil(qn)-1, rounded (half even) (n-1)q, floored int(qn)-1.

    Positions are found from counts per distinct value, so no group is ordered in one task by row.
    """
    by = by or []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy(value)
    whole = Window.partitionBy(*by)
    placed = counts.withColumn("to", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(whole))
    n = F.col("n")
    at = {"nearest": F.ceil(n * q) - 1, "rounded": F.rint((n - 1) * q), "floored": F.floor(n * q) - 1}[kind].cast("long")
    at = F.greatest(F.lit(0), F.least(n - 1, at))
    return placed.where((at >= F.col("to") - F.col("c")) & (at < F.col("to"))).select(*by, "n", F.col(value).alias("percentile"))


def majority_vote(rows: DataFrame, group: str) -> DataFrame:
    """group, pred of most rows; ties by summed confidence, then label order. rows have `p`."""
    votes = predicted(rows).groupBy(group, "pred").agg(F.count("*").alias("votes"), F.sum(F.array_max("p")).alias("confidence"))
    best = F.max_by(F.struct("pred", "votes", "confidence"), F.struct("votes", "confidence", (-F.col("pred")).alias("o")))
    return votes.groupBy(group).agg(best.alias("b")).select(group, "b.pred", "b.votes", "b.confidence")


def policy_delta(rows: DataFrame, key: list[str], policy: str, control: str) -> DataFrame:
    """Against the control policy's row of the same key: rows, changed, corrections, regressions per policy."""
    base = rows.where(F.col(policy) == control).select(*key, F.col("pred").alias("pred0"))
    both = rows.join(base, key)
    ok, ok0 = F.col("pred") == F.col("truth"), F.col("pred0") == F.col("truth")
    return both.groupBy(policy).agg(F.count("*").alias("n"), F.count_if(F.col("pred") != F.col("pred0")).alias("changed"), F.count_if(ok & ~ok0).alias("corrections"), F.count_if(~ok & ok0).alias("regressions"))


def transitions(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Samples found by one model only: recovered (old 0, new > 0), lost (old > 0, new 0)."""
    both = old.select(key, F.col(value).alias("o")).join(new.select(key, F.col(value).alias("n")), key)
    return both.agg(F.count("*").alias("samples"), F.count_if(F.expr("o = 0 and n > 0")).alias("recovered"), F.count_if(F.expr("o > 0 and n = 0")).alias("lost"), F.count_if(F.expr("o = n")).alias("same"))


def weighted_average(parts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """parts (model, key, pos, value): convex combination per (key, pos). Weights are not negative and sum to 1."""
    if abs(sum(weights.values()) - 1) > 1e-9 or min(weights.values()) < 0:
        raise ValueError("weights must not be negative and must sum to 1")
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
    return parts.where(F.col("model").isin(*weights)).groupBy("key", "pos").agg(F.sum(F.col("value") * F.element_at(w, F.col("model"))).alias("value"))


def blend(base: DataFrame, other: DataFrame, alpha: float) -> DataFrame:
    """(1 - alpha) * base + alpha * other per (key, pos); both must hold the same keys."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be between 0 and 1")
    return base.select("key", "pos", F.col("value").alias("a")).join(other.select("key", "pos", F.col("value").alias("b")), ["key", "pos"]).select("key", "pos", (F.col("a") * (1 - alpha) + F.col("b") * alpha).alias("value"))


def best_epoch(rows: DataFrame, score: str, epoch: str) -> DataFrame:
    """The first epoch of the largest score."""
    return rows.agg(F.max_by(F.struct(epoch, score), F.struct(F.col(score), -F.col(epoch))).alias("b")).select("b.*")


def snapshot_digest(rows: DataFrame, path_col: str, digest_col: str, by: list[str] | None = None) -> DataFrame:
    """SHA-256 of the lines `path\\0digest` in path order, joined by line breaks (per group, if any)."""
    by = by or []
    line = F.struct(F.col(path_col).alias("k"), F.concat(F.col(path_col).cast("string"), F.decode(F.unhex(F.lit("00")), "UTF-8"), F.col(digest_col)).alias("line"))
    return rows.groupBy(*by).agg(F.count("*").alias("files"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda s: s["line"]), "\n"), 256).alias("digest"))


def tree_digest(rows: DataFrame, path_col: str, digest_col: str, fan: int = 1000, levels: int = 3) -> DataFrame:
    """files, digest of a whole table, one row: a tree of SHA-256 digests over the lines `path\\0digest` in path order.

    A leaf is the digest of `fan` lines joined by line breaks, a node that of the digests of `fan` nodes below it; there are `levels` levels above the
    lines, more where the top would not be one. So no task sees more than `fan` lines, and two tables differ where their leaves do.
    """
    nul = F.decode(F.unhex(F.lit("00")), "UTF-8")
    lines = rows.select(F.lit(0).alias("all"), F.col(path_col).alias("k"), F.concat(F.col(path_col).cast("string"), nul, F.col(digest_col)).alias("line"))
    nodes = group_ordinals(lines, "all", [F.col("k"), F.col("line")], "nth").select((F.col("nth") - 1).alias("nth"), "line", F.lit(1).cast("bigint").alias("files"))
    level = 0
    while True:
        part = F.struct("nth", "line")
        up = nodes.groupBy(F.floor(F.col("nth") / fan).alias("nth")).agg(F.sum("files").alias("files"), F.sort_array(F.collect_list(part)).alias("lines"))
        nodes = cut(up.select("nth", F.sha2(F.array_join(F.transform("lines", lambda s: s["line"]), "\n"), 256).alias("line"), "files"))
        level += 1
        if level >= levels and nodes.where("nth > 0").isEmpty():
            return nodes.select("files", F.col("line").alias("digest"))


def group_sizes(rows: DataFrame, label: str, group: str) -> DataFrame:
    """label, groups, largest, rows: how a label's rows fall into groups."""
    per = rows.groupBy(label, group).agg(F.count("*").alias("n"))
    return per.groupBy(label).agg(F.count("*").alias("groups"), F.max("n").alias("largest"), F.sum("n").alias("rows"))


def head_of(rows: DataFrame, order: str, n: int = 32) -> DataFrame:
    """The first n rows in order: a report's examples."""
    return rows.orderBy(order).limit(n)
