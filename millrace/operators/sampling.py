"""Deterministic sampling, splits and allocation: no result depends on the order of the input."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.hashing import stable_key
from millrace.sources.storage import cut, unused

# Fixed order of splits; earlier ones win ties.
SPLITS = ("train", "val_select", "val_cal")


def largest_remainder(total: int, ratios: Sequence[float]) -> list[int]:
    """Whole shares of a total; what is left over goes to the largest fractions, earlier ones first."""
    exact = [total * r for r in ratios]
    shares = [int(x) for x in exact]
    for i in sorted(range(len(ratios)), key=lambda i: -(exact[i] - shares[i]))[: total - sum(shares)]:
        shares[i] += 1
    return shares


def target_counts(total: Column, ratios: Sequence[float]) -> Column:
    """largest_remainder() of a column: array<long>."""
    exact = [total * F.lit(r) for r in ratios]
    base = [F.floor(x) for x in exact]
    left = total - sum(base[1:], base[0])
    out = []
    for i, (x, b) in enumerate(zip(exact, base, strict=True)):
        ahead = [((y - c) > (x - b)) | (((y - c) == (x - b)) & F.lit(j < i)) for j, (y, c) in enumerate(zip(exact, base, strict=True)) if j != i]
        rank = sum((a.cast("int") for a in ahead), F.lit(0))
        out.append((b + F.when(rank < left, 1).otherwise(0)).cast("long"))
    return F.array(*out)


def rounded_targets(total: int, ratios: Sequence[float]) -> list[int]:
    """Shares rounded half to even; the last gets the remainder."""
    shares = [round(total * r) for r in ratios[:-1]]
    return [*shares, total - sum(shares)]


def rounded_shares(total: Column, ratios: Sequence[float]) -> Column:
    """rounded_targets() of a column: array<long>."""
    shares = [F.rint(total * F.lit(r)) for r in ratios[:-1]]
    return F.array(*[s.cast("long") for s in shares], (total - sum(shares, F.lit(0.0))).cast("long"))


def hash_top_n(rows: DataFrame, by: str, key: str, n: int, seed: int | str) -> DataFrame:
    """The n rows of each stratum with the smallest stable keys.

    A top-n per stratum is a window with a rank limit, which Spark applies before the shuffle, too.
    """
    w = Window.partitionBy(by).orderBy(stable_key(seed, F.col(key)), key)
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def even_positions(n: Column, k: int) -> Column:
    """k evenly spaced positions of 0..n-1, ends included (distinct while k <= n)."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / F.lit(max(1, k - 1))).cast("long"))


def evenly_spaced(rows: DataFrame, by: str, order: str, k: int) -> DataFrame:
    """k rows of each group, evenly spaced in `order`; all rows of groups that have fewer (see short_groups)."""
    sizes = cut(rows.groupBy(by).agg(F.count("*").alias("size")))
    placed = group_ordinals(rows, by, [F.col(order)], "at").withColumn("at", F.col("at") - 1).join(sizes, by)
    return placed.where((F.col("size") < k) | F.array_contains(even_positions(F.col("size"), k), F.col("at")))


def short_groups(rows: DataFrame, by: str, k: int) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("size")).where(F.col("size") < k)


def oversample(rows: DataFrame, by: str, key: str, target: int, seed: int | str) -> DataFrame:
    """Each group's rows once, then repeated in stable order until it has `target` rows: adds repeat and ordinal."""
    sizes = cut(rows.groupBy(by).agg(F.count("*").alias("size")))
    placed = group_ordinals(rows, by, [stable_key(seed, F.col(key)), F.col(key)], "nth").withColumn("nth", F.col("nth") - 1).join(sizes, by)
    times = F.greatest(F.lit(1), F.floor((F.lit(target) - F.col("nth") - 1) / F.col("size")) + 1)
    return placed.select("*", F.explode(F.sequence(F.lit(0), (times - 1).cast("int"))).alias("repeat")).withColumn("ordinal", (F.col("repeat") * F.col("size") + F.col("nth")).cast("long")).drop("nth")


def round_robin(n: Column, need: Column) -> Column:
    """Parents (0..n-1) of `need` augmented rows, in turn."""
    return F.transform(F.sequence(F.lit(0), (need - 1).cast("int")), lambda i: (i % n).cast("long"))


def allocate_groups(groups: DataFrame, ratios: Sequence[float], seed: int | str, by: str = "label", member_key: str = "member_key") -> DataFrame:
    """Groups (by, group, size, member_key) to splits: largest first, then by stable key, each to the split that
    leaves the least sum of (projected - target)^2 / max(1, target); earlier splits win ties. Sums are compared exactly, as fractions.

    Groups of one size are told apart by their order alone. A split's next groups of that size cost more and more, in even steps, so the choices for
    all of them are the splits' costs merged in order: the n-th least cost takes the n-th group. What a size takes from where is found for each label from the
    histogram of its sizes (at most the root of twice its rows), the places of each choice are counted by formula, and
    groups meet them by ordinal. No label's groups pass one task.
    """
    n, kind = len(ratios), groups.schema[by].dataType.simpleString()
    rows = groups.select(F.col(by).alias("by"), "group", F.col("size").cast("bigint").alias("size"), stable_key(seed, F.col(member_key)).alias("h"))
    rows = cut(rows.where("size > 0"))
    sizes = rows.groupBy("by", "size").agg(F.count("*").alias("n"))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False)
        histogram = [(int(s), int(m)) for s, m in zip(pdf["size"], pdf["n"], strict=True)]
        goals = largest_remainder(sum(s * m for s, m in histogram), ratios)
        weights, counts, out = [max(1, g) for g in goals], [0] * n, []
        for size, m in histogram:
            base = [2 * (c - g) + size for c, g in zip(counts, goals, strict=True)]  # a split's k-th group costs (base + 2 * k * size) / weight
            taken = [_taken(base, weights, 2 * size, m, s) for s in range(n)]
            out += [(pdf["by"].iloc[0], size, s, taken[s], base, weights) for s in range(n) if taken[s]]
            counts = [c + size * t for c, t in zip(counts, taken, strict=True)]
        return pd.DataFrame(out, columns=["by", "size", "split", "taken", "base", "weights"])

    plans = sizes.groupBy("by").applyInPandas(plan, f"by {kind}, size bigint, split int, taken bigint, base array<bigint>, weights array<bigint>")
    # Ordinals of a split's choices, written out by runs of a bounded length so that a size held by very many groups is spread.
    run = 1 << 16
    runs = plans.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("taken") - 1) / run))).alias("run")).repartition("by", "size", "split", "run")
    each = runs.select("*", F.explode(F.sequence(F.col("run") * run, F.least(F.col("taken"), (F.col("run") + 1) * run) - 1)).alias("k"))
    wide = lambda c: c.cast("decimal(38,0)")
    step, mine = wide(2 * F.col("size")), wide(F.get("weights", F.col("split")))
    cost = wide(F.get("base", F.col("split"))) + step * wide(F.col("k"))
    place = F.col("k")
    for s in range(n):
        room, unit = cost * wide(F.get("weights", F.lit(s))) - mine * wide(F.get("base", F.lit(s))), mine * step
        room = wide(room + F.when(F.lit(s) < F.col("split"), unit).otherwise(unit - 1))  # on a tie the earlier split is first
        ahead = wide(room - F.pmod(room, wide(unit))) / wide(unit)
        place = place + F.when(F.col("split") == s, 0).otherwise(F.greatest(F.lit(0), F.round(ahead).cast("bigint")))
    choices = each.select("by", "size", "split", (place + 1).alias("nth"))
    keyed = rows.withColumn("kind", F.struct("by", "size"))
    placed = group_ordinals(keyed, "kind", [F.col("h"), F.col("group")], "nth")
    c = choices.select(F.col("by").alias("by_"), F.col("size").alias("size_"), F.col("nth").alias("nth_"), "split")
    both = placed.join(c, F.col("by").eqNullSafe(F.col("by_")) & (F.col("size") == F.col("size_")) & (F.col("nth") == F.col("nth_")))
    return both.select(F.col("by").alias(by), "group", "size", F.get(F.array(*[F.lit(x) for x in SPLITS]), F.col("split")).alias("split"))


def _taken(base: list[int], weights: list[int], step: int, m: int, s: int) -> int:
    """How many of the m cheapest choices are split s's: the first k whose cost has m others or more before it."""

    def before(k: int) -> int:
        cost, n = base[s] + step * k, k
        for t, (b, w) in enumerate(zip(base, weights, strict=True)):
            if t != s:
                room, unit = cost * w - weights[s] * b, weights[s] * step
                n += max(0, (room + (unit if t < s else unit - 1)) // unit)
        return n

    lo, hi = 0, m
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if before(mid) >= m else (mid + 1, hi)
    return lo


def ratio_fill(groups: DataFrame, ratios: Sequence[float], seed: int | str, by: str = "label", member_key: str = "member_key", block: int = 100_000) -> DataFrame:
    """Groups in stable order, each to the split with the smallest count / max(target, 1); earlier splits win ties.

    Each choice depends on all before it, so they are made block by block: a task folds at most `block` groups of a label, and the splits' counts so far
    (one row for each label) go on to the next block.
    """
    kind, id_kind = groups.schema[by].dataType.simpleString(), groups.schema["group"].dataType.simpleString()
    rows = groups.select(F.col(by).alias("by"), "group", F.col("size").cast("bigint").alias("size"), stable_key(seed, F.col(member_key)).alias("h"))
    rows = cut(group_ordinals(rows, "by", [F.col("h"), F.col("group")], "nth").withColumn("block", F.floor((F.col("nth") - 1) / block)))
    totals = rows.groupBy("by").agg(F.sum("size").alias("total"))
    zero = F.array(*[F.lit(0).cast("bigint")] * len(ratios))
    carry = cut(totals.select(F.col("by").alias("of"), "total", zero.alias("counts")))
    last = rows.agg(F.max("block").alias("n")).first().n

    def fold(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("nth")
        if left.empty:
            return left.assign(split=0)[["by", "group", "size", "split"]]
        goals = [max(1.0, float(g)) for g in rounded_targets(int(right["total"].iloc[0]), ratios)]
        counts, split = list(map(int, right["counts"].iloc[0])), []
        for size in left["size"].tolist():
            shares = [c / g for c, g in zip(counts, goals, strict=True)]
            split.append(shares.index(min(shares)))
            counts[split[-1]] += size
        return left.assign(split=split)[["by", "group", "size", "split"]]

    out = None
    for b in range(0 if last is None else last + 1):
        here = rows.where(F.col("block") == b)
        done = cut(here.groupBy("by").cogroup(carry.groupBy("of")).applyInPandas(fold, f"by {kind}, group {id_kind}, size bigint, split int"))
        out = done if out is None else out.unionAll(done)
        if b < last:
            more = done.groupBy(F.col("by").alias("by_")).agg(*[F.sum(F.when(F.col("split") == s, F.col("size")).otherwise(0)).alias(f"s{s}") for s in range(len(ratios))])
            moved = carry.join(more, F.col("of").eqNullSafe(F.col("by_")), "left")
            carry = cut(moved.select("of", "total", F.array(*[F.get("counts", F.lit(s)) + F.coalesce(f"s{s}", F.lit(0)) for s in range(len(ratios))]).alias("counts")))
    if out is None:
        out = rows.select("by", "group", "size", F.lit(0).alias("split"))
    return out.select(F.col("by").alias(by), "group", "size", F.get(F.array(*[F.lit(x) for x in SPLITS]), F.col("split")).alias("split"))


def select_views(parents: DataFrame) -> DataFrame:
    """One view per parent. parents: parent_id, background (bool), known_other (bool), boxes (int), short_side (int), minimum (int).

    Adds selected (crop or original) and reason.
    """
    none = F.coalesce(F.col("boxes"), F.lit(0)) == 0
    policy = F.col("background") & ~F.col("known_other")
    reason = F.when(none, "detector_miss_or_invalid_fallback").when(policy, "background_original_policy").when(F.col("short_side") < F.col("minimum"), "crop_quality_fallback").otherwise("crop_selected_instead")
    return parents.withColumn("reason", reason).withColumn("selected", F.when(F.col("reason") == "crop_selected_instead", "crop").otherwise("original"))


def group_ordinals(rows: DataFrame, by: str, order: list[Column], name: str) -> DataFrame:
    """Adds `name`: 1, 2, ... within each group, in order.

    Rows are dealt by ranges of (group, order), so a group with a third of all rows is sorted by many tasks: each task
    numbers its own rows, and the counts of the ranges before are added. The order must be total.
    """
    at, part_, first, n, by_, shift, here_, *names = unused(rows.withColumn(name, F.lit(0)), "at", "part", "first", "n", "of_group", "shift", "in_part", *(f"order{i}" for i in range(len(order))))
    keys = dict(zip(names, order, strict=True))
    placed = rows.withColumns(keys).repartitionByRange(F.col(by), *names).sortWithinPartitions(by, *names).drop(*names)
    placed = cut(placed.withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, 33)
    ranges = cut(placed.groupBy(by, part.alias(part_)).agg(F.min(at).alias(first), F.count("*").alias(n)))
    before = F.coalesce(F.sum(n).over(Window.partitionBy(by).orderBy(part_).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = cut(ranges.select(F.col(by).alias(by_), part_, (before + 1 - F.col(first)).alias(shift)))
    here = placed.withColumn(here_, part)
    both = here.join(ranges, F.col(by).eqNullSafe(F.col(by_)) & (F.col(here_) == F.col(part_)))
    return both.withColumn(name, (F.col(at) + F.col(shift)).cast("bigint")).drop(at, here_, by_, part_, shift)


def numbered(rows: DataFrame, by: str, order: str, prefix: Column, width: int = 6) -> DataFrame:
    """Adds `name`: prefix and a zero-padded ordinal in each group."""
    (nth,) = unused(rows, "nth")
    placed = group_ordinals(rows, by, [F.col(order)], nth)
    return placed.withColumn("name", F.concat_ws("-", prefix, F.lpad(F.col(nth).cast("string"), width, "0"))).drop(nth)


def batches(rows: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """Adds `batch`: group and number of the batch of `size` rows, three digits."""
    (nth,) = unused(rows, "nth")
    placed = group_ordinals(rows, by, [F.col(order)], nth)
    return placed.withColumn("batch", F.format_string("%s-%03d", F.col(by), (F.floor((F.col(nth) - 1) / size) + 1).cast("int"))).drop(nth)


def hash_slices(rows: DataFrame, key: str, parts: int, seed: int | str, by: str | None = None) -> DataFrame:
    """Adds `slice`: rows in stable order dealt to `parts` slices whose sizes differ by one at most.

    Takes the place of an even split of a shuffled list.
    """
    one, nth = unused(rows, "all_rows", "nth")
    scope = by or one
    rows = rows if by else rows.withColumn(scope, F.lit(0))
    placed = group_ordinals(rows, scope, [stable_key(seed, F.col(key)), F.col(key)], nth)
    out = placed.withColumn("slice", ((F.col(nth) - 1) % parts).cast("int")).drop(nth)
    return out if by else out.drop(scope)


def augmentation_plan(rows: DataFrame, by: str, key: str, target: int, seed: int | str) -> DataFrame:
    """by, key, times: augmented rows of each parent, in turn until the group has `target` rows; one each at least."""
    nth, size = unused(rows, "nth", "size")
    sizes = cut(rows.groupBy(by).agg(F.count("*").alias(size)))
    placed = group_ordinals(rows, by, [stable_key(seed, F.col(key)), F.col(key)], nth).join(sizes, by)
    need = F.greatest(F.col(size), F.lit(target) - F.col(size))
    return placed.select(by, key, (F.floor((need - F.col(nth)) / F.col(size)) + 1).cast("long").alias("times"))
