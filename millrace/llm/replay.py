"""Transaction log reassembly: undo intervals, survivors of transactions, and the store after each epoch.

A log's records stand in one order; each source runs transactions one after another. A rollback is paired with its savepoint by depth: the depth of open
savepoints is a running sum that never falls below zero, and at one depth of one transaction savepoints and rollbacks alternate. The pair is an undo
interval; where no savepoint is open, the interval reaches back to the last such rollback or the transaction's start. Changes meet the intervals of their
transaction in a range join that is a merge: at its own depth a change lies in one interval at most, that of the earliest rollback which undoes it, so the
first rollback behind it is looked up and its interval must reach over the change. No pairs are made. What survives is reduced for each key and epoch.

Scale: records are narrow (texts stay behind as a checksum). The log is dealt once into ranges of its order, one for each shuffle partition ("blocks"), and
written. Every running value (depth, end of a transaction, number of a commit, value of a key) is taken inside blocks, and what a block hands on is one row
for each source, transaction or key in it. So a source, a transaction or a key of any size is spread over all tasks; a task that combines blocks sees at most one
row a block, which is a setting and does not grow with the input. No window lacks a partition but those over the blocks' own totals.

Nulls: a row without id is no record; a null source is one source; a null text deletes its key. Records of one id stand in the order of source
and checksum; equal rows are records each. Labels: a row with toxic 1 among several suffices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, partitions, table

COMMIT, ABORT, SAVEPOINT, ROLLBACK, CHANGE = "commit", "abort", "savepoint", "rollback", "change"
KEYS = 300
EPOCH = 4


def records(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """id, source, kind, key, value (checksum of what is stored, null where the key is deleted) of documents read as a log."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    m = h % 23
    kind = F.when(m <= 1, COMMIT).when(m == 2, ABORT).when(m <= 4, SAVEPOINT).when(m <= 6, ROLLBACK).otherwise(CHANGE)
    key = F.floor(h / 100) % KEYS
    value = F.crc32(F.concat(key.cast("string"), F.lit(":"), "text").cast("binary"))
    toxic = labels.where("toxic = 1 and doc_id is not null").select(F.col("doc_id").alias("id")).distinct().withColumn("toxic", F.lit(True))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source"), kind.alias("kind"), F.when(kind == CHANGE, key).alias("key"), F.when(kind == CHANGE, value).alias("value"))
    return rows.join(toxic.hint("merge"), "id", "left").withColumn("value", F.when(F.col("toxic").isNull(), F.col("value"))).drop("toxic")


def ordered(rows: DataFrame) -> DataFrame:
    """rows with at (place in the log, increasing) and block, written to the shared folder."""
    n = partitions(rows.sparkSession)
    order = ["id", "source", "kind", "key", "value", "copy"]
    dealt = rows.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    return cut(dealt.drop("copy").withColumn("at", F.monotonically_increasing_id()).withColumn("block", F.shiftright("at", 33).cast("int")))


def _over(keys: list[str], order: str = "at"):
    return Window.partitionBy(*keys).orderBy(order)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys, null equal to null; b has the keys and new columns."""
    renamed = b.select(*[F.col(k).alias(f"{k}__") for k in keys], *[c for c in b.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys]
    both = a.join(renamed.hint("merge"), on, "left")
    return both.drop(*[f"{k}__" for k in keys])


def _first_behind(rows: DataFrame, group: list[str], wanted: Column, what: Column, name: str) -> DataFrame:
    """Adds `what` (a struct led by at) of the first wanted row of the group at or behind each row: inside the block, else from later blocks."""
    rows = rows.withColumn("mark__", F.when(wanted, what))
    here = [*group, "block"]
    rows = rows.withColumn("here__", F.min("mark__").over(_over(here).rowsBetween(0, Window.unboundedFollowing)))
    firsts = rows.groupBy(*here).agg(F.min("mark__").alias("first__"))
    later = firsts.withColumn("later__", F.min("first__").over(_over(group, "block").rowsBetween(1, Window.unboundedFollowing))).drop("first__")
    return _same(rows, later, here).withColumn(name, F.coalesce("here__", "later__")).drop("mark__", "here__", "later__")


def _last_before(rows: DataFrame, group: list[str], wanted: Column, what: Column, name: str) -> DataFrame:
    """Adds `what` of the last wanted row of the group before each row."""
    rows = rows.withColumn("mark__", F.when(wanted, what))
    here = [*group, "block"]
    rows = rows.withColumn("here__", F.max("mark__").over(_over(here).rowsBetween(Window.unboundedPreceding, -1)))
    lasts = rows.groupBy(*here).agg(F.max("mark__").alias("last__"))
    earlier = lasts.withColumn("earlier__", F.max("last__").over(_over(group, "block").rowsBetween(Window.unboundedPreceding, -1))).drop("last__")
    return _same(rows, earlier, here).withColumn(name, F.coalesce("here__", "earlier__")).drop("mark__", "here__", "earlier__")


def with_transactions(log: DataFrame) -> DataFrame:
    """log with end: (at, id, kind) of the commit or abort that ends the record's transaction, null where the log ends first."""
    ends = F.col("kind").isin(COMMIT, ABORT)
    return _first_behind(log, ["source"], ends, F.struct("at", "id", "kind"), "end")


def with_depth(rows: DataFrame) -> DataFrame:
    """rows (records of transactions: source, end_at) with level: the depth a change stands at, a savepoint opens or a rollback closes; 0: no savepoint is open.

    The running sum s of +1 and -1 is held at zero by its running minimum m: depth = s - min(0, m).
    """
    txn = ["source", "end_at"]
    here = [*txn, "block"]
    step = F.when(F.col("kind") == SAVEPOINT, 1).when(F.col("kind") == ROLLBACK, -1).otherwise(0)
    w = _over(here)
    up, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("step__", step).withColumn("s__", F.sum("step__").over(up))
    rows = rows.withColumn("m__", F.min("s__").over(before))  # of the rows before, in the block
    blocks = rows.groupBy(*here).agg(F.sum("step__").alias("sum__"), F.min("s__").alias("min__"))
    back = _over(txn, "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("s0__", F.coalesce(F.sum("sum__").over(back), F.lit(0))).withColumn("low__", F.col("s0__") + F.col("min__"))
    blocks = blocks.withColumn("m0__", F.least(F.lit(0), F.coalesce(F.min("low__").over(back), F.lit(0)))).drop("sum__", "min__", "low__")
    rows = _same(rows, blocks, here)
    s = F.col("s0__") + F.col("s__")
    low = F.least("m0__", F.coalesce(F.col("s0__") + F.col("m__"), F.lit(0)))  # lowest sum before the row
    level = F.when(F.col("kind") != ROLLBACK, s - low).when(s < low, 0).otherwise(s + 1 - low)
    return rows.withColumn("level", level.cast("long")).drop("step__", "s__", "m__", "s0__", "m0__")


def undo_intervals(rows: DataFrame) -> DataFrame:
    """One row for each rollback of rows (with levels): source, end_at, level, block, at, id, since: it undoes changes between since and at.

    At level 0 an interval begins at the last rollback of that level, which undid all before it, or at -1, the start.
    """
    group = ["source", "end_at", "level"]
    marks = rows.where(F.col("kind").isin(SAVEPOINT, ROLLBACK)).select(*group, "block", "at", "id", "kind")
    opens = F.when(F.col("level") == 0, F.col("kind") == ROLLBACK).otherwise(F.col("kind") == SAVEPOINT)
    paired = _last_before(marks, group, opens, F.col("at"), "since")
    return paired.where(F.col("kind") == ROLLBACK).withColumn("since", F.coalesce("since", F.lit(-1)))


def fates(log: DataFrame) -> DataFrame:
    """Every change with undone_by (struct at, id of the earliest rollback whose interval holds it, or null) and end (of its transaction)."""
    rows = cut(with_transactions(log).withColumn("end_at", F.col("end.at")).where(~F.col("kind").isin(COMMIT, ABORT)))
    rows = cut(with_depth(rows))
    group = ["source", "end_at", "level"]
    intervals = cut(undo_intervals(rows)).withColumn("what", F.lit(1))
    changes = rows.where(F.col("kind") == CHANGE).select(*group, "block", "at", "id", "key", "value", "end", F.lit(0).alias("what"))
    both = changes.unionByName(intervals.select(*group, "block", "at", "id", "what", "since"), allowMissingColumns=True)
    met = _first_behind(both, group, F.col("what") == 1, F.struct("at", "id", "since"), "by").where("what = 0")
    holds = (F.col("by.since") < F.col("at")) & (F.col("at") < F.col("by.at"))
    return met.select("id", "at", "key", "value", "end", F.when(holds, F.col("by")).alias("undone_by"))


def _running(blocks: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the sum of value over earlier blocks; one row for each block, so the window's size is a setting."""
    return blocks.withColumn(name, F.coalesce(F.sum(value).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def commit_epochs(log: DataFrame, every: int = EPOCH) -> DataFrame:
    """commit_at, epoch (from 1, `every` commits of the whole log each) and span: a range of epochs, as many as there are blocks."""
    commits = log.where(F.col("kind") == COMMIT).select("at", "block")
    n = partitions(log.sparkSession)
    blocks = _running(commits.groupBy("block").agg(F.count("*").alias("own")), "own", "earlier")
    blocks = blocks.withColumn("all", F.sum("own").over(Window.partitionBy())).drop("own")
    numbered = _same(commits.withColumn("nth", F.row_number().over(_over(["block"]))), blocks, ["block"])
    epoch = F.floor((F.col("earlier") + F.col("nth") - 1) / every) + 1
    last = F.floor((F.col("all") - 1) / every) + 1
    return numbered.select(F.col("at").alias("commit_at"), epoch.alias("epoch"), F.floor((epoch - 1) * n / last).cast("int").alias("block"))


def store_states(changes: DataFrame, epochs: DataFrame) -> DataFrame:
    """epoch, n (stored keys), value (sum of their checksums) after each epoch. changes: commit_at, at, key, value of what survived."""
    placed = _same(changes, epochs, ["commit_at"])
    last = placed.groupBy("key", "epoch", "block").agg(F.max(F.struct("commit_at", "at", "value")).alias("v")).select("key", "epoch", "block", F.col("v.value").alias("value"), F.col("epoch").alias("at"))
    # what a key held before: a struct that orders by epoch, so the last one is the largest
    held = _last_before(last, ["key"], F.lit(True), F.struct("epoch", "value"), "old")
    known = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    moves = held.select("epoch", "block", (F.col("value").isNotNull().cast("long") - F.coalesce(F.col("old.value").isNotNull(), F.lit(False)).cast("long")).alias("n"), (known(F.col("value")) - known(F.col("old.value"))).alias("value"))
    none = F.lit(0).cast("long")
    sums = epochs.select("epoch", "block", none.alias("n"), none.alias("value")).unionByName(moves).groupBy("epoch", "block").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    totals = sums.groupBy("block").agg(F.sum("n").alias("n_own"), F.sum("value").alias("v_own"))
    totals = _running(_running(totals, "n_own", "n_before"), "v_own", "v_before").drop("n_own", "v_own")
    inside = _over(["block"], "epoch").rowsBetween(Window.unboundedPreceding, 0)
    run = sums.withColumn("n", F.sum("n").over(inside)).withColumn("value", F.sum("value").over(inside))
    return _same(run, totals, ["block"]).select("epoch", (F.col("n") + F.col("n_before")).alias("n"), (F.col("value") + F.col("v_before")).alias("value"))


def reassemble(log: DataFrame, every: int = EPOCH) -> DataFrame:
    """log: id, source, kind, key, value (null: the key is deleted). kind, id, n, value: states of epochs and undone changes, as the query's contract has them."""
    log = ordered(log)
    changes = cut(fates(log))
    by, end = F.col("undone_by"), F.col("end")
    undone = changes.where(by.isNotNull()).select(F.lit(ROLLBACK).alias("kind"), "id", F.col("undone_by.id").alias("n"), F.col("key").alias("value"))
    aborted = changes.where(by.isNull() & (end.isNull() | (F.col("end.kind") == ABORT))).select(F.lit(ABORT).alias("kind"), "id", F.col("end.id").alias("n"), F.col("key").alias("value"))
    alive = changes.where(by.isNull() & (F.col("end.kind") == COMMIT)).select(F.col("end.at").alias("commit_at"), "at", "key", "value")
    states = store_states(alive, cut(commit_epochs(log, every))).select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), "n", "value")
    return states.unionByName(undone).unionByName(aborted)


def op11_undo_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return reassemble(records(docs, labels)).select("kind", *[F.col(c).cast("long").alias(c) for c in ("id", "n", "value")])
