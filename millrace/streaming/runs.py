"""Streams over files that come in slices, started again and again on one checkpoint, and a sink that shows every event once.

A start takes what is new in its feeds and ends; the next goes on from the checkpoint with the state, watermark and offsets of
the last. Feeds, checkpoints and results are folders that all executors share.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.storage import exists, fresh_path, make_dir, names, write_text
from millrace.streaming.windows import first_events

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State processors need a store with column families; the session's own setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class Feed:
    """A folder of Parquet files that a stream reads; slices are added to it."""

    def __init__(self, rows: DataFrame, name: str):
        self.spark, self.schema = rows.sparkSession, rows.schema
        self.path = make_dir(self.spark, fresh_path(self.spark, f"feed-{name}"))

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(self.path)


def slices(rows: DataFrame, order: Column, n: int) -> list[DataFrame]:
    """rows in n parts by ranges of a number; equal numbers stay together, and those without go first."""
    at = order.cast("double")
    bounds = rows.select(at.alias("at")).where("at is not null").approxQuantile("at", [i / n for i in range(1, n)], 0.01)
    edges = [None, *sorted(set(bounds)), None]
    out = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        part = rows if hi is None else rows.where(at.isNull() | (at <= hi) if lo is None else at <= hi)
        out.append(part if lo is None else part.where(at > lo))
    return out


def advance(out: DataFrame, checkpoint: str, path: str | None = None, each: Callable[[DataFrame, int], None] | None = None) -> list[dict]:
    """One start: everything that is new, to Parquet files at path or batch by batch to `each`; the progress of its batches."""
    writer = out.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    run = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", path).start()
    run.awaitTermination()
    return [dict(p) for p in run.recentProgress]


def in_starts(feeds: list[Feed], parts: list[tuple[DataFrame, ...]], out: DataFrame, name: str) -> DataFrame:
    """Adds the parts to the feeds, one tuple for each start of the query, and gives its rows after a last start without news."""
    spark = out.sparkSession
    checkpoint, path = fresh_path(spark, f"{name}-checkpoint"), fresh_path(spark, f"{name}-rows")
    for part in [*parts, ()]:
        for feed, rows in zip(feeds, part, strict=False):
            feed.add(rows)
        advance(out, checkpoint, path)
    return spark.read.schema(out.schema).parquet(path)


class IdempotentSink:
    """foreachBatch sink: an event is shown once, whatever is sent or run again.

    A batch writes its rows to a folder of its own number and then a commit mark of that number; only marked folders are read. A
    batch that broke off before its mark is written again in the same place, one that has its mark does nothing. Of the events of a batch the first in
    `order` counts, and events that a marked batch before it has shown are left out (a shuffled anti join on ids).
    """

    def __init__(self, spark: SparkSession, path: str, id_col: str, order: str, before_commit: Callable[[int], None] | None = None):
        self.spark, self.path, self.id_col, self.order, self.before_commit = spark, path, id_col, order, before_commit

    def _mark(self, batch_id: int) -> str:
        return f"{self.path}/commits/{batch_id}"

    def _folders(self) -> list[str]:
        marks = f"{self.path}/commits"
        return [f"{self.path}/rows/{b}" for b in sorted(map(int, names(self.spark, marks)))] if exists(self.spark, marks) else []

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if exists(spark, self._mark(batch_id)):
            return
        rows = first_events(batch, self.id_col, self.order)
        if shown := self._folders():
            rows = rows.join(spark.read.schema(rows.schema).parquet(*shown).select(self.id_col).hint("merge"), self.id_col, "left_anti")
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/{batch_id}")
        if self.before_commit:
            self.before_commit(batch_id)
        write_text(spark, self._mark(batch_id), "")

    def rows(self, schema) -> DataFrame:
        """What marked batches have shown."""
        shown = self._folders()
        return self.spark.read.schema(schema).parquet(*shown) if shown else self.spark.createDataFrame([], schema)
