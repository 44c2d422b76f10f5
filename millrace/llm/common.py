"""Shared helpers of the training-data operators: tables, shared folders, checkpoints."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.storage import cut, fresh_path, shared_dir, table

__all__ = ["cut", "dealt", "fresh_path", "partitions", "release", "remainder", "rows_with", "shared_dir", "table", "tidy", "trim", "unused"]

#: What a Python worker keeps from task to task of one operator (tokenizers with their caches).
KEPT: dict = {}


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """In a task: a Python worker, which Spark keeps for later tasks, gives back the memory that it has freed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        pass


def tidy(run: Callable, keep: bool = False) -> Callable:
    """run, for mapInArrow, in a worker that gives back freed memory before it, at every batch and when it ends.

    What tasks of other operators have left in KEPT goes too, unless run itself keeps something there. Workers that wait for
    a task hold memory of their executor like those that work.
    """

    @functools.wraps(run)
    def held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                trim()
                yield batch

        if not keep:
            KEPT.clear()
        trim()
        try:
            yield from run(each())
        finally:
            trim()

    return held


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def dealt(df: DataFrame, part=None) -> DataFrame:
    """Rows of bucket b in partition b mod n: packed rows spread evenly, which hashing a few numbers would not do."""
    return df.repartitionById(partitions(df.sparkSession), F.col("bucket") if part is None else part)


def remainder(doc_id, m: int):
    """crc32(doc_id as text) mod m, as the split of labelled rows is defined; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(m)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def rows_with(df: DataFrame, extra: str) -> str:
    """Schema text of df's columns and one more."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), extra])
