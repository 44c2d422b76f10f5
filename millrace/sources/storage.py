"""Shared folder, checkpoints and fresh paths."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the one already set on the context.

    Only a local master, whose executors are the driver, gets a temporary folder of its own where neither is set.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder: cuts lineage and survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """One small text file (a report, a configuration) in any file system that Spark reads."""
    p, fs = _hadoop(spark, path)
    out = fs.create(p, overwrite)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, whole."""
    p, fs = _hadoop(spark, path)
    source = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def make_dir(spark: SparkSession, path: str) -> str:
    p, fs = _hadoop(spark, path)
    fs.mkdirs(p)
    return path


def folder_uri(spark: SparkSession, path: str) -> str:
    """The full name of a folder, as it begins the paths of its files; what is no folder is refused."""
    p, fs = _hadoop(spark, path)
    if not fs.getFileStatus(p).isDirectory():
        raise NotADirectoryError(path)
    return fs.makeQualified(p).toString().rstrip("/")


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, those of hidden files left out."""
    p, fs = _hadoop(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p) if not x.getPath().getName().startswith((".", "_")))


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def arrow_path(root: str):
    """(file system, path) of a folder for Python workers; a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if ":/" in root else f"file://{root}")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind it until no column of df has it: helper columns that clash with none."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def spread(df: DataFrame) -> DataFrame:
    """df on all cores where its files have fewer parts than there are cores; a large table is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
