"""Text tables and documents: explicit schemas, header checks, no inference."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import blank_to_empty, try_unit_float
from millrace.sources.storage import read_text, unused, write_text

# Fixed values of the prediction table: its columns in order, and its splits.
PREDICTION_COLUMNS = ("image_id", "split", "true_label", "p_ragdoll", "p_singapura", "p_persian", "p_sphynx", "p_pallas", "p_not_target", "model_id", "dataset_sha256", "checkpoint_sha256", "source_group_id")
PREDICTION_SPLITS = ("val_select", "val_cal", "robot_calibration", "robot_final")
LABELS = ("ragdoll", "singapura", "persian", "sphynx", "pallas", "not_target")


def headers(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, *, trim: bool = True) -> DataFrame:
    """All columns as text; an empty cell is the empty string, and white space around cells goes unless told otherwise."""
    names = list(columns or headers(spark, path))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    raw = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)
    return raw.select(*[(blank_to_empty(F.col(c)) if trim else F.coalesce(c, F.lit(""))).alias(c) for c in names])


def read_numbered_csv(spark: SparkSession, path: str, expected: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """(rows with their line ordinal from 2, missing headers, extra headers); missing columns read as empty.

    Ordinals follow file order: partitions are counted first, so only their sizes pass the driver.
    """
    have = headers(spark, path)
    rows = read_csv(spark, path, have)
    rows = rows.select(*[F.col(c) if c in have else F.lit("").alias(c) for c in expected])
    return ordinals(rows, "row", start=2), [c for c in expected if c not in have], [c for c in have if c not in expected]


def ordinals(rows: DataFrame, name: str, start: int = 0) -> DataFrame:
    """Consecutive numbers in the order of partitions and rows."""
    (at_,) = unused(rows.withColumn(name, F.lit(0)), "ordinal_at")
    placed = rows.withColumn(at_, F.monotonically_increasing_id())
    part = F.shiftright(at_, 33)
    sizes = {r[0]: r[1] for r in placed.groupBy(part.alias("p")).count().collect()}
    base, at = {}, start
    for p in sorted(sizes):
        base[p] = at
        at += sizes[p]
    if not base:
        return placed.withColumn(name, F.lit(None).cast("long")).drop(at_)
    starts = F.create_map(*[x for k, v in base.items() for x in (F.lit(k), F.lit(v))])
    return placed.withColumn(name, (F.element_at(starts, part) + F.col(at_).bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop(at_)


def read_required(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    missing = sorted(set(required) - set(headers(spark, path)))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return read_csv(spark, path)


def read_unique(spark: SparkSession, path: str, key: str, kind: str = "bigint") -> DataFrame:
    """A table whose key must parse and be unique."""
    rows = read_csv(spark, path).withColumn(key, F.col(key).try_cast(kind))
    bad = rows.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).take(3)
    if bad:
        raise ValueError(f"{key} is not a unique {kind}: {bad}")
    return rows


def prediction_violations(rows: DataFrame) -> DataFrame:
    """image_id and errors of prediction rows that break a rule."""
    ps = [c for c in PREDICTION_COLUMNS if c.startswith("p_")]
    values = [try_unit_float(F.col(c)) for c in ps]
    total = sum(values[1:], values[0])
    n = F.count("*").over(Window.partitionBy("image_id"))
    rules = [
        ("image_id", (F.col("image_id") == "") | (n > 1)),
        ("split", ~F.col("split").isin(*PREDICTION_SPLITS)),
        ("true_label", ~F.col("true_label").isin(*LABELS)),
        ("probabilities", total.isNull() | (F.abs(total - 1) > 1e-6)),
        ("dataset_sha256", ~F.col("dataset_sha256").rlike("^[0-9a-f]{64}$")),
        ("checkpoint_sha256", ~F.col("checkpoint_sha256").rlike("^[0-9a-f]{64}$")),
        ("model_id", F.col("model_id") == ""),
    ]
    marked = rows.select("image_id", F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules]), lambda x: x.isNotNull()).alias("errors"))
    return marked.where(F.size("errors") > 0)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """image_id, split, truth (label index), p (array<double>), provenance. Raises on any broken row or other headers."""
    if tuple(headers(spark, path)) != PREDICTION_COLUMNS:
        raise ValueError("prediction headers differ")
    rows = read_csv(spark, path, PREDICTION_COLUMNS)
    bad = prediction_violations(rows).take(3)
    if bad:
        raise ValueError(f"broken prediction rows: {bad}")
    ps = [F.col(c).try_cast("double") for c in PREDICTION_COLUMNS if c.startswith("p_")]
    index = F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col("true_label")) - 1
    return rows.select("image_id", "split", index.cast("int").alias("truth"), F.array(*ps).alias("p"), "model_id", "dataset_sha256", "checkpoint_sha256", "source_group_id")


def fuzzy_column(df: DataFrame, part: str) -> str:
    """The first column whose trimmed name holds `part`."""
    found = [c for c in df.columns if part in c.strip()]
    if not found:
        raise ValueError(f"no column holds {part!r}")
    return found[0]


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """epoch and accuracy of a training log whose headers may be padded."""
    df = spark.read.option("header", True).csv(path)
    return df.select(F.trim(F.col(f"`{fuzzy_column(df, 'epoch')}`")).try_cast("int").alias("epoch"), F.trim(F.col(f"`{fuzzy_column(df, 'accuracy_top1')}`")).try_cast("double").alias("accuracy"))


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def load_toml(spark: SparkSession, path: str, version: int = 1, rules: dict[str, tuple[type, float, float]] | None = None) -> dict:
    """A configuration from any file system; another schema_version, or a value outside of its rule, is refused.

    rules: dotted name -> (type, least, most).
    """
    config = tomllib.loads(read_text(spark, path))
    if config.get("schema_version", version) != version:
        raise ValueError("unknown schema_version")
    for name, (kind, least, most) in (rules or {}).items():
        value = config
        for part in name.split("."):
            value = value.get(part) if isinstance(value, dict) else None
        if not isinstance(value, kind) or isinstance(value, bool) or not least <= value <= most:
            raise ValueError(f"{name} must be a {kind.__name__} from {least} to {most}: {value!r}")
    return config


def registry_paths(spark: SparkSession, path: str, key: str = "path") -> DataFrame:
    """Values of `key:` lines of a YAML registry."""
    value = F.regexp_extract("value", rf"^\s*-?\s*{re.escape(key)}:\s*[\"']?([^\"'#]+?)[\"']?\s*(?:#.*)?$", 1)
    return spark.read.text(path).select(value.alias("path")).where("path <> ''")


# ---------------------------------------------------------------- sinks


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fixed columns in order; missing or null ones are empty text, booleans lower case."""
    return df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: Sequence[str], *, single_file: bool = False, overwrite: bool = False) -> None:
    """Header, LF line ends. Refuses an existing path unless told to overwrite; one file only for small tables."""
    out = project(df, columns)
    (out.coalesce(1) if single_file else out).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("lineSep", "\n").option("emptyValue", "").option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_report(spark: SparkSession, report: dict, path: str, overwrite: bool = False) -> None:
    """A small report as JSON with sorted keys, in any file system."""
    write_text(spark, path, json.dumps(report, indent=2, sort_keys=True, ensure_ascii=False) + "\n", overwrite)


def report_column(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns))


def replace_source(old: DataFrame, new: DataFrame, source: str, value: str) -> DataFrame:
    """All rows of one source replaced: delete and insert. Write the result to another path than the one read."""
    return old.where(F.coalesce(F.col(source), F.lit("")) != value).unionByName(new, allowMissingColumns=True)


def merge_reports(prior: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Entries of `new` replace those of `prior` with the same key."""
    return prior.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in `order`."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.col(order)).alias("r")).select(key, "r.*")
