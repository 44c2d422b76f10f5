"""Corpus pipeline: quality, line dedup, near duplicates, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to the shared
folder and reread as the next stage's docs, so a lost executor costs at most one stage's tasks. All stages
but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, jaccard, line_dedup, packing, quality
from millrace.llm.common import cut, fresh_path, release, table, unused


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under its threshold go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    (own,) = unused(docs, "own_score")
    held = docs.withColumnRenamed("score", own)  # a column of that name is not the classifier's
    scored = quality.score(held, model).where(F.col("score") >= quality.THRESHOLD).drop("score")
    return scored.withColumnRenamed(own, "score").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; n_chars follows the text."""
    done = line_dedup.dedup_lines(docs, counts=False)
    return done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays, once (an id before none, then by a hash of the text).

    Rows are told apart by id and text, so null and repeated ids are judged like others. Documents without words are
    linked with nothing and stay, once for each id and text.
    """
    (key,) = unused(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    ids = keyed.select(F.col(key).alias("row"), F.col("doc_id").alias("id")).distinct()
    groups = jaccard.jaccard_components(keyed.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id").distinct()
    first = F.min(F.struct(F.col("id").isNull(), "id", "row"))
    stay = cut(groups.join(ids, "row").groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias(key)))
    return keyed.join(stay, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"), whole=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifier and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
