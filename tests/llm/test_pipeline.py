"""The pipeline's stages against what each operator decides, and its guard in the driver's entry."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from pyspark.sql import functions as F  # noqa: E402

from millrace.llm import decontaminate, jaccard, line_dedup, packing, queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        seen[name] = (docs, out)
        if name != "packing":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        docs = out
    before, after = seen["line_dedup"]
    assert before.count() == after.count()
    want = {r.doc_id: r.text for r in line_dedup.dedup_lines(before).collect()}
    assert {r.doc_id: r.text for r in after.collect()} == want and after.where(F.length("text") != F.col("n_chars")).count() == 0
    before, after = seen["near_duplicates"]
    assert {r.doc_id for r in after.collect()} == {r.component_id for r in jaccard.jaccard_components(before).collect()}
    before, after = seen["decontamination"]
    leaked = {r.doc_id for r in decontaminate.leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - leaked
    before, after = seen["packing"]
    assert after.agg(F.sum("length")).first()[0] == packing.pack(before).agg(F.sum("length")).first()[0]
    # Where a document is cut depends on what shares its task; which ids are packed does not.
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0] == after.agg(F.sum("length")).first()[0]


def test_odd_tables(spark, tmp_path):
    rows = [(None, None, "x"), (1, "", "x"), (1, "same words here again now", "y"), (2, "same words here again now", "y"), (2, "same words here again now", "y"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    docs = docs.select("*", *[F.lit("mine").alias(c) for c in ("n_lines", "n_dropped", "key", "drop", "lines", "row_key", "own_score", "__key")])
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    for table in (docs, docs.limit(0)):
        d = table
        for name, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, str(tmp_path))
            n = d.count()
            assert name == "packing" or d.columns == docs.columns
            if name != "packing":
                assert {tuple(r) for r in d.select(*docs.columns[3:]).distinct().collect()} <= {("mine",) * 8}
            if name == "near_duplicates" and table is docs:
                assert sorted(((r.doc_id, r.text) for r in d.collect()), key=repr) == sorted([(None, None), (1, ""), (1, "same words here again now"), (3, None)], key=repr)
        assert (n > 0) == (table is docs)


def test_every_operator_has_a_query():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{i}" for i in range(1, 11)} and set(queries.ORACLE) <= set(queries.QUERIES)


def test_trim_gives_back_freed_memory():
    """A worker that has freed small blocks below one it holds keeps their memory without it."""
    from millrace.llm.common import trim

    def resident():
        return int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    held = [bytearray(b"x" * 65_000) for _ in range(2000)]
    last = held[1::100]
    del held
    before = resident()
    trim()
    assert resident() < before + 1_000_000 and len(last) == 20


def test_tasks_of_the_pipeline_leave_no_memory_behind(spark, tmp_path, monkeypatch):
    """Every stage's tasks give back what they freed; only those that use a kept tokenizer leave it for the next task."""
    from pyspark.sql.classic.dataframe import DataFrame

    from millrace.llm import common

    calls, seen, given = DataFrame.mapInArrow, [], []
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, *a, **b: seen.append(f) or calls(self, f, *a, **b))
    text = "some words of a text that has a number of lines\n"
    docs = spark.createDataFrame([(i, text * 3 + f"and its own line {i} here") for i in range(12)], "doc_id long, text string")
    spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one item of the benchmark that nothing leaks")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).count()
    own = [f for f in seen if f.__module__.startswith("millrace.llm")]
    assert len(own) > 10 and all(hasattr(f, "__wrapped__") for f in own)
    monkeypatch.setattr(common, "trim", lambda: given.append(1))
    common.KEPT["x"] = 1
    assert list(common.tidy(lambda batches: batches, keep=True)([1, 2])) == [1, 2] and len(given) == 4 and common.KEPT == {"x": 1}
    assert list(common.tidy(lambda batches: batches)([])) == [] and len(given) == 6 and not common.KEPT
