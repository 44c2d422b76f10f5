import pytest
from pyspark.sql import functions as F

from millrace.operators import audit, dedup, graph, sampling
from millrace.plans import builders
from millrace.sources.tables import keep_last, merge_reports, ordinals, replace_source

LABELS = ("a", "b", "c")


def review(spark, pending=0):
    rows = [(f"{x}{i}", x, f"{x}-pair" if i < 2 else f"{x}{i}", "", f"{x}{i}".ljust(64, "0")) for x in LABELS for i in range(12)]
    cand = spark.createDataFrame(rows, "image_id string, label string, source_group_id string, duplicate_cluster_id string, exact_sha256 string")
    queue = [(k, r[0], "" if k < pending else "accepted", "r1", "accepted", "r2") for k, r in enumerate(rows)]
    return cand, spark.createDataFrame(queue, "row long, image_id string, decision string, reviewer string, second_decision string, second_reviewer string")


def build(spark, pending=0):
    cand, queue = review(spark, pending)
    return builders.frozen_split(cand, queue, second_labels=("b",), floor=10, reject_label="c", reject_floor=10, ratios=(0.5, 0.25, 0.25), seed=7)


def test_frozen_split(spark):
    first, again = ({r.image_id: r.split for r in build(spark).collect()} for _ in range(2))
    assert first == again and len(first) == 36 and all(first[f"{x}0"] == first[f"{x}1"] for x in LABELS)
    with pytest.raises(ValueError, match="not ready"):
        build(spark, pending=1)


def test_refusals(spark):
    rows = spark.createDataFrame([("1", "a", "g", "s"), ("2", "b", "g", "s")], "image_id string, label string, source_group_id string, sha string")
    with pytest.raises(ValueError, match="span labels"):
        builders.split_components(rows, "image_id", ["source_group_id"], (0.5, 0.25, 0.25), 1)
    with pytest.raises(ValueError, match="several labels"):
        builders.exact_survivors(rows, "sha", "label", "image_id")
    d = spark.createDataFrame([("s", "n")], "sample string, name string")
    with pytest.raises(ValueError, match="repeated sample"):
        builders.detector_rows(d, d)


def test_rows_and_merges(spark):
    rows = spark.createDataFrame([("i", "persian")], "image_id string, label string")
    m = builders.manifest_rows(rows, source_kind=F.lit("gbif")).first()
    assert tuple(m.asDict()) == audit.MANIFEST_COLUMNS and (m.review_status, m.split, m.source_kind, m.author) == ("quarantine", "staging", "gbif", "")
    media = spark.createDataFrame([([("x", "https://creativecommons.org/licenses/by-nc/4.0/"), ("y", "http://creativecommons.org/publicdomain/zero/1.0/")],)], "m array<struct<u:string,license:string>>")
    assert media.select(builders.first_licensed(F.col("m"), ["cc0", "cc-by"]).alias("f")).first().f.u == "y"
    files = spark.createDataFrame([("c", 1, "image/jpeg", "https://creativecommons.org/licenses/by/4.0/"), ("c", 2, "image/jpeg", "https://creativecommons.org/licenses/by/4.0/"), ("c", 3, "video/mp4", ""), ("c", 4, "image/jpeg", "")], "category string, i long, mime string, license_url string")
    assert {r.i: r.reason for r in builders.accept_media(files, ["image/jpeg"], ["cc-by"], 1, "i").collect()} == {1: None, 2: "over_limit", 3: "unsupported_media_type", 4: "license_not_allowed"}
    a, b = (spark.createDataFrame(x, "k string, v long") for x in ([("x", 1), ("y", 2)], [("y", 3)]))
    assert sorted(map(tuple, merge_reports(a, b, "k").collect())) == [("x", 1), ("y", 3)]
    assert sorted(map(tuple, replace_source(a, b, "k", "x").collect())) == [("y", 2), ("y", 3)]
    assert sorted(map(tuple, keep_last(a.unionAll(b), "k", "v").collect())) == [("x", 1), ("y", 3)]
    assert builders.layout_differences(*(spark.createDataFrame(x, "split string, label string, n long") for x in ([("t", "a", 1)], [("t", "a", 2)]))).count() == 2
    views = spark.createDataFrame([("p", True), ("p", True), ("q", False)], "parent_id string, selected boolean")
    assert {r.parent_id for r in builders.view_violations(views, views.select("parent_id").distinct()).collect()} == {"p", "q"}
    plan = builders.panel_plan(spark.range(5), spark.createDataFrame([("b1",), ("b2",)], "path string"), 3, 1)
    assert plan.count() == 8 and plan.where("kind = 'blank'").count() == 3


def test_intake(spark):
    rows = [("1", "a", "p1", 200, "s", "0" * 16), ("2", "a", "p2", 200, "s", "0" * 16), ("3", "a", "p3", 10, "t", "f" * 16), ("4", "b", "p4", 200, "t", "0" * 15 + "1"), ("5", "b", "p5", None, "s", ""), ("6", "b", "p6", 200, "u", "0" * 15 + "3")]
    df = spark.createDataFrame(rows, "id string, label string, path string, width long, sha string, phash string").withColumn("height", F.col("width"))
    got = {r.id: (r.status, r.cluster is not None, r.cross_label) for r in builders.process_intake(df, min_side=160).collect()}
    assert got == {"1": ("candidate", True, True), "2": ("rejected_redundant_exact", False, False), "3": ("rejected_cross_label_exact", False, False), "4": ("rejected_cross_label_exact", False, False), "5": ("rejected_decode_error", False, False), "6": ("candidate", True, True)}


def test_string_components(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string")
    assert {r.node: r.root for r in graph.connected_components(e).collect()} == {"a": "a", "b": "a", "c": "a"}


def test_helper_columns_clash_with_none(spark):
    extra = {c: F.lit("mine") for c in ("new_key", "new_label", "new_note", "its_parent", "all_rows", "nth", "at", "part", "size", "order0", "stage_key", "stage_n", "frozen", "first", "last", "ordinal_at")}
    rows = spark.createDataFrame([("i1", "a", "p1"), ("i2", "b", "p2"), ("i3", "a", None)], "image_id string, label string, parent_id string").withColumns(extra)
    kept = lambda df: df.count() == 3 and all(r[c] == "mine" for r in df.collect() for c in extra)
    changed = builders.relabelled(rows, spark.createDataFrame([("i1", "c", "why")], "image_id string, label string, note string"), "image_id")
    assert kept(changed) and {(r.image_id, r.label, r.was) for r in changed.collect()} == {("i1", "c", "a"), ("i2", "b", ""), ("i3", "a", "")}
    parents = spark.createDataFrame([("p1", "src")], "parent_id string, source_dataset string")
    sourced = builders.with_parent_source(rows, parents)
    assert kept(sourced) and {(r.image_id, r.source_dataset) for r in sourced.collect()} == {("i1", "src"), ("i2", ""), ("i3", "")}
    placed = sampling.group_ordinals(rows, "label", [F.col("image_id")], "place")
    assert kept(placed) and {(r.image_id, r.place) for r in placed.collect()} == {("i1", 1), ("i2", 1), ("i3", 2)}
    assert kept(sampling.hash_slices(rows, "image_id", 2, 1)) and kept(sampling.numbered(rows, "label", "image_id", F.col("label")))
    assert kept(ordinals(rows, "row")) and sorted(r.row for r in ordinals(rows, "row").collect()) == [0, 1, 2]
    pool = rows.select(*extra, "image_id", "label", F.lit("k").alias("source_kind"), F.col("image_id").alias("sha"), F.lit(500).alias("width"), F.lit(500).alias("height"), F.lit("cc0").alias("license"), F.lit("web").alias("provenance"))
    filled = dedup.gap_fill(pool, spark.createDataFrame([("i2",)], "sha string"), min_side=100, limit=1)
    assert kept(filled) and {(r.image_id, r.reason) for r in filled.collect()} == {("i1", None), ("i2", "already_in_frozen_split"), ("i3", "over_limit")}
