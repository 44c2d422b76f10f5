"""Dataset builders: compositions of the operators into whole jobs. Each fails closed through require_empty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import license_code
from millrace.operators import audit, dedup, graph, sampling
from millrace.operators.audit import MANIFEST_COLUMNS, require_empty
from millrace.sources.storage import cut, unused
from millrace.sources.tables import ordinals, project

# States of an intake row.
CANDIDATE, BELOW_MINIMUM, DECODE_ERROR, CROSS_LABEL, REDUNDANT = "candidate", "rejected_below_minimum", "rejected_decode_error", "rejected_cross_label_exact", "rejected_redundant_exact"


def reset_lifecycle(rows: DataFrame) -> DataFrame:
    """A new intake starts in quarantine, unreviewed, without cluster, in the staging split."""
    return rows.withColumns({"review_status": F.lit("quarantine"), "reviewer": F.lit(""), "duplicate_cluster_id": F.lit(""), "split": F.lit("staging")})


def manifest_rows(rows: DataFrame, **columns: Column) -> DataFrame:
    """Manifest columns in order: those given, those of rows with the name, and empty text for the rest."""
    return project(reset_lifecycle(rows.withColumns(columns)), MANIFEST_COLUMNS)


def split_rows(targets: DataFrame, negatives: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two sources in one schema; columns one of them lacks are empty text."""
    return project(targets, columns).unionByName(project(negatives, columns))


def first_licensed(media: Column, allowed: Sequence[str]) -> Column:
    """The first media item (struct with license) whose license code is allowed, or null."""
    return F.get(F.filter(media, lambda m: license_code(m["license"]).isin(*allowed)), F.lit(0))


def accept_media(rows: DataFrame, kinds: Sequence[str], allowed: Sequence[str], limit: int, order: str) -> DataFrame:
    """Remote files with a reason each: wrong kind, license not allowed, over the limit; null for those taken."""
    reason = F.when(~F.col("mime").isin(*kinds), "unsupported_media_type").when(~license_code(F.col("license_url")).isin(*allowed), "license_not_allowed")
    marked = rows.withColumn("reason", reason)
    nth = F.row_number().over(Window.partitionBy("category", F.col("reason").isNull()).orderBy(order))
    return marked.withColumn("reason", F.when(F.col("reason").isNull() & (nth > limit), "over_limit").otherwise(F.col("reason")))


def process_intake(rows: DataFrame, *, min_side: int, threshold: int = 4) -> DataFrame:
    """rows (id, label, path, width, height, sha, phash; null width: not decoded) plus status, cluster, cross_label.

    Contents held by several labels reject every holder, too small ones as well; otherwise the first candidate by
    (label, path) of a content stays. Near clusters span labels, are named by their members' digest and reject nothing.
    """
    status = F.when(F.col("width").isNull(), DECODE_ERROR).when((F.col("width") < min_side) | (F.col("height") < min_side), BELOW_MINIMUM).otherwise(CANDIDATE)
    base = rows.withColumn("status", status)
    groups = base.where(F.col("status") != DECODE_ERROR).groupBy("sha").agg(F.size(F.collect_set("label")).alias("labels"), F.min(F.when(F.col("status") == CANDIDATE, F.struct("label", "path", "id"))).alias("keeper"), F.count("*").alias("n")).where("n > 1")
    both = base.join(groups, "sha", "left")
    hit = F.col("n").isNotNull() & (F.col("status") != DECODE_ERROR)
    both = both.withColumn("status", F.when(hit & (F.col("labels") > 1), CROSS_LABEL).when(hit & (F.col("status") == CANDIDATE) & (F.col("id") != F.col("keeper.id")), REDUNDANT).otherwise(F.col("status")))
    both = cut(both.drop("labels", "keeper", "n"))
    near = dedup.near_clusters(both.where(F.col("status") == CANDIDATE), "id", "phash", threshold)
    named = near.join(both.select("id", "label"), "id").groupBy("cluster").agg(F.sort_array(F.collect_list(F.col("id").cast("string"))).alias("ids"), (F.size(F.collect_set("label")) > 1).alias("cross_label"))
    names = named.select("cluster", dedup.cluster_name(F.col("ids")).alias("name"), "cross_label")
    flags = near.join(names, "cluster").select("id", F.col("name").alias("cluster"), "cross_label")
    return both.join(flags, "id", "left").withColumn("cross_label", F.coalesce("cross_label", F.lit(False)))


def exact_survivors(rows: DataFrame, sha: str, label: str, id_col: str) -> DataFrame:
    """One row per content, the smallest id; refuses contents that span labels."""
    spread = rows.groupBy(sha).agg(F.size(F.collect_set(label)).alias("n")).where("n > 1")
    require_empty(spread, "contents held by several labels")
    return rows.join(rows.groupBy(sha).agg(F.min(id_col).alias(id_col)), [sha, id_col], "left_semi")


def component_groups(linked: DataFrame, label: str = "label") -> DataFrame:
    """label, group, size and member_key (the smallest member, which names a component) of linked rows."""
    return linked.groupBy(F.col(label).alias("label"), F.col("component").alias("group")).agg(F.count("*").alias("size")).withColumn("member_key", F.col("group").cast("string"))


def split_components(rows: DataFrame, id_col: str, tokens: list[str], ratios: Sequence[float], seed: int, label: str = "label") -> DataFrame:
    """rows plus component and split; refuses components that span labels. No component is ever cut."""
    linked = cut(graph.link_components(rows, id_col, tokens))
    require_empty(graph.mixed_components(linked, label), "components that span labels")
    groups = component_groups(linked, label)
    chosen = sampling.allocate_groups(groups, ratios, seed).select(F.col("group").alias("component"), "split")
    return linked.drop("split").join(chosen, "component")


def frozen_split(candidates: DataFrame, queue: DataFrame, *, second_labels: Sequence[str], floor: int, reject_label: str, reject_floor: int, ratios: Sequence[float], seed: int) -> DataFrame:
    """Reviewed candidates to a split without leaks; refuses while the review is not ready.

    candidates: image_id, label, source_group_id, duplicate_cluster_id, exact_sha256.
    """
    reviewed = cut(audit.review_issues(candidates.select("image_id", "label", "duplicate_cluster_id"), queue, second_labels))
    verdict = audit.review_verdict(reviewed, floor, reject_label, reject_floor)
    require_empty(audit.clusters_with_many_accepted(reviewed), "several accepted rows in a cluster")
    require_empty(verdict.where(~F.col("ready")), "the review is not ready")
    accepted = reviewed.where("decision = 'accepted'").select("image_id")
    rows = candidates.join(accepted, "image_id")
    out = split_components(rows, "image_id", ["source_group_id", "duplicate_cluster_id", "exact_sha256"], ratios, seed)
    leaks = audit.cross_split(out, {"source_group_id": "group", "duplicate_cluster_id": "cluster", "exact_sha256": "content"})
    require_empty(leaks, "groups in several splits")
    return out


def detector_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two detector sources (sample, name, split, label, boxes) as one; refuses repeated samples or names."""
    both = first.unionByName(second, allowMissingColumns=True)
    for c in ("sample", "name"):
        require_empty(both.groupBy(c).count().where("count > 1"), f"repeated {c}")
    return both


def view_rows(views: DataFrame) -> DataFrame:
    """Rows of the derived-view table: numbers as text with eight decimals, lists joined, nothing for a null.

    views: view_id, parent_id, kind, box (struct x1, y1, x2, y2, confidence or null), flags (array<string>).
    """
    number = lambda c: F.coalesce(F.format_string("%.8f", c), F.lit(""))
    corners = [F.when(F.col("box").isNotNull(), number(F.col(f"box.{c}"))).otherwise("").alias(c) for c in ("x1", "y1", "x2", "y2", "confidence")]
    return views.select("view_id", "parent_id", "kind", *corners, F.array_join(F.coalesce("flags", F.array().cast("array<string>")), "|").alias("flags"))


def with_parent_source(rows: DataFrame, parents: DataFrame, key: str = "parent_id", column: str = "source_dataset") -> DataFrame:
    """rows with the parent's value of a column, empty text where there is no such parent."""
    parent, value = unused(rows, "its_parent", "its_value")
    found = parents.select(F.col(key).alias(parent), F.col(column).alias(value))
    return rows.drop(column).join(found, F.col(key) == F.col(parent), "left").withColumn(column, F.coalesce(value, F.lit(""))).drop(parent, value)


def source_root(kind: Column, roots: dict[str, str], default: str) -> Column:
    """The folder in which files of a kind of source lie."""
    out = F.lit(default)
    for k, root in roots.items():
        out = F.when(kind == k, F.lit(root)).otherwise(out)
    return out


def relabelled(rows: DataFrame, changes: DataFrame, key: str, label: str = "label") -> DataFrame:
    """rows with the label that changes (key, label, note) give, the former one in `was`, and the note."""
    k, value, note = unused(rows, "new_key", "new_label", "new_note")
    new = changes.select(F.col(key).alias(k), F.col(label).alias(value), F.col("note").alias(note))
    both = rows.join(new, F.col(key) == F.col(k), "left")
    return both.withColumns({"was": F.when(F.col(value).isNotNull(), F.col(label)).otherwise(F.lit("")), label: F.coalesce(value, label), "note": F.coalesce(note, F.lit(""))}).drop(k, value, note)


def with_defaults(rows: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """rows with the default wherever a column is missing, null or empty."""
    return rows.withColumns({c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(F.lit(v)) if c in rows.columns else F.lit(v) for c, v in defaults.items()})


def split_guard(rows: DataFrame, splits: Sequence[str], provenance: Sequence[str]) -> DataFrame:
    """Violations of a finished split, one row each: unknown splits, splits without rows, empty provenance, mixed values.

    `provenance` columns must hold one value each over the whole table.
    """
    counts = rows.groupBy("split").agg(F.count("*").alias("n"))
    wanted = rows.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    unknown = counts.join(wanted, "split", "left_anti").select(F.lit("unknown_split").alias("code"), F.col("split").alias("detail"))
    without = wanted.join(counts, "split", "left_anti").select(F.lit("empty_split").alias("code"), F.col("split").alias("detail"))
    out = unknown.unionAll(without)
    if provenance:
        one = rows.agg(*[F.struct(F.countDistinct(c).alias("n"), F.count_if(F.coalesce(c, F.lit("")) == "").alias("bare")).alias(c) for c in provenance])
        marks = F.explode(F.flatten(F.array(*[F.array(F.when(F.col(f"{c}.n") > 1, F.struct(F.lit("mixed_provenance").alias("code"), F.lit(c).alias("detail"))), F.when(F.col(f"{c}.bare") > 0, F.struct(F.lit("missing_provenance").alias("code"), F.lit(c).alias("detail")))) for c in provenance])))
        out = out.unionAll(one.select(marks.alias("m")).where("m is not null").select("m.code", "m.detail"))
    return out


def set_differences(found: DataFrame, expected: DataFrame, column: str) -> DataFrame:
    """Values that stand on one side only, with the side; no rows if the sets are equal."""
    a, b = found.select(column).distinct(), expected.select(column).distinct()
    return a.join(b, column, "left_anti").withColumn("side", F.lit("found")).unionAll(b.join(a, column, "left_anti").withColumn("side", F.lit("expected")))


def handoff_rows(files: DataFrame, manifest: DataFrame, key: str = "name", size: int = 40) -> DataFrame:
    """Manifest rows reconciled with files on disk and dealt to review batches: status ok, missing_file, hash_mismatch or
    unlisted_file, and the batch of each row that is ok, in the order of label and key.
    """
    both = manifest.select(key, "label", F.col("sha256").alias("expected")).join(files.select(key, "sha256"), key, "full_outer")
    status = F.when(F.col("expected").isNull(), "unlisted_file").when(F.col("sha256").isNull(), "missing_file").when(F.col("sha256") != F.col("expected"), "hash_mismatch").otherwise("ok")
    marked = cut(both.select(key, "label", status.alias("status")))
    good = sampling.batches(marked.where("status = 'ok'"), "label", key, size)
    return good.unionByName(marked.where("status <> 'ok'"), allowMissingColumns=True)


def storage_inventory(files: DataFrame, root: str, limit: int) -> DataFrame:
    """storage_rollup with a warning for directories over `limit` bytes and for empty files in them."""
    from millrace.sources.files import storage_rollup

    rolled = storage_rollup(files, root)
    bare = storage_rollup(files.where("length = 0"), root).select("directory", F.col("files").alias("empty_files"))
    both = rolled.join(bare, "directory", "left").withColumn("empty_files", F.coalesce("empty_files", F.lit(0)))
    return both.withColumn("warnings", F.array_join(audit.reasons(("large", F.col("bytes") > limit), ("empty_files", F.col("empty_files") > 0)), "|"))


def box_counts(rows: DataFrame, by: Sequence[str], boxes: str = "box_count") -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("images"), F.sum(boxes).alias("boxes"), F.count_if(F.col(boxes) > 1).alias("multi_box"), F.count_if(F.col(boxes) == 0).alias("without"))


def view_survivors(views: DataFrame, base: DataFrame, by: str | None = None) -> DataFrame:
    """views (source_sha, view_sha, arrival) not in base (sha), the first arrival of each source and then of each view.

    Adds ordinal: 1, 2, ... in the order of arrival (within `by`, if given), which counts kept views only.
    """
    once = views.join(base.select(F.col("sha").alias("source_sha")), "source_sha", "left_anti")
    first = once.groupBy("source_sha").agg(F.min("arrival").alias("arrival"))
    once = once.join(first, ["source_sha", "arrival"], "left_semi").join(base.select(F.col("sha").alias("view_sha")), "view_sha", "left_anti")
    kept = once.join(once.groupBy("view_sha").agg(F.min("arrival").alias("arrival")), ["view_sha", "arrival"], "left_semi")
    if by:
        return sampling.group_ordinals(kept, by, [F.col("arrival")], "ordinal")
    (one,) = unused(kept, "all_rows")
    return sampling.group_ordinals(kept.withColumn(one, F.lit(0)), one, [F.col("arrival")], "ordinal").drop(one)


def burst_rows(frames: DataFrame, samples: DataFrame) -> DataFrame:
    """frames (burst, at) between the first and the last sampled frame of their burst, samples (burst, at)."""
    ends = samples.groupBy("burst").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    return frames.join(ends, "burst").where((F.col("at") >= F.col("lo")) & (F.col("at") <= F.col("hi"))).drop("lo", "hi")


def view_violations(views: DataFrame, parents: DataFrame) -> DataFrame:
    """Parents without exactly one selected view."""
    n = views.where("selected").groupBy("parent_id").agg(F.count("*").alias("n"))
    return parents.select("parent_id").join(n, "parent_id", "left").where(F.coalesce("n", F.lit(0)) != 1)


def layout_differences(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows (split, label, n) that stand on one side only; empty when the layouts are equal."""
    a, b = counts.select("split", "label", "n"), expected.select("split", "label", "n")
    return a.exceptAll(b).withColumn("side", F.lit("found")).unionAll(b.exceptAll(a).withColumn("side", F.lit("expected")))


def upsert_decisions(rows: DataFrame, prior: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the human decisions that a prior batch already holds; empty text for new ones."""
    names = unused(rows, *(f"prior_{c}" for c in columns))
    old = prior.select(key, *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)])
    return rows.drop(*columns).join(old, key, "left").select("*", *[F.coalesce(n, F.lit("")).alias(c) for c, n in zip(columns, names, strict=True)]).drop(*names)


def panel_plan(originals: DataFrame, backgrounds: DataFrame, blanks: int, seed: int) -> DataFrame:
    """One positive per original and `blanks` panels without any, each with a background by stable hash.

    The producer's pseudo-random draws are not reproducible here; a stable hash takes their place.
    """
    n = backgrounds.count()
    placed = ordinals(cut(backgrounds.select(F.col("path").alias("background")).orderBy("background")), "slot").withColumn("slot", F.col("slot").cast("int"))
    plan = originals.select(F.col("id").cast("string").alias("item"), F.lit("positive").alias("kind")).unionAll(originals.sparkSession.range(blanks).select(F.concat(F.lit("blank-"), F.col("id").cast("string")), F.lit("blank")))
    slot = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), "kind", "item"), 256), 1, 15), 16, 10).cast("long"), F.lit(n))
    return plan.withColumn("slot", slot.cast("int")).join(placed, "slot").drop("slot")


def same_content_groups(files: DataFrame) -> DataFrame:
    """Files (path, sha256, length) held several times: digest, copies, wasted bytes, paths."""
    per = files.groupBy("sha256").agg(F.count("*").alias("copies"), F.min("length").alias("length"), F.sort_array(F.collect_list("path")).alias("paths"))
    return per.where("copies > 1").withColumn("wasted", (F.col("copies") - 1) * F.col("length"))
