"""Declarative, fail-closed rules: manifest audit, review reconciliation, gates, quality reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import try_positive_int

# Fixed values of the manifest contract.
MANIFEST_COLUMNS = (
    "image_id", "label", "source_kind", "source_dataset", "source_page_url", "original_url", "author", "license_name", "license_url", "downloaded_at",
    "source_group_id", "exact_sha256", "perceptual_hash", "width", "height", "review_status", "reviewer", "duplicate_cluster_id", "split",
)
REQUIRED = ("source_kind", "source_dataset", "source_page_url", "original_url", "license_name", "license_url", "downloaded_at", "source_group_id", "split")
STATUSES = ("pending", "accepted", "rejected", "quarantine")
SPLITS = ("", "staging", "train", "val_select", "val_cal")
FINAL_SPLITS = ("train", "val_select", "val_cal")
SHA256 = "^[0-9a-fA-F]{64}$"
PERCEPTUAL = "^[0-9a-fA-F]{16,64}$"
QUALITY_REASONS = ("blur", "underexposed_mean", "overexposed_mean", "overexposed_ratio", "underexposed_ratio", "stale", "roi_coverage")


def reasons(*rules: tuple[str, Column]) -> Column:
    """Names of all rules that fail, in rule order. A condition that is null fails."""
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules]), lambda x: x.isNotNull())


def header_issues(columns: Sequence[str], expected: Sequence[str] = MANIFEST_COLUMNS) -> list[tuple[str, str]]:
    """(severity, code): missing headers are an error, extra ones a warning; order is free."""
    out = []
    if set(expected) - set(columns):
        out.append(("error", "missing_headers"))
    if set(columns) - set(expected):
        out.append(("warning", "extra_headers"))
    return out


def manifest_issues(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """rows (row long, MANIFEST_COLUMNS as text without nulls) -> severity, code, row, detail.

    Row rules are one array expression over a single scan; the first occurrence of an id, duplicate contents and
    leaks between splits are aggregations joined back on keys with more than one row only.
    """
    c = F.col
    live = c("review_status").isin("accepted", "quarantine")
    accepted = c("review_status") == "accepted"
    rules = [
        ("missing_image_id", c("image_id") == ""),
        ("invalid_label", ~c("label").isin(*labels)),
        ("invalid_review_status", ~c("review_status").isin(*STATUSES)),
        ("invalid_split", ~c("split").isin(*SPLITS)),
        *[(f"missing_{f}", live & (c(f) == "")) for f in REQUIRED],
        ("invalid_sha256", live & ~c("exact_sha256").rlike(SHA256)),
        ("missing_reviewer", accepted & (c("reviewer") == "")),
        ("invalid_perceptual_hash", accepted & ~c("perceptual_hash").rlike(PERCEPTUAL)),
        ("invalid_width", live & try_positive_int(c("width")).isNull()),
        ("invalid_height", live & try_positive_int(c("height")).isNull()),
    ]
    by_row = rows.select("row", F.explode(reasons(*rules)).alias("code")).select(F.lit("error").alias("severity"), "code", "row", F.lit("").alias("detail"))
    first = rows.where("image_id <> ''").groupBy("image_id").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = rows.join(first, "image_id").where("row > first").select(F.lit("error").alias("severity"), F.lit("duplicate_image_id").alias("code"), "row", F.concat(F.lit("first row "), F.col("first").cast("string")).alias("detail"))
    good = rows.where(live & c("exact_sha256").rlike(SHA256)).groupBy(F.lower("exact_sha256").alias("sha")).agg(F.count("*").alias("n"), F.max("row").alias("row"), F.bool_or(accepted).alias("any_accepted"), F.sort_array(F.collect_set("split")).alias("splits")).where("n > 1")
    exact = good.select(F.when(F.col("any_accepted"), "error").otherwise("warning").alias("severity"), F.when(F.col("any_accepted"), "exact_duplicate").otherwise("candidate_exact_duplicate").alias("code"), "row", F.col("sha").alias("detail"))
    crossed = good.where(F.col("any_accepted") & (F.size("splits") > 1)).select(F.lit("error").alias("severity"), F.lit("cross_split_exact_duplicate").alias("code"), "row", F.array_join("splits", ",").alias("detail"))
    leaks = cross_split(rows.where(accepted & c("split").isin(*FINAL_SPLITS)), {"source_group_id": "cross_split_source_group", "duplicate_cluster_id": "cross_split_duplicate_cluster"})
    return by_row.unionByName(repeated).unionByName(exact).unionByName(crossed).unionByName(leaks)


def cross_split(rows: DataFrame, fields: dict[str, str], split: str = "split") -> DataFrame:
    """Issues for groups (non-empty values of any of the fields) that stand in several splits."""
    pairs = F.explode(F.array(*[F.struct(F.lit(code).alias("code"), F.col(f).alias("value")) for f, code in fields.items()])).alias("g")
    grouped = rows.select(split, pairs).where("g.value <> ''").groupBy("g.code", "g.value").agg(F.sort_array(F.collect_set(split)).alias("splits"))
    return grouped.where(F.size("splits") > 1).select(F.lit("error").alias("severity"), "code", F.lit(None).cast("long").alias("row"), F.concat_ws(":", "value", F.array_join("splits", ",")).alias("detail"))


def coverage(counts: DataFrame, floor: int, buffer: float = 1.25) -> DataFrame:
    """counts (label, n) -> gap to the floor and the buffered number to fetch."""
    gap = F.greatest(F.lit(0), F.lit(floor) - F.col("n"))
    return counts.select("label", "n", gap.alias("gap"), F.ceil(gap * F.lit(buffer)).cast("long").alias("fetch"))


def distinct_contents(rows: DataFrame) -> DataFrame:
    """label, n: distinct lower-cased valid content hashes of accepted rows."""
    return rows.where((F.col("review_status") == "accepted") & F.col("exact_sha256").rlike(SHA256)).groupBy("label").agg(F.countDistinct(F.lower("exact_sha256")).alias("n"))


# ---------------------------------------------------------------- review


def review_issues(candidates: DataFrame, queue: DataFrame, second_labels: Sequence[str]) -> DataFrame:
    """Reconciles candidates (image_id, label, duplicate_cluster_id) with the review queue.

    queue: row, image_id, decision, reviewer, second_decision, second_reviewer. One row per queue row or missing
    candidate: image_id, decision (accepted, rejected or pending), errors. A repeated queue id and an unknown
    candidate stop further checks of that row.
    """
    q = queue.withColumn("decision", F.lower(F.trim(F.coalesce("decision", F.lit("")))))
    q = q.withColumn("decision", F.when(F.col("decision") == "", "pending").otherwise(F.col("decision")))
    q = q.withColumn("nth", F.row_number().over(Window.partitionBy("image_id").orderBy("row")))
    last = candidates.withColumn("nth", F.lit(1))
    both = q.join(last.withColumnRenamed("label", "label").withColumnRenamed("nth", "known"), "image_id", "full_outer")
    final = F.col("decision").isin("accepted", "rejected")
    second = F.col("label").isin(*second_labels) & final
    stop = F.when(F.col("row").isNull(), "missing_queue_row").when(F.col("nth") > 1, "duplicate_queue_id").when(F.col("known").isNull(), "unknown_or_rejected_candidate").when(~final & (F.col("decision") != "pending"), "invalid_decision")
    rules = [
        ("missing_reviewer", final & (F.col("reviewer") == "")),
        ("second_review_disagrees_or_missing", second & (F.lower(F.trim(F.col("second_decision"))) != F.col("decision"))),
        ("missing_second_reviewer", second & (F.col("second_reviewer") == "")),
        ("reviewers_must_be_distinct", second & (F.col("second_reviewer") != "") & (F.lower("second_reviewer") == F.lower("reviewer"))),
    ]
    errors = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]), lambda x: x.isNotNull())
    return both.select("image_id", "label", "duplicate_cluster_id", F.when(stop.isNull(), F.col("decision")).otherwise("pending").alias("decision"), F.when(stop.isNotNull(), F.array(stop)).otherwise(errors).alias("errors"))


def clusters_with_many_accepted(reviewed: DataFrame) -> DataFrame:
    return reviewed.where((F.col("decision") == "accepted") & (F.coalesce("duplicate_cluster_id", F.lit("")) != "")).groupBy("duplicate_cluster_id").agg(F.count("*").alias("accepted"), F.sort_array(F.collect_list("image_id")).alias("members")).where("accepted > 1")


def review_verdict(reviewed: DataFrame, floor: int, reject_label: str, reject_floor: int) -> DataFrame:
    """One row: counts, pending, errors and `ready`."""
    known = reviewed.where(~F.array_contains("errors", "duplicate_queue_id") & ~F.array_contains("errors", "unknown_or_rejected_candidate"))
    per = known.groupBy("label").agg(F.count_if(F.col("decision") == "accepted").alias("accepted"))
    short = per.agg(F.count_if((F.col("label") != reject_label) & (F.col("accepted") < floor)).alias("short"), F.coalesce(F.max(F.when(F.col("label") == reject_label, F.col("accepted"))), F.lit(0)).alias("rejects"))
    counts = known.agg(F.count("*").alias("candidates"), F.count_if(F.col("decision") == "accepted").alias("accepted"), F.count_if(F.col("decision") == "rejected").alias("rejected"))
    errors = reviewed.agg(F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("errors"))
    out = counts.join(short, F.lit(True)).join(errors, F.lit(True))  # three rows of one
    pending = F.col("candidates") - F.col("accepted") - F.col("rejected")
    return out.select("candidates", "accepted", "rejected", pending.alias("pending"), "errors", ((pending == 0) & (F.col("short") == 0) & (F.col("rejects") >= reject_floor) & (F.col("errors") == 0)).alias("ready"))


# ---------------------------------------------------------------- gates and row checks


def gate(checks: dict[str, DataFrame]) -> DataFrame:
    """checks: one-row DataFrames with a boolean `passed`. -> passed (all), failed (names, sorted)."""
    out = None
    for name, df in checks.items():
        part = df.select(F.lit(name).alias("id"), F.coalesce("passed", F.lit(False)).alias("passed"))
        out = part if out is None else out.unionAll(part)
    return out.agg(F.bool_and("passed").alias("passed"), F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("id")))).alias("failed"))


def require_empty(violations: DataFrame, message: str) -> None:
    """Fail closed: raises with up to three examples if there is any row."""
    found = violations.take(3)
    if found:
        raise ValueError(f"{message}: {found}")


def quality_gate(blur: Column, mean: Column, over: Column, under: Column, age_ms: Column, coverage_share: Column, *, min_blur: float, min_mean: float, max_mean: float, max_over: float, max_under: float, max_age_ms: float, min_coverage: float) -> Column:
    """All failing reasons in their fixed order; equality passes."""
    bad = (blur < min_blur, mean < min_mean, mean > max_mean, over > max_over, under > max_under, age_ms > max_age_ms, coverage_share < min_coverage)
    return reasons(*zip(QUALITY_REASONS, bad, strict=True))


def observation_violations(size: int = 6) -> Column:
    """Checks of an observation row (frame_id, captured_at_ns, inferred_at_ns, probabilities, valid, reason)."""
    c = F.col
    return reasons(
        ("frame_id", c("frame_id") < 0),
        ("time_order", c("inferred_at_ns") < c("captured_at_ns")),
        ("probability_count", F.size("probabilities") != size),
        ("probability_range", F.exists("probabilities", lambda p: ~p.between(0.0, 1.0))),
        ("probability_sum", c("valid") & (F.abs(F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-6)),
        ("reason", c("valid") == (F.coalesce(c("reason"), F.lit("")) != "")),
    )
