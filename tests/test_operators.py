import hashlib
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from millrace.operators import audit, dedup, graph, metrics, sampling
from millrace.sources.tables import LABELS


def row(**over):
    base = dict.fromkeys(audit.MANIFEST_COLUMNS, "x") | {"row": 2, "image_id": "i1", "label": "ragdoll", "exact_sha256": "a" * 64, "perceptual_hash": "b" * 16, "width": "640", "height": "480", "review_status": "accepted", "split": "staging", "duplicate_cluster_id": ""}
    return base | over


def frame(spark, rows):
    schema = "row long, " + ", ".join(f"{c} string" for c in audit.MANIFEST_COLUMNS)
    return spark.createDataFrame([tuple(r[c] for c in ("row", *audit.MANIFEST_COLUMNS)) for r in rows], schema)


def codes(df):
    return sorted(r.code for r in df.collect())


def test_manifest_rules(spark):
    assert codes(audit.manifest_issues(frame(spark, [row()]), LABELS)) == []
    assert codes(audit.manifest_issues(frame(spark, [row(label="unknown", license_name="", license_url="")]), LABELS)) == ["invalid_label", "missing_license_name", "missing_license_url"]
    pair = [row(split="train", source_group_id="g", duplicate_cluster_id="c"), row(row=3, image_id="i2", split="val_select", source_group_id="g", duplicate_cluster_id="c")]
    assert codes(audit.manifest_issues(frame(spark, pair), LABELS)) == ["cross_split_duplicate_cluster", "cross_split_exact_duplicate", "cross_split_source_group", "exact_duplicate"]
    assert codes(audit.manifest_issues(frame(spark, [row(review_status="quarantine", reviewer="", perceptual_hash="")]), LABELS)) == []
    assert codes(audit.manifest_issues(frame(spark, []), LABELS)) == []
    assert audit.header_issues(["image_id", "zz"], ["image_id", "label"]) == [("error", "missing_headers"), ("warning", "extra_headers")]
    gap = audit.coverage(audit.distinct_contents(frame(spark, [row()])), 400).first()
    assert (gap.gap, gap.fetch) == (399, 499)


def test_review(spark):
    cand = spark.createDataFrame([("a", "persian", "near-1"), ("b", "persian", "near-1"), ("c", "ragdoll", "")], "image_id string, label string, duplicate_cluster_id string")
    q = spark.createDataFrame([(1, "a", "ACCEPTED", "r", "", ""), (2, "b", "accepted", "r", "accepted", "R"), (3, "b", "accepted", "r", "", ""), (4, "z", "accepted", "r", "", ""), (5, "c", "", "", "", "")], "row long, image_id string, decision string, reviewer string, second_decision string, second_reviewer string")
    got = sorted((r.image_id, r.decision, tuple(r.errors)) for r in audit.review_issues(cand, q, ["persian"]).collect())
    assert got == [
        ("a", "accepted", ("second_review_disagrees_or_missing", "missing_second_reviewer")),
        ("b", "accepted", ("reviewers_must_be_distinct",)),
        ("b", "pending", ("duplicate_queue_id",)),
        ("c", "pending", ()),
        ("z", "pending", ("unknown_or_rejected_candidate",)),
    ]
    assert audit.clusters_with_many_accepted(audit.review_issues(cand, q, [])).first().members == ["a", "b"]


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 160)]
    up = {x: x for e in edges for x in e}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert got == want
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_link_and_reach(spark):
    rows = spark.createDataFrame([(1, "x", "g", ""), (2, "x", "g", "h"), (3, "y", "", "h"), (4, "y", "", "")], "id long, label string, s string, t string")
    assert {r.id: r.component for r in graph.link_components(rows, "id", ["s", "t"]).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert graph.mixed_components(graph.link_components(rows, "id", ["s", "t"]), "label").count() == 1
    assert {r.id: r.component for r in graph.link_components(rows, "id", ["s", "t"], within="label").collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    tree = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "parent string, child string")
    assert {r.node: r.depth for r in graph.reachable(tree, ["a"], 2).collect()} == {"a": 0, "b": 1, "c": 2}


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    hashes = [s ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for s in seeds for _ in range(5)]
    rows = [(i, f"{h & (2**64 - 1):016x}", "ab"[i % 2]) for i, h in enumerate(hashes)]
    first = {}
    for i, h, lab in rows:
        first.setdefault((lab, h), i)
    reps = [(i, int(h, 16), lab) for (lab, h), i in first.items()]
    want = {(a, b, (x ^ y).bit_count()) for a, x, p in reps for b, y, q in reps if a < b and p == q and (x ^ y).bit_count() <= 4}
    df = spark.createDataFrame(rows, "id long, h string, lab string")
    assert {(r.a, r.b, r.distance) for r in dedup.near_pairs(df, "id", "h", 4, within="lab").collect()} == want


def test_prepare_candidates(spark):
    def r(i, label="x", sha=None, url="", kind="gbif", ph="0" * 16, w=200, ds="d"):
        return (i, label, kind, ds, sha or hashlib.sha256(i.encode()).hexdigest(), ph, url, w, 200)

    far = [f"{(0x123456789ABCDEF * (k + 1)) % 2**64:016x}" for k in range(12)]
    rows = [
        r("a", ph=far[0]), r("a", label="y", ph=far[0]), r("b", w=10, ph=far[1]), r("c", sha="C" * 64, ph=far[2]), r("d", sha="c" * 64, ph=far[3]),
        r("e", url="http://h/p?q", ph=far[4]), r("f", url="https://H/p", kind="wikimedia_commons", ph=far[5]), r("g", ph="f" * 16), r("h", ph="f" * 15 + "e"), r("i", label="y", sha="e" * 64, ph=far[7]), r("j", sha="e" * 64, ph=far[8]),
    ]
    df = spark.createDataFrame(rows, "image_id string, label string, source_kind string, source_dataset string, exact_sha256 string, perceptual_hash string, original_url string, width long, height long")
    got = {x.image_id: (x.reason, x.near_cluster) for x in dedup.prepare_candidates(df).collect()}
    assert got["a"][0] == "id_label_conflict" and got["b"][0] == "too_small" and got["c"][0] is None and got["d"][0] == "exact_duplicate"
    assert got["e"][0] == "url_duplicate" and got["f"][0] is None and got["i"][0] == got["j"][0] == "exact_label_conflict"
    assert got["g"] == (None, "near-g") and got["h"] == (None, "near-g")


def fold_exactly(groups, ratios, seed):
    """The allocation one group at a time, in fractions."""
    goal = sampling.largest_remainder(sum(g[2] for g in groups), ratios)
    counts, want = [0, 0, 0], {}
    for _, g, s, k in sorted(groups, key=lambda x: (-x[2], hashlib.sha256(f"{seed}:{x[3]}".encode()).hexdigest(), x[1])):
        cost = [sum(Fraction((counts[j] + (s if j == c else 0) - goal[j]) ** 2, max(1, goal[j])) for j in range(3)) for c in range(3)]
        best = cost.index(min(cost))
        counts[best] += s
        want[g] = sampling.SPLITS[best]
    return want


def test_allocation_is_the_fold_in_turn(spark):
    rng = random.Random(2)
    cases = {f"l{c}": [(f"l{c}", 1000 * c + i, rng.choice([1, 1, 1, 2, 3, 7, 40]), f"k{i % 90}") for i in range(rng.choice([1, 2, 5, 60, 400]))] for c in range(12)}
    rows = [g for c in cases.values() for g in c]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "label string, group long, size long, member_key string")
    for ratios in ((0.85, 0.10, 0.05), (1 / 3, 1 / 3, 1 / 3), (0.5, 0.5, 0.0)):
        got = {r.group: r.split for r in sampling.allocate_groups(df, ratios, 7).collect()}
        assert got == {g: s for c in cases.values() for g, s in fold_exactly(c, ratios, 7).items()}


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_ratio_fill_in_blocks(spark, block):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", None]), i, rng.randrange(1, 9), f"k{i}") for i in range(24)]
    want = {}
    for label in ("a", None):
        mine = sorted((r for r in rows if r[0] == label), key=lambda r: (hashlib.sha256(f"5:{r[3]}".encode()).hexdigest(), r[1]))
        goals, counts = [max(1.0, float(x)) for x in sampling.rounded_targets(sum(r[2] for r in mine), (0.85, 0.10, 0.05))], [0, 0, 0]
        for r in mine:
            shares = [c / g for c, g in zip(counts, goals, strict=True)]
            s = shares.index(min(shares))
            counts[s] += r[2]
            want[r[1]] = sampling.SPLITS[s]
    df = spark.createDataFrame(rows, "label string, group long, size long, member_key string")
    assert {r.group: r.split for r in sampling.ratio_fill(df, (0.85, 0.10, 0.05), 5, block=block).collect()} == want
    assert sampling.ratio_fill(df.limit(0), (0.85, 0.10, 0.05), 5).count() == 0 and sampling.allocate_groups(df.limit(0), (0.85, 0.10, 0.05), 5).count() == 0


def test_tree_digest(spark):
    rows = [(i, f"d{i}") for i in range(23)]
    sha = lambda lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    level = [f"{i}\0{d}" for i, d in rows]
    for _ in range(3):
        level = [sha(level[i : i + 3]) for i in range(0, len(level), 3)]
    df = spark.createDataFrame(rows[::-1], "path long, digest string").repartition(3)
    assert [tuple(r) for r in metrics.tree_digest(df, "path", "digest", fan=3, levels=1).collect()] == [(23, level[0])]
    assert [tuple(r) for r in metrics.tree_digest(df.limit(1), "path", "digest", fan=3, levels=2).collect()][0][0] == 1


def test_components_of_dense_edges_start_from_few(spark):
    rng = random.Random(3)
    edges = [(a, b) for lo in (0, -90) for a in range(lo, lo + 80) for b in range(lo, a)] + [(1000 + i, 1001 + i) for i in range(50)] + [(5, 5)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    stars = graph.local_stars(df).where("a <> b")
    assert stars.count() <= 3 * (80 + 80 + 51)  # of 6,370 edges
    assert {(r.node, r.root) for r in graph.connected_components(df).collect()} == {(a, lo) for lo in (0, -90) for a in range(lo, lo + 80)} | {(1000 + i, 1000) for i in range(51)}
    assert graph.connected_components(df.selectExpr("cast(a as int) a", "cast(b as int) b")).schema["root"].dataType.simpleString() == "int"


def test_links_of_near_hashes_hold_the_same_components_with_few_pairs(spark):
    """Copies with small changes lie near each other in every pair; clusters need no more than what connects them."""
    rng = random.Random(5)
    rows = []
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(40):
            h = base
            for _ in range(rng.randrange(4)):
                h ^= 1 << rng.randrange(64)
            rows.append((len(rows), f"{h:016x}", rng.choice(["x", "x", "y", None])))
    df = spark.createDataFrame(rows, "id long, h string, lab string")
    for within in (None, "lab"):
        every, few = (dedup.near_pairs(df, "id", "h", 4, within=within, linked=x).collect() for x in (False, True))
        known = {(r.a, r.b): r.distance for r in every}
        assert all(known[r.a, r.b] == r.distance for r in few) and len(every) > 2 * len(few)

        def roots(pairs):
            if not pairs:
                return {}
            found = graph.connected_components(spark.createDataFrame([(r.a, r.b) for r in pairs], "a long, b long"))
            return {r.node: r.root for r in found.collect()}

        assert roots(every) == roots(few)


def test_near_pairs_of_wide_hashes(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(256) for _ in range(20)]
    rows = [(i, base[i % 20] ^ sum(1 << b for b in rng.sample(range(256), i // 20)), "abc"[i % 3]) for i in range(200)] + [(200, base[3], "a"), (201, 5, "a"), (202, 7, None)]
    as_text = [(i, f"{h:x}".upper() if i % 2 else f"{h:064x}", g) for i, h, g in rows] + [(203, None, "a")]
    df = spark.createDataFrame(as_text, "id long, hash string, g string")
    reps = {}
    for i, h, _ in rows:
        reps[h] = min(i, reps.get(h, i))
    want = {(a, b): (x ^ y).bit_count() for x, a in reps.items() for y, b in reps.items() if a < b and (x ^ y).bit_count() <= 12}
    assert {(r.a, r.b): r.distance for r in dedup.near_pairs(df, "id", "hash", 12).collect()} == want and len(want) > 100
    for threshold, chars in ((0, None), (3, 80), (64, None)):
        got = {(r.a, r.b) for r in dedup.near_pairs(df, "id", "hash", threshold, chars=chars, agree=1 if threshold == 64 else None).collect()}
        assert got == {(a, b) for x, a in reps.items() for y, b in reps.items() if a < b and (x ^ y).bit_count() <= threshold}
    same = {r.id: r.cluster for r in dedup.near_clusters(spark.createDataFrame([(1, "ff", None), (2, "0FF", None), (3, "ff", "a"), (4, None, None)], "id long, hash string, g string"), "id", "hash", 1, within="g").collect()}
    assert same == {1: "near-1", 2: "near-1"}


def test_split_and_sampling(spark):
    assert sampling.largest_remainder(10, (0.85, 0.10, 0.05)) == [9, 1, 0] and sampling.rounded_targets(7, (0.5, 0.5)) == [4, 3]
    many = sampling.oversample(spark.createDataFrame([("a", i) for i in range(3)], "g string, k long"), "g", "k", 8, 1).collect()
    assert len(many) == 8 and sorted(r.ordinal for r in many) == list(range(8))
    with pytest.raises(ValueError):
        metrics.blend(None, None, 2)


def test_metrics(spark):
    rows = spark.createDataFrame([(0, [0.7, 0.1, 0.2]), (1, [0.4, 0.4, 0.2]), (2, [0.1, 0.1, 0.8]), (2, [0.6, 0.3, 0.1])], "truth int, p array<double>")
    labels = ("a", "b", "c")
    table = {(r.truth, r.pred): r.n for r in metrics.confusion(rows, labels).collect()}
    assert len(table) == 9 and table["b", "a"] == 1 and table["a", "b"] == 0  # ties go to the lowest index
    assert abs(metrics.macro_f1_target(rows, labels, 2).first()[0] - (2 / 3) / 2) < 1e-12
    fit = metrics.fit_temperature(rows, steps=451).first()
    assert 0.5 <= fit.t <= 5.0 and fit.nll <= metrics.negative_log_likelihood(rows).first().nll + 1e-12
    p = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    assert [metrics.percentile(p, "v", 0.95, k).first().percentile for k in ("nearest", "rounded", "floored")] == [10.0, 10.0, 9.0]


def test_gate_and_quality(spark):
    ok, bad = spark.range(1).select(F.lit(True).alias("passed")), spark.range(1).select(F.lit(None).cast("boolean").alias("passed"))
    assert tuple(audit.gate({"b": ok, "a": bad}).first()) == (False, ["a"])
    q = audit.quality_gate(F.lit(1.0), F.lit(5.0), F.lit(0.0), F.lit(0.0), F.lit(500), F.lit(1.0), min_blur=2, min_mean=5, max_mean=9, max_over=1, max_under=1, max_age_ms=500, min_coverage=1)
    assert spark.range(1).select(q.alias("q")).first().q == ["blur"]
    with pytest.raises(ValueError):
        audit.require_empty(ok, "rows")


def test_components_of_dense_graphs_take_few_jobs(spark):
    """Every node hangs below several hubs: merging in tasks solves that without rounds of stars, each of which took some 40 jobs."""
    edges = spark.range(6000).select((F.col("id") % 9).alias("a"), (F.col("id") % 2500 + 10).alias("b"))
    chain = spark.range(200).select((F.col("id") + 5000).alias("a"), (F.col("id") + 5001).alias("b"))
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    before = scheduler.nextJobId()
    found = {r.node: r.root for r in graph.connected_components(edges.unionAll(chain)).collect()}
    assert scheduler.nextJobId() - before < 40
    assert found == {**{i: 0 for i in [*range(9), *range(10, 2510)]}, **{i: 5000 for i in range(5000, 5201)}}
