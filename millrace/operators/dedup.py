"""Staged duplicate removal: id, technical, exact content, URL, then near-duplicate flags."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.hashing import hash_words, normal_hash
from millrace.functions.text import normalize_url
from millrace.operators.graph import connected_components
from millrace.sources.storage import cut, unused

#: Fixed order of sources; all others come last.
SOURCE_PRIORITY = {"oxford_iiit_pet": 0, "inaturalist": 1, "wikimedia_commons": 2, "gbif": 3}


def source_priority(source: Column, order: dict[str, int] | None = None) -> Column:
    order = order or SOURCE_PRIORITY
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))]), source), F.lit(99))


def canonical(rows: DataFrame, key: str, order: list[Column], id_col: str) -> DataFrame:
    """rows plus n (rows of the key) and keeper (id of the first in order), for non-empty keys.

    The keeper comes from a minimum aggregation joined back, not from a window, so a key that holds a third of
    all rows is combined map-side and its join can be split.
    """
    best = rows.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.count("*").alias("n"), F.min_by(F.col(id_col), F.struct(*order, F.col(id_col))).alias("keeper"))
    return rows.join(best, key, "left")


def exact_duplicates(rows: DataFrame, digest: str, id_col: str, label_col: str) -> DataFrame:
    """One row per content hash held several times: cluster, labels, keeper, members, cross_label."""
    per = rows.groupBy(digest).agg(F.count("*").alias("members"), F.min(id_col).alias("keeper"), F.sort_array(F.collect_set(label_col)).alias("labels"))
    return per.where("members > 1").select(F.concat(F.lit("exact-"), F.substring(digest, 1, 12)).alias("cluster"), digest, "members", "keeper", "labels", (F.size("labels") > 1).alias("cross_label"))


def _hash_chars(rows: DataFrame, hash_col: str) -> int:
    """Hex characters of the longest hash, in whole words of 16."""
    longest = rows.agg(F.max(F.length(hash_col)).alias("n")).first().n or 16
    return -(-longest // 16) * 16


def near_pairs(rows: DataFrame, id_col: str, hash_col: str, threshold: int = 4, within: str | None = None, agree: int | None = None, chars: int | None = None, linked: bool = False) -> DataFrame:
    """Pairs (a, b, distance) of representatives of different hashes within `threshold` bits.

    Hashes are numbers of any length in hex; `chars` is the most digits, by default those of the longest in whole words of 64 bits. Rows with equal hashes are one class,
    spoken for by its smallest id (see near_clusters for membership); rows whose hash or `within` is null belong to none. The
    bits are cut into threshold + agree blocks; hashes within the threshold agree on at least `agree` of them, so an
    equi-join on (choice of blocks, bits) loses nothing. A key of two blocks of six has 21 of 64 bits; unless `agree` is given
    it follows the number of hashes, so that keys have two bits more than that number and unrelated hashes seldom meet.
    A pair is kept at the first choice it agrees on.

    With `linked`, only pairs that hold the same hashes together: each hash first meets the smallest of its keys, and of all other
    pairs those within a component of such links, which would add nothing, are not made. So copies of a text give pairs in
    proportion to their number.
    """
    scope = [within] if within else []
    chars = chars or _hash_chars(rows, hash_col)
    width = 4 * chars
    reps = _classes_of_hash(rows, id_col, hash_col, scope, chars).withColumnRenamed("rep", "id")
    if agree is None:
        reps = cut(reps)
        agree, wanted = 2, math.log2(max(1, reps.count())) + 2
        while width * agree / (threshold + agree) < wanted and agree < 6:
            agree += 1
    words = hash_words(F.col("hash"), chars)
    reps = cut(reps.select(*scope, "id", *[w.alias(f"h{i}") for i, w in enumerate(words)]))
    blocks = threshold + agree
    edges = [round(i * width / blocks) for i in range(blocks + 1)]
    choices = list(combinations(range(blocks), agree))

    def pieces(i: int) -> list[tuple[int, int, int]]:
        """(word, first bit from the top, end) of a block."""
        return [(w, max(edges[i] - 64 * w, 0), min(edges[i + 1] - 64 * w, 64)) for w in range(edges[i] // 64, -(-edges[i + 1] // 64))]

    def bits(i: int) -> list[Column]:
        return [F.shiftrightunsigned(F.col(f"h{w}"), 64 - hi).bitwiseAND(F.lit(-1 if hi - lo == 64 else (1 << (hi - lo)) - 1)) for w, lo, hi in pieces(i)]

    def key(choice: tuple[int, ...]) -> Column:
        if width > 64:  # more bits than a key holds; other hashes that fall together are told apart by their distance
            return F.xxhash64(*[b for i in choice for b in bits(i)])
        out = bits(choice[0])[0]
        for i in choice[1:]:
            out = F.shiftleft(out, edges[i + 1] - edges[i]).bitwiseOR(bits(i)[0])
        return out

    values = [f"h{i}" for i in range(len(words))]

    def post(held: DataFrame) -> DataFrame:
        return held.select("*", F.posexplode(F.array(*[key(c) for c in choices])).alias("band", "bits"))

    posted, at, sure = post(reps), [*scope, "band", "bits"], None
    if linked:
        lowest = posted.groupBy(*at).agg(F.min(F.struct("id", *values)).alias("low"), F.count("*").alias("n")).where("n > 1")
        apart = [F.bit_count(F.col(v).bitwiseXOR(F.col(f"low.{v}"))) for v in values]
        met = posted.join(cut(lowest), at).withColumn("distance", sum(apart[1:], apart[0])).where((F.col("low.id") < F.col("id")) & (F.col("distance") <= threshold))
        sure = cut(met.select(*scope, F.col("low.id").alias("a"), F.col("id").alias("b"), "distance").distinct())
        found = connected_components(sure.select("a", "b")).withColumnRenamed("node", "id")
        posted = post(cut(reps.join(found, "id", "left").withColumn("root", F.coalesce("root", "id"))))
        several = posted.groupBy(*at).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(*at)
        posted = cut(posted.join(several, at, "left_semi"))
    left, right = posted.alias("l"), posted.alias("r")
    differ = [F.col(f"l.h{i}").bitwiseXOR(F.col(f"r.h{i}")) for i in range(len(words))]
    distance = sum((F.bit_count(d) for d in differ[1:]), F.bit_count(differ[0]))
    same = (F.col("l.band") == F.col("r.band")) & (F.col("l.bits") == F.col("r.bits")) & (F.col("l.id") < F.col("r.id")) & (distance <= threshold)
    for s in scope:
        same &= F.col(f"l.{s}") == F.col(f"r.{s}")
    if linked:
        same &= F.col("l.root") != F.col("r.root")
    # The first choice that a pair agrees on: the first whose bits do not differ.
    first = F.lit(None).cast("int")
    for band in reversed(range(len(choices))):
        masks: dict[int, int] = {}
        for i in choices[band]:
            for w, lo, hi in pieces(i):
                masks[w] = masks.get(w, 0) + (1 << (64 - lo)) - (1 << (64 - hi))
        equal = [differ[w].bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)) == 0 for w, mask in masks.items()]
        both = equal[0]
        for e in equal[1:]:
            both &= e
        first = F.when(both, band).otherwise(first)
    pairs = left.join(right, same & (F.col("l.band") == first))
    pairs = pairs.select(*[F.col(f"l.{s}").alias(s) for s in scope], F.col("l.id").alias("a"), F.col("r.id").alias("b"), distance.alias("distance"))
    return pairs if sure is None else pairs.unionAll(sure)


def _classes_of_hash(rows: DataFrame, id_col: str, hash_col: str, scope: list[str], chars: int) -> DataFrame:
    """scope, hash (normal), rep (smallest id), n of the classes of equal hashes."""
    known = rows.where(F.col(hash_col).isNotNull()).select(*scope, normal_hash(F.col(hash_col), chars).alias("hash"), F.col(id_col).alias("rep"))
    return known.groupBy(*scope, "hash").agg(F.min("rep").alias("rep"), F.count("*").alias("n"))


def near_clusters(rows: DataFrame, id_col: str, hash_col: str, threshold: int = 4, within: str | None = None, prefix: str = "near-", chars: int | None = None) -> DataFrame:
    """id, cluster, members for rows that are near another row: single linkage, named by the smallest id.

    Rows whose hash is null are near nothing; rows whose `within` is null are near those of equal hash alone.
    """
    scope = [within] if within else []
    chars = chars or _hash_chars(rows, hash_col)
    reps = _classes_of_hash(rows, id_col, hash_col, scope, chars).drop("n")
    found = connected_components(near_pairs(rows, id_col, hash_col, threshold, within, chars=chars, linked=True).select("a", "b"))
    mine = rows.where(F.col(hash_col).isNotNull()).select(*scope, F.col(id_col).alias("id"), normal_hash(F.col(hash_col), chars).alias("h"))
    other = reps.select(*[F.col(c).alias(f"{c}_") for c in scope], F.col("hash").alias("hash_"), "rep")
    same = F.col("h") == F.col("hash_")
    for c in scope:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_"))
    held = mine.join(other, same).join(found.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("root", "rep").alias("root"))
    sizes = held.groupBy("root").agg(F.count("*").alias("members")).where("members > 1")
    return held.join(sizes, "root").select("id", F.concat(F.lit(prefix), F.col("root").cast("string")).alias("cluster"), "members")


def near_edges(rows: DataFrame, id_col: str, hash_col: str, threshold: int = 4, within: str | None = None) -> DataFrame:
    """One row: hashes compared, pairs of different hashes within the threshold, clusters and rows in clusters."""
    scope, chars = [within] if within else [], _hash_chars(rows, hash_col)
    pairs = cut(near_pairs(rows, id_col, hash_col, threshold, within, chars=chars))
    reps = _classes_of_hash(rows, id_col, hash_col, scope, chars)
    found = connected_components(pairs.select("a", "b")).withColumnRenamed("node", "rep")
    sizes = reps.join(found, "rep", "left").groupBy(F.coalesce("root", "rep").alias("root")).agg(F.sum("n").alias("members"))
    one = sizes.agg(F.count_if(F.col("members") > 1).alias("clusters"), F.coalesce(F.sum(F.when(F.col("members") > 1, F.col("members"))), F.lit(0)).alias("clustered"))
    return reps.agg(F.count("*").alias("hashes")).join(pairs.agg(F.count("*").alias("edges")), F.lit(True)).join(one, F.lit(True))  # rows of one


def cluster_name(members: Column) -> Column:
    """Name of a cluster by the digest of its sorted ids."""
    return F.concat(F.lit("near-"), F.substring(F.sha2(F.array_join(F.sort_array(members), "|"), 256), 1, 12))


def prepare_candidates(rows: DataFrame, *, min_side: int = 160, threshold: int = 4) -> DataFrame:
    """The staged decision per row. rows: image_id, label, source_kind, source_dataset, exact_sha256, perceptual_hash,
    original_url, width, height (longs). Adds status, reason, cluster, near_cluster.

    Precedence: id, technical, exact content, URL; what an earlier stage rejects never enters a later one, and
    near duplicates are only flagged, within a label. Groups that span labels are rejected whole.
    """
    nth, spans = unused(rows, "nth", "labels_of_id")
    ranked = rows.withColumn(nth, F.row_number().over(Window.partitionBy("image_id").orderBy("label", "source_dataset")))
    spread = rows.groupBy("image_id").agg(F.size(F.collect_set("label")).alias(spans))
    base = ranked.where(F.col(nth) == 1).drop(nth).join(spread, "image_id")
    conflict = F.col(spans) > 1
    small = F.coalesce((F.col("width") < min_side) | (F.col("height") < min_side), F.lit(True))
    base = base.withColumn("reason", F.when(conflict, "id_label_conflict").when(small, "too_small"))
    base = base.withColumn("cluster", F.when(conflict, F.concat(F.lit("id-conflict-"), F.col("image_id").cast("string"))))
    base = _stage(base, F.lower("exact_sha256"), [], "exact", lambda k: F.substring(k, 1, 12))
    base = _stage(base, normalize_url(F.col("original_url")), [source_priority(F.col("source_kind"))], "url", lambda k: F.substring(F.sha2(k, 256), 1, 12))
    base = cut(base)
    near = near_clusters(base.where("reason is null"), "image_id", "perceptual_hash", threshold, within="label").select(F.col("id").alias("image_id"), F.col("cluster").alias("near_cluster"))
    return base.join(near, "image_id", "left").withColumn("status", F.when(F.col("reason").isNull(), "quarantine").otherwise("rejected")).drop(spans)


def _stage(rows: DataFrame, key: Column, order: list[Column], name: str, short) -> DataFrame:
    k, n, labels, keeper = unused(rows, "stage_key", "stage_n", "stage_labels", "stage_keeper")
    keyed = rows.withColumn(k, F.when(F.col("reason").isNull() & (F.coalesce(key, F.lit("")) != ""), key))
    per = keyed.where(F.col(k).isNotNull()).groupBy(k).agg(F.count("*").alias(n), F.size(F.collect_set("label")).alias(labels), F.min_by("image_id", F.struct(*order, F.col("image_id"))).alias(keeper)).where(F.col(n) > 1)
    both = keyed.join(per, k, "left")
    hit = F.col(n).isNotNull()
    both = both.withColumn("reason", F.when(hit & (F.col(labels) > 1), f"{name}_label_conflict").when(hit & (F.col("image_id") != F.col(keeper)), f"{name}_duplicate").otherwise(F.col("reason")))
    both = both.withColumn("cluster", F.when(hit, F.coalesce("cluster", F.concat(F.lit(f"{name}-"), short(F.col(k))))).otherwise(F.col("cluster")))
    return both.drop(k, n, labels, keeper)


def gap_fill(rows: DataFrame, frozen: DataFrame, *, min_side: int, limit: int, by: str = "label") -> DataFrame:
    """First-match reject reason per row of a new pool, in (source_kind, image_id) order, up to `limit` per label.

    rows: image_id, label, source_kind, sha, width, height, license, provenance. frozen: sha.
    """
    held, first, last_ = unused(rows.withColumn("reason", F.lit("")), "frozen", "first", "last")
    marked = rows.join(frozen.select("sha").distinct().withColumn(held, F.lit(True)), "sha", "left")
    order = F.struct("source_kind", "image_id")
    small = F.coalesce((F.col("width") < min_side) | (F.col("height") < min_side), F.lit(True))
    bare = (F.coalesce("license", F.lit("")) == "") | (F.coalesce("provenance", F.lit("")) == "")
    fresh = F.col(held).isNull()
    # A content is a duplicate only after a row that was taken, so the first row that passes all else decides.
    taken = marked.where(fresh & ~small & ~bare).groupBy("sha").agg(F.min(order).alias(first))
    marked = marked.join(taken, "sha", "left")
    reason = F.when(~fresh, "already_in_frozen_split").when(order > F.col(first), "duplicate_in_new_pool").when(small, "too_small").when(bare, "missing_provenance_or_license")
    done = cut(marked.withColumn("reason", reason).drop(first, held))
    # The last row that a label takes; ranks stop at the limit before the shuffle, so no label is sorted whole.
    nth = F.row_number().over(Window.partitionBy(by).orderBy("source_kind", "image_id"))
    last = cut(done.where("reason is null").select(by, "source_kind", "image_id", nth.alias("nth")).where(F.col("nth") <= limit).groupBy(by).agg(F.max(order).alias(last_)))
    over = F.col("reason").isNull() & (order > F.col(last_))
    return done.join(last, by, "left").withColumn("reason", F.when(over, "over_limit").otherwise(F.col("reason"))).drop(last_)
