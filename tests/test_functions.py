import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from millrace.functions import boxes as B
from millrace.functions import hashing as H
from millrace.functions import text as X
from millrace.functions import vectors as V


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_text(spark):
    r = one(
        spark,
        html=X.clean_html(F.lit("<p>A &amp;lt; B<br>\n C</p>")), url=X.normalize_url(F.lit("HTTP://Ex.Test/A?q=1#F")), bare=X.normalize_url(F.lit("")), odd=X.normalize_url(F.lit("no url")),
        cc=X.license_code(F.lit("https://creativecommons.org/licenses/by-nc-sa/4.0/")), none=X.license_code(F.lit(None).cast("string")), pd=X.canonical_license_url(F.lit("Public domain"), F.lit("")),
        name=X.normalize_name(F.lit(" 001_Ragdoll Cat ")), slug=X.slug(F.lit("--A b/C!")), num=X.trailing_number(F.lit("x_12")), nonum=X.trailing_number(F.lit("x")), stem=X.file_stem(F.lit("a/b.c/d.tar.gz")),
        parent=X.parent_id(F.lit("p--v--1")), safe=X.safe_member_path(F.lit("a/b.jpg")), unsafe=X.safe_member_path(F.lit("a/../b")), unit=X.try_unit_float(F.lit("nan")), pos=X.try_positive_int(F.lit(" 7 ")), iso=X.iso_of_nanos(F.lit(1_500_000_000)),
    )
    assert r.html == "A &lt; B C" and r.url == "https://ex.test/A#F" and r.bare == "" and r.odd == "no url"
    assert r.cc == "cc-by-nc-sa" and r.none == "" and r.pd.endswith("publicdomain/mark/1.0/")
    assert r.name == "ragdoll_cat" and r.slug == "a_b_c" and r.num == 12 and r.nonum is None and r.stem == "d.tar" and r.parent == "p"
    assert r.safe and not r.unsafe and r.unit is None and r.pos == 7 and r.iso == "1970-01-01T00:00:01+00:00"


def test_hashing(spark):
    bits = F.array(*[F.lit(i % 3 == 0) for i in range(64)])
    want = f"{int(''.join('1' if i % 3 == 0 else '0' for i in range(64)), 2):016x}"
    px = F.array(*[F.lit(float((i * 7) % 11)) for i in range(72)])
    r = one(spark, hexa=H.bits_to_hex(bits), d=H.hamming(F.lit("ffffffffffffffff"), F.lit("fffffffffffffff0")), dh=H.difference_hash(px))
    dh = "".join("1" if (9 * (i // 8) + i % 8) * 7 % 11 > (9 * (i // 8) + i % 8 + 1) * 7 % 11 else "0" for i in range(64))
    assert r.hexa == want and r.d == 4 and r.dh == f"{int(dh, 2):016x}"
    long_a, long_b = "f" * 64, "0" + "F" * 62 + "e"
    r = one(spark, whole=H.hamming(F.lit(long_a), F.lit(long_b)), short=H.hamming(F.lit("ff"), F.lit("0" * 40 + "fe")), none=H.hamming(F.lit(None).cast("string"), F.lit("ff")))
    assert r.whole == 5 and r.short == 1 and r.none is None
    with pytest.raises(Exception, match="more than 64"):
        one(spark, x=H.hamming(F.lit("f" * 65), F.lit("f")))
    wide = F.array(*[F.lit(float((i * 7) % 11)) for i in range(272)])
    assert one(spark, x=H.difference_hash(wide, 16)).x == f"{int(''.join('1' if (17 * (i // 16) + i % 16) * 7 % 11 > (17 * (i // 16) + i % 16 + 1) * 7 % 11 else '0' for i in range(256)), 2):064x}"
    docs = spark.createDataFrame([(1, "a b a"), (2, "b a a"), (3, None), (4, "")], "id long, text string")
    got = {r.id: r.simhash for r in H.simhash(docs, "id", "text").collect()}
    assert got[1] == got[2] != got[3] == got[4] == "0" * 16


def test_vectors(spark):
    p = F.array(F.lit(0.2), F.lit(0.5), F.lit(0.5), F.lit(0.0))
    r = one(spark, a=V.argmax(p), t=V.top_k(p, list("wxyz"), 2), m=V.margin(p), s=V.temperature_scale(p, 1.0), n=V.normalize_then_scale(p, 2.0, pad=1), bad=V.normalize_then_scale(F.array(F.lit(0.0), F.lit(math.nan))), f=V.target_only(p, 2), pm=V.permute(p, [3, 0]))
    assert r.a == 1 and [x.label for x in r.t] == ["x", "y"] and r.m == 0
    assert abs(sum(r.s) - 1) < 1e-12 and abs(r.s[1] - 0.5 / 1.2) < 1e-9
    assert len(r.n) == 5 and r.n[-1] == 0 and r.bad is None and r.f == [0.2 / 0.7, 0.5 / 0.7, 0.0] and r.pm == [0.0, 0.2]
    assert V.index_mapping(["b", "a"], ["a", "b"]) == [1, 0]
    with pytest.raises(ValueError):
        V.index_mapping(["a", "a"], ["a", "b"])
    with pytest.raises(ValueError):
        V.exactly_one(["a", "a"], "a")


def test_boxes(spark):
    def box(x1, y1, x2, y2, c):
        return Row(x1=float(x1), y1=float(y1), x2=float(x2), y2=float(y2), confidence=float(c))

    df = spark.createDataFrame([([box(0, 0, 10, 10, 0.9), box(0, 0, 10, 9, 0.8), box(20, 20, 30, 30, 0.7)], box(-5, 2, 9, 12, 1))], f"boxes array<{B.BOX}>, b {B.BOX}")
    r = df.select(B.non_maximum_suppression(F.col("boxes"), 0.85).alias("k"), B.padded_bounds(F.col("b"), F.lit(20), F.lit(20), 0.15).alias("p"), B.center_bounds(F.lit(5), F.lit(7), 0.5).alias("c"), B.iou(F.col("b"), F.col("b")).alias("i"), B.valid_box(F.col("b")).alias("v")).first()
    assert [x.confidence for x in r.k] == [0.9, 0.7] and tuple(r.p) == (0, 0, 12, 14) and tuple(r.c) == (1, 1, 3, 5) and r.i == 1 and r.v
    mode, reason = B.route(F.lit(True), F.lit(True), F.lit(False), F.array(F.lit(1)), F.lit(True), F.lit(9), 1)
    assert tuple(one(spark, m=mode, r=reason)) == ("centre_fallback", "mismatched_observation")


def test_times_carry_the_offset_of_their_zone(spark):
    summer = 1_720_000_000_999_999_999  # 2024-07-03T09:46:40 UTC
    want = {"UTC": "2024-07-03T09:46:40+00:00", "Asia/Kolkata": "2024-07-03T15:16:40+05:30", "America/New_York": "2024-07-03T05:46:40-04:00"}
    for session in ("UTC", "Asia/Tokyo"):
        before = spark.conf.get("spark.sql.session.timeZone")
        spark.conf.set("spark.sql.session.timeZone", session)
        try:
            got = spark.range(1).select(*[X.iso_of_nanos(F.lit(summer), z).alias(z) for z in want], X.iso_of_nanos(F.lit(-1)).alias("old"), X.iso_of_nanos(F.lit(None).cast("long")).alias("none")).first()
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)
        assert {z: got[z] for z in want} == want and got.old == "1969-12-31T23:59:59+00:00" and got.none is None


def test_references_that_were_cut_off_stay_where_an_end_is_asked_for(spark):
    cut_off = F.lit("<title>a &am</title><p>b&amp</p> &#39; &amp;lt; &notit; &eacute;&#3")
    got = spark.range(1).select(X.clean_html(cut_off, ended=True).alias("ended"), X.clean_html(cut_off).alias("all")).first()
    assert got["ended"] == "a &am b&amp ' &lt; ¬it; é&#3" and got["all"].startswith("a &am b& ' &lt;")


def test_html_clean_keeps_a_title_that_ends_inside_a_reference(spark, tmp_path):
    from millrace.plans import catalog

    spark.createDataFrame([(1, "u", "<h1>x &amp; y&amp</h1>z"), (2, "u", "open <b"), (3, "u", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    import duckdb

    want = duckdb.sql(catalog.ORACLE["html_clean"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert sorted(tuple(r) for r in catalog.QUERIES["html_clean"](spark, str(tmp_path)).collect()) == sorted(want)


def test_fingerprints_hold_few_words_whatever_a_batch_has(spark):
    import hashlib
    import tracemalloc

    import pyarrow as pa

    texts = [" ".join(f"w{i}-{j}" for j in range(1000)) for i in range(400)] + ["", "a b a", " ".join(["x", "y"] * 40_000)]
    tracemalloc.start()
    (got,) = H._simhash.func(iter([pa.array(texts)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # 400,000 different words would take more
    for text, found in zip(texts[-4:], got.to_pylist()[-4:], strict=True):
        sums = [0] * 64
        for w in text.split():
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
            sums = [s + (1 if h >> (63 - i) & 1 else -1) for i, s in enumerate(sums)]
        assert int(found, 16) == sum(1 << (63 - i) for i, s in enumerate(sums) if s > 0)
