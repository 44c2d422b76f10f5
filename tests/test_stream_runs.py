"""Sinks, cameras and state processors across restarts, crashes and repeated batches."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.sources import remote
from millrace.streaming import runs, scoring
from millrace.streaming import windows as W


def test_a_batch_is_shown_once_however_often_it_runs(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3)], "id long, x string, nth long")
    calls = []

    def fail_once(batch_id):
        calls.append(batch_id)
        if len(calls) == 1:
            raise InterruptedError

    sink = runs.IdempotentSink(spark, f"file://{tmp_path}/shown", "id", "nth", fail_once)
    assert sink.rows(rows.schema).count() == 0
    with pytest.raises(InterruptedError):
        sink(rows, 0)
    assert sink.rows(rows.schema).count() == 0  # written, not marked
    sink(rows, 0)
    sink(rows.withColumn("x", F.lit("other")), 0)  # marked: does nothing
    sink(spark.createDataFrame([(2, "late", 9), (3, "d", 10)], rows.schema), 1)
    assert sorted(tuple(r) for r in sink.rows(rows.schema).select("id", "x").collect()) == [(1, "a"), (2, "c"), (3, "d")]


def camera_rows(spark, log, starts, root, perbatch=4, **options):
    """Frames of two cameras after each number of starts."""
    spark.dataSource.register(remote.Cameras)
    stream = spark.readStream.format("cameras").option("cameras", f"left={root}/left\nright={root}/right").option("capture", "millrace.sources.remote:Recording")
    for k, v in options.items():
        stream = stream.option(k, v)
    return runs.in_starts([], [()] * (starts - 1), stream.option("log", log).option("perbatch", str(perbatch)).load(), "cameras")


def test_cameras_go_on_after_failures_and_restarts(spark, tmp_path):
    rng = random.Random(4)
    reads = [(c, i + 1, None if rng.random() < 0.25 else f"{c}{i}".encode()) for c in ("left", "right") for i in range(30 if c == "left" else 7)]
    root = f"file://{tmp_path}/rec"
    remote.write_recording(spark.createDataFrame(reads, "camera string, nth long, image binary"), root, chunk=5)
    good = {c: [x for k, _, x in reads if k == c and x is not None] for c in ("left", "right")}
    got = camera_rows(spark, f"file://{tmp_path}/log", 4, root, failures="10").collect()
    for c in good:
        mine = sorted((r.frame_id, bytes(r.image)) for r in got if r.camera == c)
        assert mine == list(enumerate(good[c]))[: len(mine)] and len(mine) == min(16, len(good[c]))
    reader = remote.CameraReader({"cameras": f"left={root}/left\nright={root}/right", "capture": "millrace.sources.remote:Recording", "log": f"file://{tmp_path}/log", "perbatch": "4"})
    assert reader.latestOffset() == {"left": 5, "right": 5} and reader.initialOffset() == {"left": 0, "right": 0}
    first = sorted((r.frame_id, r.captured_at_ns, bytes(r.image)) for r in got if r.camera == "left" and r.frame_id < 4)
    parts = reader.partitions({"left": 0, "right": 4}, {"left": 1, "right": 4})
    assert len(parts) == 1 and [(n, at, bytes(x)) for _, n, at, x in reader.read(parts[0])] == first  # read back, not polled again
    reader.keep = 1
    reader.commit({"left": 4, "right": 4})
    assert reader._logged("left") == [3] and reader.latestOffset()["left"] == 5
    with pytest.raises(RuntimeError, match="lacks batch"):
        list(reader.read(reader.partitions({"left": 9, "right": 4}, {"left": 10, "right": 4})[0]))


def test_a_recording_opens_at_a_read_without_those_before_it(spark, tmp_path):
    reads = [("left", i + 1, None if i % 4 == 1 else f"image {i}".encode() * (i % 3)) for i in range(23)]
    remote.write_recording(spark.createDataFrame(reads, "camera string, nth long, image binary"), f"file://{tmp_path}/rec", chunk=5)
    for name in ("1", "2"):
        (tmp_path / "rec" / "left" / f"{name:>010}.rec").unlink()  # files before the read are not needed
    for start in (17, 20, 23):
        capture, got = remote.Recording(f"file://{tmp_path}/rec/left", start), []
        with pytest.raises(EOFError):
            while True:
                got.append(capture.read())
        capture.release()
        assert got == [x for _, _, x in reads[start:]]


def test_a_dead_camera_gives_no_frames_and_no_gaps(spark, tmp_path):
    reads = [("left", i, None if 3 <= i <= 6 else f"l{i}".encode()) for i in range(1, 10)] + [("right", 1, b"r")]
    root = f"file://{tmp_path}/rec"
    remote.write_recording(spark.createDataFrame(reads, "camera string, nth long, image binary"), root)
    got = camera_rows(spark, f"file://{tmp_path}/log", 4, root, perbatch=3, failures="2").where("camera = 'left'").orderBy("frame_id").collect()
    assert [(r.frame_id, bytes(r.image)) for r in got] == [(0, b"l1"), (1, b"l2"), (2, b"l7"), (3, b"l8"), (4, b"l9")]


def test_queue_state_equals_a_queue(spark):
    rng = random.Random(8)
    rows = [(k, i, rng.choice(["preview", "confirm", "confirm", "pop"])) for k in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "key long, at long, kind string")
    feed = runs.Feed(df, "q")
    with runs.keyed_state(spark):
        out = feed.stream().groupBy("key").transformWithStateInPandas(W.BoundedQueue(2), W.BoundedQueue.SCHEMA, "Append", "None")
        parts = [(df.where("at < 20"),), (df.where("at >= 20"),), (spark.createDataFrame([(1, 5, "pop")], df.schema),)]
        got = {(r.key, r.at, r.outcome): r.item for r in runs.in_starts([feed], parts, out, "q").collect()}
    want = {(1, 5, "late"): None}
    for k in (1, 2):
        line, preview = [], None
        for _, at, kind in sorted(r for r in rows if r[0] == k):
            if kind == "preview":
                want[k, at, "held" if preview is None else "replaced"], preview = None, at
            elif kind == "confirm":
                want[k, at, "queued" if len(line) < 2 else "rejected"] = None
                line = [*line, at][:2]
            elif line:
                want[k, at, "popped"] = line.pop(0)
            else:
                want[k, at, "empty" if preview is None else "popped"], preview = preview, None
    assert got == want


def test_the_clock_empties_a_window_once(spark):
    s = 1_000_000
    rows = [(1, 1, 10 * s, 10 * s, True, 2.0), (1, 2, 12 * s, 11 * s, True, 4.0), (1, 3, 13 * s, 14 * s, True, 1.0), (2, 4, 14 * s, 14 * s, True, 6.0), (1, 5, 15 * s, 1 * s, True, 1.0), (1, 6, 40 * s, 40 * s, True, 8.0), (3, 7, 90 * s, 90 * s, False, 8.0)]
    df = spark.createDataFrame(rows, "key long, id long, at long, captured long, valid boolean, value double")
    feed = runs.Feed(df, "w")
    with runs.keyed_state(spark):
        timed = feed.stream().withColumn("time", F.timestamp_micros("at")).withWatermark("time", "0 seconds")
        out = timed.groupBy("key").transformWithStateInPandas(W.ClockedWindow(7, 5 * s, 20_000), W.ClockedWindow.SCHEMA, "Append", "EventTime")
        parts = [(df.where(f"at > {a * s} and at <= {b * s}"),) for a, b in ((0, 12), (12, 15), (15, 40), (40, 99))]
        got = sorted(((r.key, r.at // s, r.id, r.size, r.mean) for r in runs.in_starts([feed], parts, out, "w").collect()), key=str)
    want = [(1, 10, 1, 1, 2.0), (1, 12, 2, 2, 3.0), (1, 13, 3, 0, None), (1, 15, 5, 0, None), (1, 40, 6, 1, 8.0), (1, 60, None, 0, None), (2, 14, 4, 1, 6.0), (2, 34, None, 0, None), (3, 90, 7, 0, None)]
    assert got == sorted(want, key=str)


def test_counters_are_taken_while_rows_pass(spark, tmp_path):
    rows = spark.createDataFrame([(1, [0.5], True, None), (2, None, False, "stale"), (3, None, False, "odd"), (4, None, False, None)], scoring.OBSERVATION)
    out, seen = scoring.observed(rows, ["stale", "never"])
    out.write.parquet(f"{tmp_path}/o")
    assert dict(scoring.health_of(seen.get, ["stale", "never"])) == {"ok": 1, "stale": 1, "other": 2}


def test_slices_cover_all_rows(spark):
    df = spark.createDataFrame([(i,) for i in [None, 1, 1, 2, 3, 3, 3, 9]], "x long")
    parts = [[r.x for r in p.collect()] for p in runs.slices(df, F.col("x"), 3)]
    assert sorted((x for p in parts for x in p), key=str) == sorted([None, 1, 1, 2, 3, 3, 3, 9], key=str)
    assert sum(3 in p for p in parts) == 1 and None in parts[0] and [r.x for p in runs.slices(df.limit(0), F.col("x"), 3) for r in p.collect()] == []


def test_clicks_before_1970_with_large_ids_or_none_are_in_the_stream(spark, tmp_path):
    from millrace.plans import streams

    s, big = 1_000_000, 1 << 60
    rows = [(big + 1, -100 * s, 1, 1.0), (big + 3, -99 * s, 1, 3.0), (None, -98 * s, 1, 5.0), (7, 700 * s, 2, 2.0)]
    at = F.timestamp_micros("at")
    clicks = spark.createDataFrame(rows, "click_id long, at long, client_id long, value double")
    clicks.select("click_id", at.alias("ts"), at.alias("arrived_at"), "client_id", F.lit("view").alias("kind"), "value").write.parquet(f"{tmp_path}/clicks.parquet")
    got = {tuple(r) for r in streams.clocked_window_stream(spark, str(tmp_path)).collect()}
    assert got == {(1, big + 1, -100 * s, 1, 1.0), (1, big + 3, -99 * s, 2, 2.0), (1, None, -98 * s, 3, 3.0), (1, -1, 502 * s, 0, None), (2, 7, 700 * s, 1, 2.0)}
