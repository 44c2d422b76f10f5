import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from millrace.sources import files, remote, storage, tables
from millrace.streaming import scoring, windows


def test_csv(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('﻿image_id,label,note\n a ,x,"two\nlines"\nb,,\n', encoding="utf-8")
    assert [tuple(r) for r in tables.read_csv(spark, str(p)).collect()] == [("a", "x", "two\nlines"), ("b", "", "")]
    rows, missing, extra = tables.read_numbered_csv(spark, str(p), ["image_id", "label", "split"])
    assert [(r.row, r.image_id, r.split) for r in rows.orderBy("row").collect()] == [(2, "a", ""), (3, "b", "")] and missing == ["split"] and extra == ["note"]
    with pytest.raises(ValueError):
        tables.read_required(spark, str(p), ["zz"])
    tables.write_csv(rows, str(tmp_path / "out"), ["row", "nothing", "label"], single_file=True)
    got = tables.read_csv(spark, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in got.collect()) == [("2", "", "x"), ("3", "", "")]
    with pytest.raises(Exception):
        tables.write_csv(rows, str(tmp_path / "out"), ["row"])


def test_predictions(spark, tmp_path):
    head = ",".join(tables.PREDICTION_COLUMNS)
    good = f"i1,val_cal,persian,0.1,0.1,0.5,0.1,0.1,0.1,m,{'a' * 64},{'b' * 64},g\n"
    p = tmp_path / "p.csv"
    p.write_text(f"{head}\n{good}")
    r = tables.read_predictions(spark, str(p)).first()
    assert r.truth == 2 and r.p[2] == 0.5
    p.write_text(f"{head}\n{good}{good}")
    with pytest.raises(ValueError):
        tables.read_predictions(spark, str(p))
    p.write_text(f"x{head}\n{good}")
    with pytest.raises(ValueError):
        tables.read_predictions(spark, str(p))


def test_files(spark, tmp_path):
    (tmp_path / "train/a").mkdir(parents=True)
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"rest"
    jpg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x0b\x08" + (48).to_bytes(2, "big") + (64).to_bytes(2, "big") + b"\x01\x01\x11\0"
    (tmp_path / "train/a/x.png").write_bytes(png)
    (tmp_path / "train/a/y.jpg").write_bytes(jpg)
    (tmp_path / "train/a/z.jpg").write_bytes(b"no")
    inv = files.inventory(spark, str(tmp_path), ["png", "jpg"], content=True)
    sizes = {r.path[-5:]: (r.format, r.width, r.height) for r in files.image_sizes(inv).collect()}
    assert sizes == {"x.png": ("png", 640, 480), "y.jpg": ("jpeg", 64, 48), "z.jpg": (None, None, None)}
    assert {(r.split, r.label) for r in files.class_folders(inv).collect()} == {("train", "a")}
    assert files.resolve_exactly_one(spark.createDataFrame([("x.png",), ("q",)], "name string"), inv).orderBy("name").collect()[0].matches == 0
    names = spark.createDataFrame([("Rag_1",), ("Per_2",)], "folder string")
    assert {r.folder: r.label for r in files.map_folders(names, {"rag": "ragdoll", "per": "persian"}).collect()} == {"Rag_1": "ragdoll", "Per_2": "persian"}
    with pytest.raises(ValueError):
        files.map_folders(names, {"rag": "ragdoll"})
    lines = spark.createDataFrame([("s", "0 .5 .5 .2 .2"), ("s", "x"), ("s", "0 .5 .5 0 .2"), ("s", "")], "sample string, line string")
    assert sorted(r.ok for r in files.box_lines(lines).collect()) == [False, False, True]
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as t:
        for n in ("images/Persian_2.jpg", "images/Persian_1.jpg", "../Persian_3.jpg", "images/Persian_4.jpg"):
            i = tarfile.TarInfo(n)
            i.size = 1
            t.addfile(i, io.BytesIO(b"x"))
    (tmp_path / "t.tgz").write_bytes(buf.getvalue())
    got = files.tar_members(spark, str(tmp_path / "t.tgz"), r"([A-Za-z]+)_(\d+)\.jpg$", 2).collect()
    assert sorted(r.number for r in got) == [1, 2]
    sha = {r.name: r.sha256 for r in inv.collect()}
    plan = spark.createDataFrame([("train/a/x.png", "out/x.png", sha["x.png"])], "source string, target string, sha256 string")
    for _ in range(2):
        assert files.materialize(plan, str(tmp_path), str(tmp_path / "view")).first().ok


def pages(url):
    page = int(url.split("page=")[1].split("&")[0])
    return json.dumps({"results": [{"id": page * 10 + i} for i in range(2 if page < 3 else 1)]}).encode()


def test_inventory_lists_in_tasks_what_the_reader_lists(spark, tmp_path):
    for name in ("a/b/c/deep.txt", "a/x.txt", "a/_hidden/no.txt", "a/.no.txt", "a/_k=1/yes.txt", "a b/ä%20#.TXT", "empty.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if name == "empty.txt" else name.encode())
    (tmp_path / "none").mkdir()
    want = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).select("path", "length", "content")
    inv = files.inventory(spark, str(tmp_path), content=True)
    got = sorted(map(tuple, inv.select("path", "length", "content").collect()))
    assert [r for r in got if r[1]] == sorted(map(tuple, want.collect())) and len(got) == 5  # the reader leaves empty files out
    assert [r[2] for r in got if r[0].endswith("/empty.txt")] == [b""]
    assert not inv.inputFiles()  # no list of files in the driver


def test_remote(spark):
    spark.dataSource.register(remote.JsonPages)
    df = spark.read.format("json_pages").options(urls="http://a/x\nhttp://b/x", paging="number", pagesize="2", opener="tests.test_sources_and_streams:pages").load()
    assert df.count() == 10
    calls = []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise TimeoutError
        return b"{}"

    assert remote.fetch_json("u", flaky, pause=lambda s: None) == {} and len(calls) == 3
    off = lambda url: json.dumps({"results": [1, 2], "endOfRecords": "offset=2" in url}).encode()
    assert len(list(remote.offset_pages("u", "results", 2, off))) == 4
    tok = lambda url: json.dumps({"q": {"a": {"id": 1}}, **({} if "c=" in url else {"continue": {"c": "1"}})}).encode()
    assert len(list(remote.token_pages("u", "q", tok))) == 2
    keys = spark.createDataFrame([(x,) for x in "abcdea"], "k string").coalesce(1)
    got = {r.k: r.payload for r in remote.batched_lookup(keys, "k", 2, lambda k: {x: {"n": len(k)} for x in k if x != "b"}).collect()}
    assert set(got) == set("abcde") and got["b"] is None and set(got.values()) <= {None, '{"n": 1}', '{"n": 2}'}


class Camera:
    frames, opened = [b"a", b"b", None, b"c"], 0

    def __init__(self):
        Camera.opened += 1

    def read(self):
        return Camera.frames.pop(0) if Camera.frames else None

    def release(self): ...


def test_frame_reader_reconnects():
    """Ids go on after a failed read; what was read stays replayable until the next batch."""
    r = remote.FrameReader({"capture": "tests.test_sources_and_streams:Camera", "perbatch": "3"})
    rows, at = r.read(r.initialOffset())
    first = list(rows)
    assert [x[0] for x in first] == [0, 1] and at == {"frame": 2} and r.capture is None
    assert list(r.readBetweenOffsets({"frame": 0}, at)) == first
    rows, at = r.read(at)
    assert [(x[0], x[2]) for x in rows] == [(2, b"c")] and at == {"frame": 3}


def test_frames_are_read_back_after_a_restart(tmp_path):
    Camera.frames = [b"p", b"q", b"r"]
    options = {"capture": "tests.test_sources_and_streams:Camera", "perbatch": "2", "log": str(tmp_path / "log")}
    r = remote.FrameReader(options)
    rows, at = r.read({"frame": 0})
    first = list(rows)
    more, end = r.read(at)
    again = remote.FrameReader(options)  # a new driver, which holds nothing
    assert list(again.readBetweenOffsets({"frame": 0}, end)) == first + list(more) and [x[2] for x in first] == [b"p", b"q"]
    rows, after = again.read({"frame": 0})  # read but not committed before the restart
    assert list(rows) == first and after == at
    assert list(remote.FrameReader(options | {"log": None}).readBetweenOffsets({"frame": 0}, end)) == []


def test_files_are_fetched_and_packed_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def opener(url, calls=str(calls)):
        import uuid

        open(f"{calls}/{uuid.uuid4().hex}", "w").close()
        return url.encode()

    rows = spark.createDataFrame([(f"http://h/{i}", f"d/{i}.txt") for i in range(4)], "url string, target string")
    for method in ("fetched", "kept"):
        out = remote.cached_download(rows, str(tmp_path / "cache"), opener).collect()
        assert {r.method for r in out} == {method} and len(out) == 4 and len(list(calls.iterdir())) == 4
    members = spark.createDataFrame([("a.zip", f"m{i}", bytearray(b"x" * i)) for i in range(3)], "archive string, name string, content binary")
    a, b = (files.write_zips(members.repartition(n), str(tmp_path / f"z{n}")).collect() for n in (1, 3))
    assert [r.sha256 for r in a] == [r.sha256 for r in b]
    assert sorted((r.name, r.bytes) for r in files.zip_inventory(spark, str(tmp_path / "z1")).collect()) == [("m0", 0), ("m1", 1), ("m2", 2)]
    plan = spark.createDataFrame([("nowhere", "x", "0" * 64)], "source string, target string, sha256 string")
    assert [tuple(r) for r in files.materialize(plan, str(tmp_path), str(tmp_path / "view")).collect()] == [("x", "missing", False)]


def test_text_files_and_configuration(spark, tmp_path):
    path = str(tmp_path / "c.toml")
    storage.write_text(spark, path, "schema_version = 1\n[window]\nsize = 7\n")
    assert tables.load_toml(spark, path, rules={"window.size": (int, 1, 9)})["window"]["size"] == 7 and storage.exists(spark, path)
    for bad in ({"window.size": (int, 8, 9)}, {"window.none": (int, 0, 9)}, {"window.size": (float, 0, 9)}):
        with pytest.raises(ValueError):
            tables.load_toml(spark, path, rules=bad)
    with pytest.raises(ValueError):
        tables.load_toml(spark, path, version=2)
    with pytest.raises(Exception):
        storage.write_text(spark, path, "x")


def test_a_shared_folder_is_asked_for(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session())


def test_exactly_once_stream(spark, tmp_path):
    rows = [(i // 2, f"2026-01-01 00:00:{i:02d}") for i in range(20)]
    for b in range(2):
        spark.createDataFrame(rows[b * 9 : b * 9 + 11], "event_id long, t string").select("event_id", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(tmp_path / f"e{b}"))
    s = spark.readStream.schema("event_id long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path))
    q = windows.exactly_once(s, "event_id", "ts", "1 hour").writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [r.event_id for r in spark.table("once").collect()]
    assert sorted(got) == list(range(10))


EVENTS = [(i, i * 10, i % 3, i % 7 != 3, float(i)) for i in range(60)]
SCHEMA = "event_id long, at long, k long, valid boolean, value double"


def stream(spark, tmp_path, processor, schema, name):
    src = tmp_path / name
    for b in range(3):
        spark.createDataFrame(EVENTS[b * 20 : b * 20 + 20], SCHEMA).coalesce(1).write.parquet(str(src / f"b{b}"))
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    q = s.groupBy("k").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None").writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_temporal_window_stream_equals_batch(spark, tmp_path):
    got = {r.event_id: (r.size, r.mean) for r in stream(spark, tmp_path, windows.TemporalWindow(4), windows.TemporalWindow.SCHEMA, "tw").collect()}
    batch = windows.resetting_window(spark.createDataFrame(EVENTS, SCHEMA), "k", ["at", "event_id"], ~F.col("valid"), 4)
    assert got == {r.event_id: (r["size"], r["mean"]) for r in batch.collect()}


def test_ring_stream_equals_batch(spark, tmp_path):
    out = stream(spark, tmp_path, windows.LatestBuffer(5), windows.LatestBuffer.SCHEMA, "lb")
    last = {r.key: (r.pushed, r.held, r.dropped) for r in out.groupBy("key").agg(F.max_by(F.struct("pushed", "held", "dropped"), "pushed").alias("m")).select("key", "m.*").collect()}
    batch = windows.buffer_counts(spark.createDataFrame(EVENTS, SCHEMA), "k", 5)
    assert last == {r.key: (r.pushed, r.held, r.dropped) for r in batch.collect()}


def test_queue(spark):
    kinds = ["preview", "preview", "confirm", "confirm", "pop", "pop", "pop"]
    rows = spark.createDataFrame([("s", i, k) for i, k in enumerate(kinds)] + [("t", 1, "pop")], "k string, at int, kind string")
    got = {r.k: tuple(r)[1:] for r in windows.replay_queue(rows, "k", "at", 1).collect()}
    assert got == {"s": (2, 1, 1, 1, "2|1"), "t": (0, 1, 0, 0, "")}
    assert windows.replay_queue(rows.limit(0), "k", "at").count() == 0


class Runner:
    def load(self): ...
    def warmup(self): ...
    def close(self): ...
    def health(self):
        return {}

    def infer(self, items):
        if "bad" in items:
            raise RuntimeError
        return [[1.0, 0.0] for _ in items]


def test_runner_failures_become_rows(spark):
    rows = spark.createDataFrame([(1, "ok"), (2, "bad")], "item_id long, x string").coalesce(1)
    got = {r.item_id: (r.valid, r.reason) for r in scoring.score(rows, Runner, "x", batch=1).collect()}
    assert got == {1: (True, None), 2: (False, "infer: RuntimeError")}
    assert {r.valid for r in scoring.score(rows, lambda: 1 / 0, "x").collect()} == {False}
