"""Remote JSON services and cameras as Python data sources, with injectable openers and captures.

Readers plan one partition per category or page range, so a large harvest runs on many executors; every
request goes through `fetch_json` with bounded retries that respect Retry-After.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import struct
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

from millrace.sources.storage import arrow_path, cut

PAGE_SCHEMA = "item_id string, payload string, page int"


def _load(spec: str | None, default: Callable) -> Callable:
    """'module:function' named by an option, so that tests need no network."""
    if not spec:
        return default
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def open_url(url: str, timeout: float = 30.0) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "millrace/1.0"}), timeout=timeout) as reply:
        return reply.read()


def fetch_json(url: str, opener: Callable[[str], bytes] = open_url, attempts: int = 4, pause: Callable[[float], None] = time.sleep) -> dict:
    """Parsed reply; 429 and 5xx and network errors are tried again after a growing or requested delay."""
    for attempt in range(attempts):
        try:
            return json.loads(opener(url))
        except urllib.error.HTTPError as e:
            if attempt + 1 == attempts or (e.code != 429 and e.code < 500):
                raise
            wait = e.headers.get("Retry-After") if e.headers else None
            pause(min(60.0, float(wait)) if wait and wait.isdigit() else 2.0**attempt)
        except (urllib.error.URLError, TimeoutError):
            if attempt + 1 == attempts:
                raise
            pause(2.0**attempt)
    raise RuntimeError("unreachable")


def with_query(url: str, **params) -> str:
    return f"{url}{'&' if '?' in url else '?'}{urllib.parse.urlencode(params)}"


def token_pages(url: str, items: str, opener: Callable = open_url, limit: int | None = None) -> Iterator[tuple[int, dict]]:
    """Pages linked by a continuation token."""
    page, seen, extra = 0, 0, {}
    while True:
        reply = fetch_json(with_query(url, **extra) if extra else url, opener)
        for item in _dig(reply, items):
            yield page, item
            seen += 1
            if limit and seen >= limit:
                return
        extra = reply.get("continue") or {}
        if not extra:
            return
        page += 1


def numbered_pages(url: str, items: str, size: int, opener: Callable = open_url, limit: int | None = None) -> Iterator[tuple[int, dict]]:
    """Pages by number, until one is short or empty."""
    page, seen = 1, 0
    while True:
        found = _dig(fetch_json(with_query(url, page=page, per_page=size), opener), items)
        for item in found:
            yield page, item
            seen += 1
            if limit and seen >= limit:
                return
        if len(found) < size:
            return
        page += 1


def offset_pages(url: str, items: str, size: int, opener: Callable = open_url, limit: int | None = None) -> Iterator[tuple[int, dict]]:
    """Pages by offset, until the service says it was the last."""
    offset = seen = 0
    while True:
        reply = fetch_json(with_query(url, offset=offset, limit=size), opener)
        found = _dig(reply, items)
        for item in found:
            yield offset // size, item
            seen += 1
            if limit and seen >= limit:
                return
        if reply.get("endOfRecords", True) or not found:
            return
        offset += size


def _dig(reply: dict, path: str) -> list:
    for part in path.split("."):
        reply = reply.get(part, {}) if isinstance(reply, dict) else {}
    return list(reply.values()) if isinstance(reply, dict) else list(reply or [])


PAGERS = {"token": token_pages, "number": numbered_pages, "offset": offset_pages}


class _One(InputPartition):
    def __init__(self, url: str):
        self.url = url


class JsonPagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_One(u) for u in self.options["urls"].split("\n")]

    def read(self, partition) -> Iterator[tuple]:
        o = self.options
        opener = _load(o.get("opener"), open_url)
        kind, limit = o.get("paging", "number"), int(o["limit"]) if "limit" in o else None
        args = (partition.url, o.get("items", "results")) if kind == "token" else (partition.url, o.get("items", "results"), int(o.get("pagesize", 100)))
        for page, item in PAGERS[kind](*args, opener=opener, limit=limit):
            yield str(item.get(o.get("id", "id"), "")), json.dumps(item, sort_keys=True), page


class JsonPages(DataSource):
    """format("json_pages"): options urls (one per line), paging, items, id, pagesize, limit, opener."""

    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def schema(self) -> str:
        return PAGE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return JsonPagesReader(dict(self.options))


class FrameReader(SimpleDataSourceStreamReader):
    """Polls a capture; ids go on after a reconnect, and a failed read gives no frame and releases the capture.

    A camera gives a frame once. With the option `log`, a folder all can reach, every read is written there before it is
    handed on, so a batch that is asked for again after a restart is read back; without it frames are given at most once.
    """

    def __init__(self, options: dict):
        self.factory = _load(options.get("capture"), None)
        self.limit = int(options.get("perbatch", 1))
        self.log = options.get("log")
        self.capture = None

    def _file(self, start: int):
        fs, base = arrow_path(self.log)
        return fs, base, f"{base}/{start:020d}.frames"

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, at = [], start["frame"]
        if self.log and (kept := self._read(at)):
            return iter(kept), {"frame": at + len(kept)}
        for _ in range(self.limit):
            if self.capture is None:
                self.capture = self.factory()
            frame = self.capture.read()
            if frame is None:
                self.capture.release()
                self.capture = None
                break
            rows.append((at, time.time_ns(), bytes(frame)))
            at += 1
        self.held = {start["frame"]: rows}
        if self.log and rows:
            fs, base, path = self._file(start["frame"])
            fs.create_dir(base, recursive=True)
            with fs.open_output_stream(f"{path}.part", compression=None) as f:
                for frame, at_ns, image in rows:
                    f.write(struct.pack("<qqq", frame, at_ns, len(image)) + image)
            fs.move(f"{path}.part", path)
        return iter(rows), {"frame": at}

    def _read(self, start: int) -> list[tuple]:
        fs, _, path = self._file(start)
        if not fs.get_file_info(path).is_file:
            return []
        with fs.open_input_stream(path, compression=None) as f:
            raw = f.read()
        rows, at = [], 0
        while at < len(raw):
            frame, at_ns, size = struct.unpack_from("<qqq", raw, at)
            rows.append((frame, at_ns, bytes(raw[at + 24 : at + 24 + size])))
            at += 24 + size
        return rows

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """Frames from start up to end: what is still held, or what the log has."""
        at, held = start["frame"], getattr(self, "held", {})
        while at < end["frame"]:
            rows = held.get(at) or (self._read(at) if self.log else [])
            if not rows:
                return
            yield from (r for r in rows if r[0] < end["frame"])
            at = rows[-1][0] + 1


class Frames(DataSource):
    """readStream.format("frames"): options capture ('module:factory'), perbatch."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "frame_id long, captured_at_ns long, image binary"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return FrameReader(dict(self.options))


class _Shift(InputPartition):
    def __init__(self, camera: str, endpoint: str, begin: int, end: int):
        self.camera, self.endpoint, self.begin, self.end = camera, endpoint, begin, end


class CameraReader(DataSourceStreamReader):
    """Many cameras as one stream: an offset for each, which counts the batches read from it, and a partition for each, polled in an executor.

    A batch of a camera is at most `perbatch` frames. Before it is handed on it stands in the `log`, with the next frame id and the number of reads so far; a
    batch that is asked for again, after a lost task or a restart, is read back from there, so ids have no gaps and no frame comes twice. A read that fails gives no
    frame: the capture is released and opened again; after `failures` of them in a row the batch ends. The log keeps what was read until `commit` has passed it by `keep` batches.
    """

    def __init__(self, options: dict):
        self.cameras = dict(line.split("=", 1) for line in options["cameras"].split("\n") if line)
        self.capture, self.log = options["capture"], options["log"]
        self.limit, self.failures, self.keep = int(options.get("perbatch", 1)), int(options.get("failures", 3)), int(options.get("keep", 100))

    def _folder(self, camera: str):
        fs, base = arrow_path(self.log)
        return fs, f"{base}/{camera}"

    def _logged(self, camera: str) -> list[int]:
        from pyarrow import fs as pafs

        fs, folder = self._folder(camera)
        found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        return sorted(int(f.base_name[:-7]) for f in found if f.base_name.endswith(".frames"))

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.cameras, 0)

    def latestOffset(self) -> dict:
        """One batch more of each camera than the log has: a live camera always has news."""
        return {c: max(self._logged(c), default=-1) + 2 for c in self.cameras}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Shift(c, e, start.get(c, 0), end[c]) for c, e in self.cameras.items() if end.get(c, 0) > start.get(c, 0)]

    def read(self, partition: _Shift) -> Iterator[tuple]:
        for batch in range(partition.begin, partition.end):
            for frame, at_ns, image in self._batch(partition.camera, partition.endpoint, batch):
                yield partition.camera, frame, at_ns, image

    def commit(self, end: dict) -> None:
        for camera, batch in end.items():
            fs, folder = self._folder(camera)
            for old in self._logged(camera):
                if old < batch - self.keep:
                    fs.delete_file(f"{folder}/{old:010d}.frames")

    def _stand(self, camera: str, batch: int) -> tuple[int, int, list[tuple]] | None:
        """(next frame id, reads so far, frames) of a logged batch."""
        fs, folder = self._folder(camera)
        path = f"{folder}/{batch:010d}.frames"
        if not fs.get_file_info(path).is_file:
            return None
        with fs.open_input_stream(path, compression=None) as f:
            raw = f.read()
        frame, reads, at, rows = *struct.unpack_from("<qq", raw), 16, []
        while at < len(raw):
            number, at_ns, size = struct.unpack_from("<qqq", raw, at)
            rows.append((number, at_ns, bytes(raw[at + 24 : at + 24 + size])))
            at += 24 + size
        return frame, reads, rows

    def _batch(self, camera: str, endpoint: str, batch: int) -> list[tuple]:
        if kept := self._stand(camera, batch):
            return kept[2]
        before = self._stand(camera, batch - 1) if batch else (0, 0, [])
        if before is None:
            raise RuntimeError(f"the log of {camera} lacks batch {batch - 1}")
        frame, reads, rows, failed = before[0], before[1], [], 0
        open_, capture = _load(self.capture, None), None
        try:
            while len(rows) < self.limit and failed < self.failures:
                if capture is None:
                    capture = open_(endpoint, reads)
                try:
                    image = capture.read()
                except EOFError:
                    break
                reads += 1
                if image is None:
                    failed += 1
                    capture.release()
                    capture = None
                    continue
                failed = 0
                rows.append((frame, time.time_ns(), bytes(image)))
                frame += 1
        finally:
            if capture is not None:
                capture.release()
        fs, folder = self._folder(camera)
        fs.create_dir(folder, recursive=True)
        part = f"{folder}/{uuid.uuid4().hex}.part"
        with fs.open_output_stream(part, compression=None) as f:
            f.write(struct.pack("<qq", frame, reads) + b"".join(struct.pack("<qqq", n, at_ns, len(image)) + image for n, at_ns, image in rows))
        if kept := self._stand(camera, batch):  # another attempt of this task was first
            fs.delete_file(part)
            return kept[2]
        fs.move(part, f"{folder}/{batch:010d}.frames")
        return rows


class Cameras(DataSource):
    """readStream.format("cameras"): options cameras (lines name=endpoint), capture ('module:factory', called with endpoint and the number of reads so far), log, perbatch, failures."""

    @classmethod
    def name(cls) -> str:
        return "cameras"

    def schema(self) -> str:
        return "camera string, frame_id long, captured_at_ns long, image binary"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CameraReader(dict(self.options))


class Recording:
    """A capture that plays what write_recording() wrote for a camera, from the given read on: the file that holds it is found by its number, so opening costs the same everywhere."""

    def __init__(self, endpoint: str, position: int = 0):
        self.fs, self.folder = arrow_path(endpoint)
        self.file, self.sizes, self.at, self.number = None, [], 0, -1
        if position and self._open(0):
            self.release()
            number, self.at = divmod(position, self.chunk)
            self._open(number)
            if self.file is not None:
                self.file.seek(16 + 8 * len(self.sizes) + sum(s for s in self.sizes[: self.at] if s > 0))

    def _open(self, number: int) -> bool:
        """The file of that number, at its first read; False behind the last."""
        self.number, self.sizes = number, []
        path = f"{self.folder}/{number:010d}.rec"
        if not self.fs.get_file_info(path).is_file:
            return False
        self.file = self.fs.open_input_file(path)
        self.chunk, n = struct.unpack("<qq", self.file.read(16))
        self.sizes = list(struct.unpack(f"<{n}q", self.file.read(8 * n)))
        return True

    def read(self) -> bytes | None:
        while self.at >= len(self.sizes):
            if self.number >= 0 and not self.sizes:
                raise EOFError
            self.release()
            self.at = 0
            self._open(self.number + 1)
        size = self.sizes[self.at]
        self.at += 1
        return None if size < 0 else self.file.read(size)

    def release(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


def write_recording(frames: DataFrame, root: str, chunk: int = 1000) -> None:
    """frames (camera, nth from 1 without gaps, image; null: a read that fails) as files of `chunk` reads under root/camera: chunk, reads, their sizes (-1: failed), images."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("nth")
        fs, base = arrow_path(root)
        folder = f"{base}/{pdf['camera'].iloc[0]}"
        fs.create_dir(folder, recursive=True)
        images = [None if x is None else bytes(x) for x in pdf["image"]]
        with fs.open_output_stream(f"{folder}/{int(pdf['chunk'].iloc[0]):010d}.rec", compression=None) as f:
            f.write(struct.pack(f"<{2 + len(images)}q", chunk, len(images), *(-1 if x is None else len(x) for x in images)) + b"".join(x for x in images if x))
        return pd.DataFrame({"n": [len(pdf)]})

    parts = frames.select("camera", "nth", "image", F.floor((F.col("nth") - 1) / chunk).alias("chunk"))
    cut(parts.groupBy("camera", "chunk").applyInPandas(write, "n long"))


def batched_lookup(keys: DataFrame, key: str, size: int, lookup: Callable[[list[str]], dict[str, dict]]) -> DataFrame:
    """key, payload (JSON, null for what the service does not know): metadata in requests of at most `size` keys.

    Every task asks for the keys it holds, so requests run side by side; equal keys are asked for once.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[str] = []

        def ask(part: list[str]) -> pd.DataFrame:
            found = lookup(part)
            return pd.DataFrame([(k, json.dumps(found[k], sort_keys=True) if k in found else None) for k in part], columns=["key", "payload"])

        for pdf in batches:
            waiting += pdf.iloc[:, 0].tolist()
            while len(waiting) >= size:
                part, waiting = waiting[:size], waiting[size:]
                yield ask(part)
        if waiting:
            yield ask(waiting)

    asked = keys.select(F.col(key).cast("string").alias("key")).where("key is not null").distinct()
    return asked.mapInPandas(run, "key string, payload string").withColumnRenamed("key", key)


def open_file(url: str, timeout: float = 30.0) -> bytes:
    """Reads a URL of a folder that stands in for a service: the query, with = for file names, names a JSON file in it."""
    base, _, query = url.partition("?")
    fs, path = arrow_path(f"{base}/{query or 'first'}.json")
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def cached_download(rows: DataFrame, root: str, opener: Callable[[str], bytes] = open_url) -> DataFrame:
    """rows (url, target) fetched to files under root, each once: target, method (fetched or kept), length, sha256.

    A file that stands is not fetched again; a new one appears whole, by a rename.
    """
    from millrace.sources.files import _place

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = arrow_path(root)
        for pdf in batches:
            out = []
            for url, target in zip(pdf["url"], pdf["target"], strict=True):
                path, method = f"{base}/{target}", "kept"
                if not fs.get_file_info(path).is_file:
                    data = opener(url)
                    _place(fs, path, lambda f, d=data: f.write(d))
                    method = "fetched"
                with fs.open_input_stream(path, compression=None) as f:
                    data = f.read()
                out.append((target, method, len(data), hashlib.sha256(data).hexdigest()))
            yield pd.DataFrame(out, columns=["target", "method", "length", "sha256"])

    return cut(rows.select("url", "target").mapInPandas(run, "target string, method string, length long, sha256 string"))
