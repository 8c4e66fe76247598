"""A streaming source of records that are appended to files, and of files that are rewritten.

Spark's file source takes a file for finished once it is listed.  Here each file has a place up to which it was read, and goes on from there:
a batch takes whole lines that were added since, at most ``slicebytes`` of a file and ``maxfiles`` files, those that waited longest first.
What has no line feed yet waits.  A file that is another one now (its identity), is shorter than the place, or whose bytes before the place no longer hash to the
``anchor`` (the first and last ``ANCHOR`` bytes before it) begins a new generation from its first byte.  Anchors can't prove that the middle is unchanged.

The stream's offset is a number.  Each number stands for a plan in the ``state`` folder, written before any text of it is read: the slices of that batch
and where their files stand after it.  A batch that is run again after a failure reads the same slices; a plan that was written but never run is
run with the next one.  So the offset log does not grow with the files; every ``WHOLE`` plans one lists all files, and older plans go.  The driver
keeps one small entry for each file, as Spark's own file source does, and reads the tail of each planned file back to its last line feed.

Rows have a reason: `record` (a line, in value), `malformed` (not UTF-8), `oversized` (a stretch of a line of over ``recordbytes``; its rest is skipped, however
long), `pending_tail` (bytes that wait), `changed` (a generation begins), `lost` (the file was rewritten between plan and reading).  Empty files give
no row; a folder without files gives empty batches.  One state folder serves one stream.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

ANCHOR, RECORD_BYTES, SLICE_BYTES, MAX_FILES, WHOLE = 4096, 1 << 20, 8 << 20, 256, 16
#: Bytes of slices that one task reads.
TASK_BYTES = 32 << 20
_STEP = 1 << 16
SCHEMA = "source string, path string, generation int, start long, stop long, record_start long, reason string, scope string, sha256 string, value string"
_FIELDS = pa.schema([("source", pa.string()), ("path", pa.string()), ("generation", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("record_start", pa.int64()),
                     ("reason", pa.string()), ("scope", pa.string()), ("sha256", pa.string()), ("value", pa.string())])


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def source_key(path: str) -> str:
    return _hash(path.encode())


def anchor(file: pa.NativeFile, place: int) -> str:
    """What the bytes before a place hash to, of which only both ends are read."""
    n = min(place, ANCHOR)
    return _hash(file.read_at(n, 0) + file.read_at(n, place - n))


def _last_line_feed(file: pa.NativeFile, low: int, high: int) -> int:
    """The place after the last line feed between two places, or low."""
    while high > low:
        at = max(low, high - _STEP)
        found = file.read_at(high - at, at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        high = at
    return low


class Plans:
    """The numbered plans of a state folder."""

    def __init__(self, folder: str):
        self.fs, self.folder = _open(folder.rstrip("/"))
        self.fs.create_dir(self.folder, recursive=True)
        self.number, self.files = 0, {}
        found = self.numbers()
        whole = [n for n in found if n % WHOLE == 0]
        for n in found[found.index(whole[-1]) if whole else 0 :]:
            self.files |= self.read(n)["files"]
            self.number = n

    def numbers(self) -> list[int]:
        names = (i.base_name for i in self.fs.get_file_info(fs.FileSelector(self.folder)))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def read(self, number: int) -> dict:
        with self.fs.open_input_stream(f"{self.folder}/{number}.json") as f:
            return json.loads(f.read())

    def write(self, slices: list[dict], files: dict[str, dict]) -> None:
        self.files |= files
        n = self.number + 1
        aside = f"{self.folder}/{n}.part"
        with self.fs.open_output_stream(aside) as f:
            f.write(json.dumps({"slices": slices, "files": self.files if n % WHOLE == 0 else files}).encode())
        self.fs.move(aside, f"{self.folder}/{n}.json")
        self.number = n

    def forget(self, done: int) -> None:
        """Plans go that no batch can ask for, and from which no later one is told."""
        whole = [n for n in self.numbers() if n % WHOLE == 0 and n <= done]
        for n in self.numbers():
            if whole and n < whole[-1]:
                self.fs.delete_file(f"{self.folder}/{n}.json")


class AppendedReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        low = {k.lower(): v for k, v in options.items()}
        self.path, self.state, self.ending = low["path"], low["state"], low.get("ending", ".jsonl")
        self.most, self.record, self.slice = int(low.get("maxfiles", MAX_FILES)), int(low.get("recordbytes", RECORD_BYTES)), int(low.get("slicebytes", SLICE_BYTES))
        self._plans = None

    def plans(self) -> Plans:
        if self._plans is None:
            self._plans = Plans(self.state)
        return self._plans

    def initialOffset(self) -> dict:
        return {"plan": 0}

    def _identity(self, filesystem: fs.FileSystem, path: str) -> str:
        if isinstance(filesystem, fs.LocalFileSystem):
            import os

            s = os.stat(path)
            return f"{s.st_dev}:{s.st_ino}"
        return ""

    def _planned(self, filesystem: fs.FileSystem, info: fs.FileInfo, held: dict | None) -> tuple[dict | None, dict | None]:
        """The slice of one file that comes next, and how the file stands after it."""
        seen = [info.size, info.mtime_ns, self._identity(filesystem, info.path)]
        if held and held["seen"] == seen and not held["more"]:
            return None, None
        with filesystem.open_input_file(info.path) as file:
            size = file.size()
            generation, place, skipping, previous = (held["generation"], held["place"], held["skipping"], None) if held else (0, 0, -1, None)
            if held and (held["seen"][2] != seen[2] or size < place or anchor(file, place) != held["anchor"]):
                generation, place, skipping, previous = generation + 1, 0, -1, generation
            end = min(size, place + self.slice)
            stop = _last_line_feed(file, place, end)
            if stop > place:
                after = -1
            elif end - place > self.record or (skipping >= 0 and end > place):  # one line that is too long, without an end in sight
                stop, after = end, skipping if skipping >= 0 else place
            else:
                after = skipping
            tail = size if stop < size <= place + self.slice and after < 0 else stop
            waits = tail - stop > self.record  # a tail that is too long already is skipped next
            entry = {"generation": generation, "place": stop, "anchor": anchor(file, stop), "skipping": after, "seen": seen, "size": size,
                     "more": stop < size and (size > place + self.slice or waits or after >= 0) and size > stop, "turn": self.plans().number + 1}
            part = {"path": info.path, "generation": generation, "previous": previous, "start": place, "stop": stop, "tail": tail, "anchor": entry["anchor"], "skipping": skipping, "closed": after < 0}
            fresh = stop > place or previous is not None or (tail > stop and (not held or held["size"] != size or held["seen"] != seen))
            return (part if fresh else None), entry

    def latestOffset(self) -> dict:
        filesystem, folder = _open(self.path)
        plans = self.plans()
        infos = [i for i in filesystem.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True)) if i.type == fs.FileType.File and i.path.endswith(self.ending)]
        turn = {i.path: plans.files.get(i.path, {}).get("turn", 0) for i in infos}
        slices, files = [], {}
        for info in sorted(infos, key=lambda i: (turn[i.path], i.path)):
            if len(files) >= self.most:
                break
            try:
                part, entry = self._planned(filesystem, info, plans.files.get(info.path))
            except FileNotFoundError:
                continue  # it went since it was listed
            if entry:
                files[info.path] = entry
            if part:
                slices.append(part)
        if files:
            plans.write(slices, files)
        return {"plan": plans.number}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.plans().forget(start["plan"])  # whatever was done up to start is committed
        slices = [s for n in range(start["plan"] + 1, end["plan"] + 1) for s in self.plans().read(n)["slices"]]
        out, held, size = [], [], 0
        for s in slices:
            held.append(s)
            size += s["tail"] - s["start"]
            if size >= TASK_BYTES:
                out.append(InputPartition(held))
                held, size = [], 0
        return out + ([InputPartition(held)] if held else [])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        filesystem, _ = _open(self.path)
        for part in partition.value:
            rows = list(_rows(filesystem, part, self.record))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)


def _rows(filesystem: fs.FileSystem, part: dict, most: int) -> Iterator[dict]:
    """The rows of one slice."""
    held = {"source": source_key(part["path"]), "path": part["path"], "generation": part["generation"]}

    def row(reason: str, start: int, stop: int, data: bytes | None = None, begin: int | None = None, scope: str = "unknown", value: str | None = None) -> dict:
        return {**held, "start": start, "stop": stop, "record_start": start if begin is None else begin, "reason": reason, "scope": scope,
                "sha256": None if data is None else _hash(data), "value": value}

    if part["previous"] is not None:
        yield row("changed", 0, 0)
    try:
        with filesystem.open_input_file(part["path"]) as file:
            data = file.read_at(part["tail"] - part["start"], part["start"])
            same = len(data) >= part["stop"] - part["start"] and anchor(file, part["stop"]) == part["anchor"]
    except FileNotFoundError:
        same = False
    if not same:
        yield row("lost", part["start"], part["stop"])
        return
    at, skipping, body = part["start"], part["skipping"], part["stop"] - part["start"]
    offset = 0
    while offset < body:
        found = data.find(b"\n", offset, body)
        end = body if found < 0 else found + 1
        line = data[offset:end]
        start, stop = at + offset, at + end
        if skipping >= 0 or len(line) > most:
            yield row("oversized", start, stop, line, skipping if skipping >= 0 else start, "segment")
            skipping = -1
        else:
            try:
                yield row("record", start, stop, line, scope="record", value=line.decode())
            except UnicodeDecodeError:
                yield row("malformed", start, stop, line, scope="record")
        offset = end
    if len(data) > body:
        yield row("pending_tail", part["stop"], part["start"] + len(data), data[body:], scope="segment")


class Appended(DataSource):
    """format("appended"): path, state, and by choice ending, maxfiles, slicebytes, recordbytes."""

    @classmethod
    def name(cls) -> str:
        return "appended"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> AppendedReader:
        return AppendedReader(dict(self.options))


def appended(spark: SparkSession, folder: str, state: str, **options: object) -> DataFrame:
    """The rows of a folder's files as a stream; state is a folder that outlives it, in a place that the driver reaches."""
    spark.dataSource.register(Appended)
    reader = spark.readStream.format("appended").option("path", folder).option("state", state)
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()


def sources(spark: SparkSession, state: str) -> DataFrame:
    """(source, path, generation, observed_size, processed_bytes, pending_bytes, state) of every file that was seen: pending or caught_up."""
    plans = Plans(state)
    rows = [(source_key(p), p, f["generation"], f["size"], f["place"], f["size"] - f["place"]) for p, f in plans.files.items()]
    out = spark.createDataFrame(rows, "source string, path string, generation int, observed_size long, processed_bytes long, pending_bytes long")
    return out.withColumn("state", F.when(F.col("pending_bytes") > 0, "pending").otherwise("caught_up"))
