"""A change feed of a note folder: edits and deletions as rows of a stream.

A file source reports neither. This one lists the folder at every trigger and compares the
listing with the last one; a listing is a numbered manifest in a state folder that driver
and executors share, and its number is the stream's offset. Rows of a batch are the
difference of two manifests, so a batch that is repeated, or read again after a restart,
has the same rows; nothing is reported twice and nothing is left out.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "relative_path string, change string, content string, content_sha256 string, modified_at timestamp, noticed_at timestamp, snapshot long"
_TYPES = pa.schema([("relative_path", pa.string()), ("change", pa.string()), ("content", pa.string()), ("content_sha256", pa.string()), ("modified_at", pa.timestamp("us", "UTC")), ("noticed_at", pa.timestamp("us", "UTC")), ("snapshot", pa.int64())])
#: A file by its path: (bytes, microseconds of its last change).
Listing = dict[str, tuple[int, int]]


class FileRange(InputPartition):
    """Some files of the difference that leads to a snapshot, each with what happened to it, and when that was noticed (microseconds)."""

    def __init__(self, snapshot: int, noticed: int, files: list[tuple[str, str]]):
        self.snapshot, self.noticed, self.files = snapshot, noticed, files


def place(where: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or a local path."""
    return fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where.removeprefix("file:"))


def listing(folder: str) -> Listing:
    """The Markdown files below a folder; an absent folder has none."""
    system, root = place(folder)
    root = root.rstrip("/")
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return {f.path.removeprefix(f"{root}/"): (f.size, (f.mtime_ns or 0) // 1000) for f in found if f.is_file and f.path.endswith(".md")}


def difference(before: Listing, now: Listing) -> list[tuple[str, str]]:
    """(path, change) in order of path: added, changed or deleted. A file is taken as changed if its size or time is another."""
    kinds = {p: "added" if p not in before else "changed" for p, v in now.items() if before.get(p) != v}
    return sorted((kinds | {p: "deleted" for p in before if p not in now}).items())


def ranges(snapshot: int, noticed: int, files: list[tuple[str, str]], now: Listing, most_files: int, most_bytes: int) -> list[FileRange]:
    """The files in order, dealt out so that no range holds too many files or, unless it is one file, too many bytes."""
    out, part, size = [], [], 0
    for path, change in files:
        own = now[path][0] if path in now else 0
        if part and (len(part) == most_files or size + own > most_bytes):
            out.append(FileRange(snapshot, noticed, part))
            part, size = [], 0
        part.append((path, change))
        size += own
    return [*out, FileRange(snapshot, noticed, part)] if part else out


def rows(folder: str, part: FileRange) -> Iterator[pa.RecordBatch]:
    """The files of a range as they are now; one that is gone meanwhile has no content, and its deletion is a row of a later batch."""
    system, root = place(folder)
    for path, change in part.files:
        content = digest = at = None
        if change != "deleted":
            try:
                info = system.get_file_info(f"{root.rstrip('/')}/{path}")
                with system.open_input_stream(info.path) as f:
                    raw = f.read()
                content, digest, at = raw.decode("utf-8", "replace"), hashlib.sha256(raw).hexdigest(), (info.mtime_ns or 0) // 1000
            except FileNotFoundError:
                pass
        columns = [[path], [change], [content], [digest], [at], [part.noticed], [part.snapshot]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES.types, strict=True)], schema=_TYPES)


class Manifests:
    """Numbered listings in the state folder; 0 is the empty one. Each is written under another name first, so that it is there whole or not at all."""

    def __init__(self, state: str):
        self.system, self.root = place(state)
        self.system.create_dir(self.root, recursive=True)

    def _path(self, number: int) -> str:
        return f"{self.root.rstrip('/')}/manifest-{number:012d}.json"

    def numbers(self) -> list[int]:
        names = (f.base_name for f in self.system.get_file_info(fs.FileSelector(self.root)))
        return sorted(int(n[9:21]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def read(self, number: int) -> tuple[Listing, int]:
        """The listing, and when it was taken."""
        if number == 0:
            return {}, 0
        with self.system.open_input_stream(self._path(number)) as f:
            first, *lines = f.read().decode().splitlines()
        return {p: (size, at) for p, size, at in map(json.loads, lines)}, json.loads(first)["noticed"]

    def write(self, number: int, now: Listing, noticed: int) -> None:
        lines = [json.dumps({"noticed": noticed}), *(json.dumps([p, *v]) for p, v in sorted(now.items()))]
        with self.system.open_output_stream(f"{self._path(number)}.part") as f:
            f.write("\n".join(lines).encode())
        self.system.move(f"{self._path(number)}.part", self._path(number))

    def forget(self, before: int) -> None:
        for n in self.numbers():
            if n < before:
                self.system.delete_file(self._path(n))


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.manifests = options["folder"], Manifests(options["state"])
        self.most_files, self.most_bytes = int(options.get("rangeFiles", 1000)), int(options.get("rangeBytes", 64 << 20))

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        """The last manifest's number, or the next one's if the folder differs from it. A manifest that no batch has used yet is used, so a stop between listing and planning loses nothing."""
        last = max(self.manifests.numbers(), default=0)
        now = listing(self.folder)
        before, noticed = self.manifests.read(last)
        if now != before:
            last += 1
            self.manifests.write(last, now, max(noticed + 1, time.time_ns() // 1000))  # later than the last one, whatever the clock says
        return {"snapshot": last}

    def partitions(self, start: dict, end: dict) -> list[FileRange]:
        if start == end:
            return []
        now, noticed = self.manifests.read(end["snapshot"])
        before, _ = self.manifests.read(start["snapshot"])
        return ranges(end["snapshot"], noticed, difference(before, now), now, self.most_files, self.most_bytes)

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        return rows(self.folder, partition)

    def commit(self, end: dict) -> None:
        self.manifests.forget(end["snapshot"])


class _Batch(DataSourceReader):
    """Every note of the folder as an added one."""

    def __init__(self, options: dict):
        self.folder = options["folder"]
        self.most_files, self.most_bytes = int(options.get("rangeFiles", 1000)), int(options.get("rangeBytes", 64 << 20))

    def partitions(self) -> list[FileRange]:
        now = listing(self.folder)
        return ranges(0, time.time_ns() // 1000, difference({}, now), now, self.most_files, self.most_bytes)

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        return rows(self.folder, partition)


class NoteChanges(DataSource):
    """``note_changes``: options ``folder``, ``state`` (a shared folder, one for each query), ``rangeFiles``, ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "note_changes"

    def schema(self) -> str:
        return SCHEMA

    def _options(self, *needed: str) -> dict:
        got = {k: self.options.get(k) for k in ("folder", "state", "rangeFiles", "rangeBytes")}
        for k in needed:
            if not got[k]:
                raise ValueError(f"note_changes needs the option {k}")
        return {k: v for k, v in got.items() if v}

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self._options("folder", "state"))

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self._options("folder"))


def read_changes(spark: SparkSession, folder: str, state: str, **options: str) -> DataFrame:
    """The change feed as a streaming DataFrame: ``relative_path, change, content, content_sha256, modified_at, noticed_at, snapshot``; content is null for deleted notes.
    ``noticed_at`` is the time of the listing that told of the change: the same when a batch
    is repeated, and later in every later batch, so it serves as event time.

    The listing is held by the driver, as that of any file source is: some 100 bytes a
    note. Contents are read by the tasks, a range of files each.
    """
    spark.dataSource.register(NoteChanges)
    return spark.readStream.format("note_changes").options(folder=folder, state=state, **options).load()
