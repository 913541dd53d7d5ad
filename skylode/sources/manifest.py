"""Versioned manifests: the lists of files that make up a table.

A commit creates ``_versions/<n>.json`` and fails if that exists, so of two
writers one wins and the other starts over from the new version. All paths go
through Hadoop's file system API; exclusive creation is atomic on HDFS and local
disks, and on object stores as far as their connector has conditional writes.
"""

from __future__ import annotations

import contextlib
import json
import os
import time
import uuid
from collections.abc import Sequence
from dataclasses import asdict, astuple, dataclass, field, replace

from pyspark.sql import SparkSession


#: Files that one segment lists, and segments that a manifest names before small ones merge.
SEGMENT_FILES, MAX_SEGMENTS = 1024, 64


@dataclass(frozen=True)
class DataFile:
    """One Parquet file, with statistics to skip it by.

    ``version`` is the commit that inserted its rows: a file that an upsert rewrites
    keeps it, so an index over version v covers all files up to v.
    """

    path: str
    rows: int
    id_min: int
    id_max: int
    ts_min: int | None
    ts_max: int | None
    version: int


@dataclass(frozen=True)
class Segment:
    """A list of data files, written once, and what they have in common."""

    path: str
    files: int
    rows: int
    id_min: int
    id_max: int


@dataclass(frozen=True)
class Replaced:
    """Ids whose older rows a commit has replaced, in a folder of Parquet files."""

    path: str
    rows: int
    version: int


@dataclass(frozen=True)
class Manifest:
    """One version. It names segments, not files, so that a commit writes what it changes
    and no list of the whole table."""

    version: int = 0
    commit_nanos: int = 0
    kind: str | None = None
    dim: int | None = None
    has_ingested_at: bool = True
    segments: tuple[Segment, ...] = ()
    replaced: tuple[Replaced, ...] = ()
    #: The last version that merged files of different versions.
    compacted: int = 0
    #: name ("vector", "fts", "scalar:<column>") -> {"parts": [...], ...}
    indexes: dict = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return sum(s.rows for s in self.segments)

    @property
    def fragments(self) -> int:
        return sum(s.files for s in self.segments)

    def after(self, **changes: object) -> Manifest:
        return replace(self, version=self.version + 1, commit_nanos=time.time_ns(), **changes)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Manifest:
        raw = json.loads(text)
        segments = tuple(Segment(**s) for s in raw["segments"])
        return Manifest(**{**raw, "segments": segments, "replaced": tuple(Replaced(**r) for r in raw["replaced"])})


def file_system(spark: SparkSession, path: str) -> tuple:
    """(Hadoop's file system of a path, the path as it names it)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """A folder of this session alone goes with the driver's JVM."""
    fs, where = file_system(spark, path)
    fs.deleteOnExit(where)


class Conflict(Exception):
    """Another writer committed the version first."""


class Files:
    """The few file operations that manifests need, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm
        local = self._fs.getUri().getScheme() == "file"
        self._local = self._path(self.root).toUri().getPath() if local else None

    def at(self, path: str) -> str:
        return f"{self.root}/{path}" if path else self.root

    def names(self, path: str) -> list[str]:
        return [name for name, *_ in self.stamps(path)]

    def stamps(self, path: str) -> list[tuple[str, int, int]]:
        """(name, time of change, size) of a folder's entries; none if there is no folder."""
        if self._local is not None:  # a local disk needs no trip to the JVM
            out = []
            with contextlib.suppress(FileNotFoundError), os.scandir(f"{self._local}/{path}") as entries:
                for e in entries:
                    with contextlib.suppress(FileNotFoundError):  # another writer's temporary file
                        s = e.stat()
                        out.append((e.name, s.st_mtime_ns, s.st_size))
            return out
        where = self._path(self.at(path))
        if not self._fs.exists(where):
            return []
        return [(s.getPath().getName(), s.getModificationTime(), s.getLen()) for s in self._fs.listStatus(where)]

    def stamp(self, path: str) -> tuple[int, int] | None:
        """(time of change, size) of one file; None if there is none."""
        if self._local is not None:
            try:
                s = os.stat(f"{self._local}/{path}")
            except FileNotFoundError:
                return None
            return s.st_mtime_ns, s.st_size
        where = self._path(self.at(path))
        if not self._fs.exists(where):
            return None
        s = self._fs.getFileStatus(where)
        return s.getModificationTime(), s.getLen()

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(self.at(path)))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read_bytes(self, path: str) -> bytes:
        stream = self._fs.open(self._path(self.at(path)))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, path: str, text: str | bytes) -> None:
        """Writes a new file, whole or not at all; raises Conflict if it exists."""
        where = self._path(self.at(path))
        self._fs.mkdirs(where.getParent())
        part = self._path(self.at(f"{path}.{uuid.uuid4().hex}.tmp"))
        stream = self._fs.create(part, False)
        stream.write(bytearray(text.encode() if isinstance(text, str) else text))
        stream.close()
        try:
            if self._local is not None:  # a local rename would replace the file; a link never does
                os.link(part.toUri().getPath(), where.toUri().getPath())
            elif not self._fs.rename(part, where):
                raise Conflict(path)
        except FileExistsError as e:
            raise Conflict(path) from e
        finally:
            self._fs.delete(part, False)

    def delete(self, path: str) -> int:
        """Deletes all below ``path``; the number of files that went."""
        where = self._path(self.at(path))
        if not self._fs.exists(where):
            return 0
        count = self._fs.getContentSummary(where).getFileCount()
        self._fs.delete(where, True)
        return count


class Log:
    """The manifests of one table."""

    def __init__(self, files: Files):
        self.files = files
        self._known: tuple[tuple, Manifest] | None = None
        self._segments: dict[str, tuple[DataFile, ...]] = {}

    def latest(self) -> Manifest | None:
        """The manifest of the highest version. While the one known is as it was and no
        next one exists, the folder is not listed."""
        if self._known is not None:
            (name, *stamp), m = self._known
            if self.files.stamp(f"_versions/{name}") == tuple(stamp) and self.files.stamp(f"_versions/{m.version + 1:012d}.json") is None:
                return m
        stamp = max((s for s in self.files.stamps("_versions") if s[0].endswith(".json")), default=None)
        if stamp is None:
            return None
        if self._known is None or self._known[0] != stamp:
            self._known = stamp, Manifest.from_json(self.files.read(f"_versions/{stamp[0]}"))
        return self._known[1]

    def commit(self, manifest: Manifest) -> None:
        self.files.create(f"_versions/{manifest.version:012d}.json", manifest.to_json())

    def files_of(self, segment: Segment) -> tuple[DataFile, ...]:
        """The files of a segment; segments never change, so each is read once."""
        if segment.path not in self._segments:
            self._segments[segment.path] = tuple(DataFile(*f) for f in json.loads(self.files.read(segment.path)))
        return self._segments[segment.path]

    def segment(self, files: Sequence[DataFile]) -> Segment:
        """Writes a segment; it counts once a manifest names it."""
        path = f"_segments/{uuid.uuid4().hex}.json"
        self.files.create(path, json.dumps([astuple(f) for f in files]))
        self._segments[path] = tuple(files)
        return Segment(path, len(files), sum(f.rows for f in files), min(f.id_min for f in files), max(f.id_max for f in files))

    def changed(self, m: Manifest, added: Sequence[DataFile], gone: set[str] = frozenset()) -> tuple[Segment, ...]:
        """The segments of ``m`` without the files ``gone`` and with those ``added``; only
        segments that hold any of these, and small ones if there are many, are written anew."""
        kept, loose = [], list(added)
        for s in m.segments:
            if gone and any(f.path in gone for f in self.files_of(s)):
                rest = [f for f in self.files_of(s) if f.path not in gone]
                if len(rest) >= SEGMENT_FILES // 2:
                    kept.append(self.segment(rest))
                else:
                    loose += rest
            else:
                kept.append(s)
        if len(kept) >= MAX_SEGMENTS:
            small = [s for s in kept if s.files < SEGMENT_FILES // 2]
            kept = [s for s in kept if s.files >= SEGMENT_FILES // 2]
            loose = [f for s in small for f in self.files_of(s)] + loose
        loose.sort(key=lambda f: f.id_min)
        return (*kept, *(self.segment(loose[i : i + SEGMENT_FILES]) for i in range(0, len(loose), SEGMENT_FILES)))
