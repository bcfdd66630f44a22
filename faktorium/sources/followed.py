"""A streaming source that follows log files which grow and are rotated by renaming.

Spark's file stream reads a path once.  A log is appended to under its path and
later goes on living under another one, so here the offset names files by what
they are instead of where they are: ``identity -> position behind the last
whole line that was read``.  Whatever a file is called when it is read, each of
its lines is read once.

The identity of a file is its number in the file system and a digest of its
first line, so a number that a new file takes over isn't taken for the old file.
Stores without such numbers have the digest alone; two files that begin with the
same line can't be told apart there and are refused.

A batch plans ranges of bytes, ``SPLIT_BYTES`` at most, so a backlog is read by
many tasks; a task finds its file by identity, also after another rotation.  The
folder must be reachable from every executor.

A last line without its line end waits until it has one.  A file that was
deleted before it was read, or that shrank, stops the stream with an error.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SPLIT_BYTES = 64 << 20
BLOCK_BYTES = 1 << 16
BATCH_BYTES = 4 << 20
#: Listings in a row that must miss a file until the offset forgets it.
FORGET_AFTER = 20


@dataclass
class LogFile:
    identity: str
    path: str
    whole: int  # bytes up to the end of the last whole line


@dataclass
class LogRange(InputPartition):
    """The lines that begin at ``start`` or later and before ``stop``."""

    identity: str
    path: str
    begin: int
    start: int
    stop: int


class LogFolder:
    def __init__(self, path: str, pattern: str):
        if "://" in path or path.startswith("file:"):
            uri = path if "://" in path else "file://" + path.removeprefix("file:")
            self.files, self.root = pafs.FileSystem.from_uri(uri)
        else:
            self.files, self.root = pafs.LocalFileSystem(), os.path.abspath(path)
        self.local = isinstance(self.files, pafs.LocalFileSystem)
        self.pattern = pattern

    def paths(self) -> list[str]:
        found = self.files.get_file_info(pafs.FileSelector(self.root, allow_not_found=True))
        names = [f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))]
        return sorted(f.path for f in names if fnmatch(f.base_name, self.pattern))

    def open(self, path: str):
        return open(path, "rb") if self.local else self.files.open_input_file(path)

    def identity(self, source) -> str | None:
        """What the open file is; None as long as it has no whole line."""
        digest = hashlib.md5(usedforsecurity=False)
        source.seek(0)
        while block := source.read(BLOCK_BYTES):
            line, end, _ = block.partition(b"\n")
            digest.update(line)
            if end:
                number = f"{os.fstat(source.fileno()).st_ino:x}-" if self.local else ""
                return number + digest.hexdigest()
        return None

    def whole(self, source) -> int:
        """The position behind the last line end."""
        at = source.seek(0, os.SEEK_END) if self.local else source.size()
        while at > 0:
            start = max(0, at - BLOCK_BYTES)
            source.seek(start)
            last = source.read(at - start).rfind(b"\n")
            if last >= 0:
                return start + last + 1
            at = start
        return 0

    def look(self) -> dict[str, LogFile]:
        found: dict[str, LogFile] = {}
        for path in self.paths():
            try:
                with self.open(path) as source:
                    identity = self.identity(source)
                    if identity is None:
                        continue
                    if identity in found and not self.local:
                        raise ValueError(f"{path} and {found[identity].path} begin with the same line")
                    found[identity] = LogFile(identity, path, self.whole(source))
            except FileNotFoundError:
                continue  # renamed since the listing; the next listing has it
        return found

    def snapshot(self) -> dict[str, LogFile]:
        """The files of the folder, looked at until a rotation in between can't have hidden one."""
        found = self.look()
        for _ in range(FORGET_AFTER):
            again = self.look()
            if {f.path for f in again.values()} == {f.path for f in found.values()} and again.keys() == found.keys():
                return found
            found = again
        return found

    def find(self, identity: str, path: str):
        """The open file of an identity, expected at ``path``."""
        for candidate in [path, *self.paths(), *self.paths()]:
            try:
                source = self.open(candidate)
            except FileNotFoundError:
                continue
            if self.identity(source) == identity:
                return source
            source.close()
        raise FileNotFoundError(f"the log file {identity}, last seen as {path}, was deleted before it was read")


class LogReader(DataSourceStreamReader):
    def __init__(self, path: str, pattern: str, split_bytes: int):
        self.path, self.pattern, self.split_bytes = path, pattern, split_bytes
        self.known: dict[str, int] = {}
        self.seen: dict[str, LogFile] = {}
        self.missed: dict[str, int] = {}

    def folder(self) -> LogFolder:
        return LogFolder(self.path, self.pattern)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.seen = self.folder().snapshot()
        for identity in [i for i in self.known if i not in self.seen]:
            self.missed[identity] = self.missed.get(identity, 0) + 1
            if self.missed[identity] > FORGET_AFTER:
                del self.known[identity], self.missed[identity]
        for identity, file in self.seen.items():
            self.missed.pop(identity, None)
            if file.whole < self.known.get(identity, 0):
                raise ValueError(f"the log file {file.path} lost lines that were read")
            self.known[identity] = file.whole
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[LogRange]:
        ranges = []
        for identity, stop in end.items():
            begin = start.get(identity, 0)
            self.known[identity] = max(self.known.get(identity, 0), stop)
            path = self.seen[identity].path if identity in self.seen else ""
            for at in range(begin, stop, self.split_bytes):
                ranges.append(LogRange(identity, path, begin, at, min(at + self.split_bytes, stop)))
        return ranges

    def read(self, partition: LogRange) -> Iterator[pa.RecordBatch]:
        lines, places, held = [], [], 0

        def batch() -> pa.RecordBatch:
            names = pa.array([partition.identity] * len(lines), pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array(lines, pa.string()), names, pa.array(places, pa.int64())], ["value", "file", "position"]
            )

        with self.folder().find(partition.identity, partition.path) as source:
            at = partition.start
            if at > partition.begin:
                # The line that holds the byte before belongs to the range before.
                at -= 1
                source.seek(at)
                at += len(source.readline())
            source.seek(at)
            while at < partition.stop:
                line = source.readline()
                if not line:
                    raise ValueError(f"the log file {partition.path} lost lines that were to be read")
                lines.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                places.append(at)
                at += len(line)
                held += len(line)
                if held >= BATCH_BYTES:
                    yield batch()
                    lines, places, held = [], [], 0
        if lines:
            yield batch()


class FollowedLogs(DataSource):
    """``spark.readStream.format("followed_logs").option("path", folder).option("pattern", "app.log*")``"""

    @classmethod
    def name(cls) -> str:
        return "followed_logs"

    def schema(self) -> str:
        return "value string, file string, position long"

    def streamReader(self, schema) -> LogReader:
        if "path" not in self.options:
            raise ValueError("followed_logs needs the option path: a folder")
        return LogReader(self.options["path"], self.options.get("pattern", "*"), int(self.options.get("splitBytes", SPLIT_BYTES)))


def follow_lines(spark: SparkSession, folder: str, pattern: str = "*", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``value, file, position``: every line of every log file of a folder once, however the files grow and rotate."""
    spark.dataSource.register(FollowedLogs)
    reader = spark.readStream.format("followed_logs").option("path", folder).option("pattern", pattern)
    return reader.option("splitBytes", str(split_bytes)).load()
