"""A sink that writes every row as a file of its own, under the row's own name.

A task writes its files into a folder of the task attempt, next to a list of
their names.  The commit on the driver only notes which attempts count, so a lost
or repeated attempt leaves nothing behind but its folder, and what the driver
holds grows with the tasks and not with the files.  ``publish`` then moves the
files of those attempts to their names, in parallel; it can be repeated.

The names must be different (``number_names``).  Folders that start with an
underscore are not seen by readers.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from faktorium.operators import skew

ATTEMPTS = "_attempts"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return pafs.LocalFileSystem(), os.path.abspath(path)


@dataclass
class Attempt(WriterCommitMessage):
    name: str
    files: int


class NamedFileWriter(DataSourceWriter):
    """``<path>/_attempts/<attempt>/<n>`` holds the n-th row, ``names`` beside it one JSON string per row."""

    def __init__(self, path: str, run: str):
        self.path, self.run = path, run

    def write(self, iterator: Iterator[Row]) -> Attempt:
        files, root = file_system(self.path)
        name, count = uuid.uuid4().hex, 0
        folder = f"{root}/{ATTEMPTS}/{name}"
        first = next(iterator, None)
        if first is None:
            return Attempt(name, 0)
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(f"{folder}/names", compression=None) as names:
            for row in chain([first], iterator):
                if not row[0] or "/" in row[0] or row[0].startswith((".", "_")):
                    raise ValueError(f"{row[0]!r} is no name of a file")
                with files.open_output_stream(f"{folder}/{count}", compression=None) as sink:
                    sink.write((row[1] or "").encode())
                names.write(json.dumps(row[0]).encode() + b"\n")
                count += 1
        return Attempt(name, count)

    def commit(self, messages: list[Attempt | None]) -> None:
        """One small file that appears as a whole: the attempts that count."""
        files, root = file_system(self.path)
        files.create_dir(f"{root}/{ATTEMPTS}", recursive=True)
        temporary = f"{root}/{ATTEMPTS}/{self.run}.writing"
        with files.open_output_stream(temporary, compression=None) as sink:
            for m in messages:
                if m is not None and m.files:
                    sink.write(f"{m.name}\n".encode())
        files.move(temporary, f"{root}/{ATTEMPTS}/{self.run}.committed")

    def abort(self, messages: list[Attempt | None]) -> None:
        files, root = file_system(self.path)
        for m in messages:
            if m is not None and m.files:
                files.delete_dir(f"{root}/{ATTEMPTS}/{m.name}")


class NamedFiles(DataSource):
    """``df.write.format("named_files").option("path", folder).option("run", name)`` for ``file_name, content``."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "file_name string, content string"

    def writer(self, schema, overwrite: bool) -> NamedFileWriter:
        return NamedFileWriter(self.options["path"], self.options["run"])


def publish(spark: SparkSession, path: str, run: str) -> int:
    """Move the files of the attempts that count to their names; returns how many files there are.

    A file that isn't at its first place any more was moved before.
    """
    files, root = file_system(path)
    noted = f"{root}/{ATTEMPTS}/{run}.committed"
    with files.open_input_stream(noted, compression=None) as source:
        attempts = source.read().decode().split()

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, folder = file_system(path)
        for batch in batches:
            count = 0
            for attempt in batch.column("attempt").to_pylist():
                with target.open_input_stream(f"{folder}/{ATTEMPTS}/{attempt}/names", compression=None) as source:
                    names = [json.loads(line) for line in source.read().splitlines()]
                for n, name in enumerate(names):
                    here, there = f"{folder}/{ATTEMPTS}/{attempt}/{n}", f"{folder}/{name}"
                    if target.get_file_info(here).type == pafs.FileType.File:
                        target.move(here, there)
                    elif target.get_file_info(there).type != pafs.FileType.File:
                        raise FileNotFoundError(there)
                count += len(names)
            yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["n"])

    if not attempts:
        files.delete_file(noted)
        return 0
    listed = spark.createDataFrame([(a,) for a in attempts], "attempt string").repartition(len(attempts))
    moved = listed.mapInArrow(move, "n long").agg(F.sum("n")).first()[0]
    for attempt in attempts:
        files.delete_dir(f"{root}/{ATTEMPTS}/{attempt}")
    files.delete_file(noted)
    return moved


def number_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Make the file names different: further rows of a name, by ``order`` (bigint), get ``~2``, ``~3`` before the extension.

    A name that ends so by itself is numbered from ``~1``, so that none meets a
    numbered one.
    """
    numbered = skew.number_rows(df, [name], [F.col(order)], [F.floor(F.col(order) / 1_000_000)], "_n")
    stem, extension = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    plain = (F.col("_n") == 1) & ~stem.rlike(r"~[0-9]+$")
    return numbered.withColumn(name, F.when(plain, F.col(name)).otherwise(F.concat(stem, F.lit("~"), F.col("_n").cast("string"), extension))).drop("_n")


def write_named(df: DataFrame, path: str, file_name: Column | str, content: Column | str, order: str) -> int:
    """Write ``content`` of every row as one UTF-8 file in ``path``; returns the number of files.

    Names that clash are numbered in the order of the bigint column ``order``.
    """
    spark, run = df.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(NamedFiles)
    column = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(F.col(order).alias("_order"), column(file_name).alias("file_name"), column(content).alias("content"))
    named = number_names(rows, "file_name", "_order").select("file_name", "content")
    named.write.format("named_files").option("path", path).option("run", run).mode("append").save()
    return publish(spark, path, run)
