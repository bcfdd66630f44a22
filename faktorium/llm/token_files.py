"""Token ids in seekable zstandard files.

A file is a row of independent zstandard frames of little-endian unsigned 32-bit ids, each with its own checksum, then
a skippable frame with the documents of the file, then a skippable frame with the seek table: compressed size,
decompressed size and checksum (the low 32 bits of XXH64) of every frame. Any zstandard reader can read the ids; a
seeking reader opens the table from the end and decompresses only the frames of the documents asked for. A frame ends
with a document once it has ``FRAME_IDS`` ids; a longer document has several frames.

Files are written by the tasks of a range-partitioned, sorted table, so that their order is the order of the ids, and
under a name of the task attempt. The manifest, a Parquet table in the shared folder, names the files of the
attempts that succeeded; a file that no manifest names is left over from a lost task.

Edge cases: a null or empty text is one end id; null ids come first, rows of equal id in the order of their texts; an
empty table gives no file and an empty result.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faktorium.llm.texts import only
from faktorium.llm.tokens import END_ID, table
from faktorium.session import work_path

FRAME_IDS = 1 << 16
LEVEL = 3

# Fixed values of the seekable zstandard format.
SKIPPABLE_DOCUMENTS = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return pafs.LocalFileSystem(), path


class TokenFileWriter:
    def __init__(self, sink, frame_ids: int = FRAME_IDS, level: int = LEVEL):
        self.sink, self.frame_bytes = sink, 4 * frame_ids
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.names: list[object] = []
        self.lengths: list[int] = []
        self.pending, self.held = [], 0

    def add(self, doc_id: object, ids: bytes) -> None:
        self.names.append(doc_id)
        self.lengths.append(len(ids) // 4)
        for start in range(0, len(ids), self.frame_bytes):
            part = ids[start : start + self.frame_bytes]
            self.pending.append(part)
            self.held += len(part)
            if self.held >= self.frame_bytes:
                self._flush()

    def _flush(self) -> None:
        if self.held:
            content = b"".join(self.pending)
            frame = self.compressor.compress(content)
            self.frames.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
            self.sink.write(frame)
            self.pending, self.held = [], 0

    def close(self, id_type: pa.DataType) -> None:
        self._flush()
        listing = pa.table({"doc_id": pa.array(self.names, id_type), "n": pa.array(self.lengths, pa.int64())})
        buffer = io.BytesIO()
        with pa.ipc.new_stream(buffer, listing.schema) as stream:
            stream.write_table(listing)
        content = self.compressor.compress(buffer.getvalue())
        self.sink.write(struct.pack("<II", SKIPPABLE_DOCUMENTS, len(content)) + content)
        rows = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(rows) + len(footer)) + rows + footer)


class TokenFileReader:
    """Random access to the documents of one file; keeps one decompressed frame."""

    def __init__(self, source, size: int):
        self.source, self.decompressor = source, zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        rows = np.frombuffer(self._read(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.plain, self.sums = rows.T
        self.at = np.concatenate([[0], np.cumsum(self.packed)])
        self.begin = np.concatenate([[0], np.cumsum(self.plain)])
        kind, length = struct.unpack("<II", self._read(int(self.at[-1]), 8))
        if kind != SKIPPABLE_DOCUMENTS:
            raise ValueError("no list of documents in the file")
        listing = self.decompressor.decompress(self._read(int(self.at[-1]) + 8, length))
        with pa.ipc.open_stream(pa.BufferReader(listing)) as stream:
            documents = stream.read_all()
        self.doc_ids = documents.column("doc_id").combine_chunks()
        self.lengths = documents.column("n").to_numpy()
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.frames_read, self._held = 0, (-1, b"")

    def _read(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(n)

    def frame(self, i: int) -> bytes:
        if self._held[0] != i:
            content = self.decompressor.decompress(self._read(int(self.at[i]), int(self.packed[i])))
            if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.sums[i]:
                raise ValueError(f"frame {i} doesn't match its checksum")
            self.frames_read += 1
            self._held = (i, content)
        return self._held[1]

    def document(self, k: int) -> bytes:
        """Bytes of the ids of the k-th document of the file."""
        start, end = 4 * int(self.starts[k]), 4 * int(self.starts[k + 1])
        parts, i = [], int(np.searchsorted(self.begin, start, side="right")) - 1
        while start < end:
            stop = min(end, int(self.begin[i + 1]))
            parts.append(self.frame(i)[start - int(self.begin[i]) : stop - int(self.begin[i])])
            start, i = stop, i + 1
        return b"".join(parts)


def write_files(
    spark: SparkSession, documents: DataFrame, tokenizer: str, folder: str | None = None, doc_id: str = "doc_id",
    text: str = "text", end_id: int = END_ID, frame_ids: int = FRAME_IDS,
) -> DataFrame:
    """Tokenize and write all documents in ascending order of the ids; returns the manifest.

    ``part, path, n_documents, n_ids, first_id``: ``first_id`` is the number of ids in the files before.
    """
    folder = folder or work_path(spark, "token-files")
    end = np.array([end_id], "<u4").tobytes()

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, pieces = TaskContext.get(), table(tokenizer)
        files, root = filesystem(folder)
        writer = sink = None
        name = f"{root}/part-{context.partitionId():06d}-{context.taskAttemptId()}.ids"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                files.create_dir(root, recursive=True)
                sink = files.open_output_stream(name)
                writer = TokenFileWriter(sink, frame_ids)
                id_type = batch.schema.field("doc_id").type
            for key, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                writer.add(key, pieces.ids(value) + end)
        if writer is not None:
            writer.close(id_type)
            sink.close()
            row = [context.partitionId(), name.removeprefix(root + "/"), len(writer.names), sum(writer.lengths)]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["part", "name", "n_documents", "n_ids"])

    rows = only(documents, doc_id=doc_id, text=F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    path = work_path(spark, "token-manifest")
    ordered.mapInArrow(written, "part long, name string, n_documents long, n_ids long").write.parquet(path)
    # One row per file: as many as there are partitions.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = spark.read.parquet(path)
    return manifest.select(
        "part", F.concat(F.lit(folder + "/"), "name").alias("path"), "n_documents", "n_ids",
        F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first_id"),
    )


def read_files(spark: SparkSession, manifest: DataFrame, id_type: str = "long", wanted: Iterable | None = None) -> DataFrame:
    """``doc_id, start, ids`` of all documents, or of the ``wanted`` ids (a list given by the caller) only."""
    chosen = None if wanted is None else set(wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first_id").to_pylist()):
                files, name = filesystem(path)
                with files.open_input_file(name) as source:
                    reader = TokenFileReader(source, source.size())
                    names, out, size = reader.doc_ids.to_pylist(), [], 0
                    for k, key in enumerate(names):
                        if chosen is None or key in chosen:
                            out.append((key, first + int(reader.starts[k]), reader.document(k)))
                            size += len(out[-1][2])
                        if out and (size > 4 << 20 or k == len(names) - 1):
                            ids, starts, values = zip(*out)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(ids, reader.doc_ids.type), pa.array(starts, pa.int64()), pa.array(values, pa.binary())],
                                ["doc_id", "start", "ids"],
                            )
                            out, size = [], 0

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "first_id").repartition(parts, "path").mapInArrow(read, f"doc_id {id_type}, start long, ids binary")


def checked(found: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of what ``read_files`` returns."""
    return found.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
