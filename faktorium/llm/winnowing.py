"""Document fingerprints by winnowing.

Every ``GRAM`` code points are hashed to 32 bits with a rolling combination; of every ``SPAN`` neighbouring hashes the
smallest is kept, the rightmost one where it occurs more than once. The kept (position, hash) pairs are the
fingerprint: any passage of at least ``GRAM + SPAN - 1`` code points that two documents share puts a common hash into
both fingerprints, and the positions say where.

``against_next`` compares every document with an edited version of itself and with the next document in descending
order of the ids. Texts travel compressed. The order is cut at quantiles of the id into buckets that are sorted and streamed one by one; the
first document of the bucket behind is added to each bucket, so no order over all rows is ever built in one task.

Edge cases: a null text is an empty one, its fingerprint is empty; a text shorter than ``GRAM`` is one gram, a text with
fewer than ``SPAN`` grams is one window; two empty fingerprints are alike (1.0), an empty and another one are not
(0.0); null ids come last in the descending order, rows of equal id in the order of their first ``TIE_CHARACTERS``
code points and then of their compressed texts; a single document is its own next one; an empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faktorium.llm.texts import mix, only

# The edit leaves two thirds of a text: from 29 code points on these hold GRAM + SPAN - 1, a gram that stays is always kept.
GRAM, SPAN = 12, 8
BUCKETS_PER_PARTITION = 2
TIE_CHARACTERS = 64
ANSWER_CHARACTERS = 1 << 20

Fingerprint = tuple[np.ndarray, np.ndarray]  # positions, hashes


def _gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all runs of ``gram`` codes, put together from runs of 1, 2, 4, ... codes."""
    step = mix(codes.astype(np.uint64) + np.uint64(1))
    done, length, width = None, 0, 1
    while True:
        if gram & width:
            n = len(codes) - length - width + 1
            done = step[:n] if done is None else done[:n] * np.uint64(0x9E3779B97F4A7C15) + step[length : length + n]
            length += width
        if length == gram:
            return mix(done) >> np.uint64(32)
        step = mix(step[:-width] * np.uint64(0xD6E8FEB86659FD93) + step[width:])
        width *= 2


def _sliding_least(keys: np.ndarray, span: int) -> np.ndarray:
    width = 1
    while width * 2 <= span:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    rest = span - width
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def fingerprint(text: str | None, gram: int = GRAM, span: int = SPAN) -> Fingerprint:
    """Positions and hashes that winnowing keeps of one text."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    hashes = _gram_hashes(codes, min(gram, len(codes)))
    last = np.uint64(0xFFFFFFFF)
    # The larger the position, the smaller the key: of equal hashes the rightmost is the least.
    keys = (hashes << np.uint64(32)) | (last - np.arange(len(hashes), dtype=np.uint64))
    least = _sliding_least(keys, min(span, len(keys)))
    kept = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return (last - (kept & last)).astype(np.int64), (kept >> np.uint64(32)).astype(np.uint32)


def as_text(found: Fingerprint) -> str:
    """Base64 of 5 bytes for each kept gram: the distance from the one before (modulo 256) and the hash."""
    positions, hashes = found
    table = np.zeros(len(hashes), [("step", "u1"), ("hash", "<u4")])
    table["step"] = np.diff(positions, prepend=0) % 256
    table["hash"] = hashes
    return base64.b64encode(table.tobytes()).decode()


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Jaccard similarity of the sets of hashes."""
    first, second = set(a[1].tolist()), set(b[1].tolist())
    either = len(first | second)
    return len(first & second) / either if either else 1.0


def edited(text: str, following: str) -> str:
    """The last third replaced by as much of the start of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, positions, hashes`` per row."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([p.tolist() for p, _ in prints], pa.list_(pa.int64())),
                    pa.array([h.tolist() for _, h in prints], pa.list_(pa.int64())),
                ],
                ["doc_id", "positions", "hashes"],
            )

    rows = only(documents, doc_id=doc_id, text=F.col(f"`{text}`").cast("string"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(found, f"doc_id {kind}, positions array<long>, hashes array<long>")


def _bucket(column: Column, cuts: list, low: int = 0) -> Column:
    """Number of the cuts that are not below the value, as a search tree of comparisons."""
    if not cuts:
        return F.lit(low)
    middle = len(cuts) // 2
    return F.when(column > cuts[middle], _bucket(column, cuts[:middle], low)).otherwise(
        _bucket(column, cuts[middle + 1 :], low + middle + 1)
    )


def packed(rows: DataFrame) -> DataFrame:
    """The column ``text`` as ``start``, its first characters, and ``packed``, all of it as a zstandard frame."""
    kept = [c for c in rows.columns if c != "text"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            starts, frames = [t[:TIE_CHARACTERS] for t in texts], [compressor.compress(t.encode()) for t in texts]
            arrays = [*[batch.column(c) for c in kept], pa.array(starts, pa.string()), pa.array(frames, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "start", "packed"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(pack, f"{kinds}, start string, packed binary")


def in_order(spark: SparkSession, documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``bucket, tail, doc_id, start, packed``: sorted buckets in descending order of the id, each with the first row behind it.

    The bucket bounds and the heads of the buckets are as many as the buckets: a few per shuffle partition.
    """
    rows = only(documents, doc_id=doc_id, text=F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    n = max(2, BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    quantiles = F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)
    cuts = sorted(set(rows.agg(quantiles).first()[0] or []), reverse=True)
    # Ids above the first cut are in bucket 0; null ids have a bucket of their own behind all others.
    bucket = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(_bucket(F.col("doc_id"), cuts))
    rows = rows.withColumn("bucket", bucket.cast("int"))
    heads = rows.groupBy("bucket").agg(F.max("doc_id").alias("doc_id")).orderBy("bucket").collect()
    kind = rows.schema["doc_id"].dataType.simpleString()
    before = [(heads[i - 1]["bucket"], h["bucket"], h["doc_id"]) for i, h in enumerate(heads)]
    links = spark.createDataFrame(before, f"before int, head_bucket int, head_id {kind}")
    is_head = (F.col("bucket") == F.col("head_bucket")) & F.col("doc_id").eqNullSafe(F.col("head_id"))
    heads = packed(rows.join(F.broadcast(links), is_head).select("before", "head_id", "text"))
    tails = heads.groupBy("before", "head_id").agg(F.min(F.struct("start", "packed")).alias("first"))
    both = packed(rows.select("bucket", F.lit(False).alias("tail"), "doc_id", "text")).unionByName(
        tails.select(F.col("before").alias("bucket"), F.lit(True).alias("tail"), F.col("head_id").alias("doc_id"), "first.start", "first.packed")
    )
    # The buckets are numbered from 0, so each of them can have a partition of its own.
    return both.repartitionById(len(cuts) + 2, "bucket").sortWithinPartitions(
        "bucket", "tail", F.col("doc_id").desc_nulls_last(), "start", "packed"
    )


def against_next(spark: SparkSession, documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and the likeness to that and to the next document."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, decompressor = None, zstandard.ZstdDecompressor()

        def answer(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
            kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], NAMES)

        for batch in batches:
            out, size, id_type = [], 0, batch.schema.field("doc_id").type
            columns = [batch.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "packed")]
            for bucket, tail, name, frame in zip(*columns):
                value = decompressor.decompress(frame).decode()
                found = fingerprint(value)
                if held is not None and held[0] == bucket:
                    _, own_name, own, own_print = held
                    changed = edited(own, value)
                    changed_print = fingerprint(changed)
                    out.append(
                        (
                            own_name, len(own), hashlib.sha256(changed.encode()).hexdigest(), as_text(own_print),
                            as_text(changed_print), likeness(own_print, changed_print), likeness(own_print, found),
                        )
                    )
                held = None if tail else (bucket, name, value, found)
                # Fingerprints are longer than texts: a batch of compressed ones is answered bit by bit.
                size += len(value)
                if out and size >= ANSWER_CHARACTERS:
                    yield answer(out, id_type)
                    out, size = [], 0
            if out:
                yield answer(out, id_type)

    rows = in_order(spark, documents, doc_id, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        compared,
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
