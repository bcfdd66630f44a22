"""Removal of repeated strings: every byte that a string of ``LENGTH`` bytes covers which also starts elsewhere.

The ranks of prefix doubling, on the positions that can matter. Inside a task a string of 2n bytes is named by the pair
of names at offset n, for n = 1, 2, 4, ...; Spark groups the names of the whole corpus at growing lengths, and a
position drops out as soon as its name is unique:

1. Every start has an anchor: the position with the least 16-byte name among the next ``WINDOW`` ones. Equal strings have
   their anchors at equal places, so only anchors (one in about 60 bytes) are compared. Neighbouring starts with one
   anchor form a block; the first rank is the name of the ``INNER`` bytes behind the anchor, which all strings of the
   block contain. If no other block has it, no string of the block occurs twice.
2. The second rank is the name of the whole block, ``LENGTH`` bytes and more. All strings of a block that occurs twice
   occur twice: the interval is known. A block of its own is undecided where other blocks share its first rank.
3. The starts of undecided blocks get the third rank, past the threshold: the pair of the 128-byte names at offsets 0
   and ``LENGTH - 128``. Starts whose pair occurs twice are repeats. They may match a start in a known block of the
   same first rank, so one block of each such second rank lends its starts to the count.

Names of the first and second rank together, and pairs, have 128 bits. Counts are combined map-side; the joins that bring
ranks back to their positions are plain inner joins, which adaptive execution splits where one name is very frequent.
What is gathered per document is bounded by its own text. Texts travel once, compressed; only documents whose starts
get the third rank are written for it.

Edge cases: a null text is an empty one; matches never cross documents; a row that repeats id and text matches its
twin; a null id stays null; texts longer than ``SEGMENT`` are named in segments; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faktorium.llm.texts import blocks, mix, only, span_hashes, utf8
from faktorium.session import shuffles_freed, work_path

LENGTH = 200
GRAM = 16
WINDOW = 128
INNER = LENGTH - WINDOW + 1
SEGMENT = 1 << 20
#: Bytes of text that are named at once: some 130 bytes of arrays for each, and an idle worker keeps about as much.
BATCH = 1 << 18

U = np.uint64
LOW = U(0xFFFFFFFF)

# Roles of a block: all of its strings occur twice; the same, and its starts count for others; not known yet.
KNOWN, LENDER, UNDECIDED = 0, 1, 2


def names(data: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Names of all strings of the given lengths (powers of two), each from the pair of names half as long."""
    current, length, found = mix(data.astype(U) + U(1)), 1, {}
    while length < max(lengths):
        current = mix(current[:-length] * U(0xD6E8FEB86659FD93) + current[length:])
        length *= 2
        if length in lengths:
            found[length] = current
    return found


def _least_in_window(keys: np.ndarray, window: int) -> np.ndarray:
    width = 1
    while width * 2 <= window:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    rest = window - width
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def anchored_blocks(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, first and last start (positions in ``data``), first and second rank of every block."""
    if len(data) < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2
    named = names(data, (GRAM, 64))
    grams = named[GRAM]
    keys = (grams & ~LOW) | np.arange(len(grams), dtype=U)
    anchors = (_least_in_window(keys, WINDOW) & LOW).astype(np.int64)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts = np.arange(len(data) - LENGTH + 1)
    starts = starts[owner[starts] == owner[starts + LENGTH - 1]]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2
    anchor = anchors[starts]
    begins = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first, last = starts[begins], starts[np.concatenate([begins[1:], [True]])]
    anchor = anchor[begins]
    inner = mix(named[64][anchor] * U(3) + named[64][anchor + INNER - 64] * U(7))
    whole = span_hashes(data, first, last + LENGTH) ^ mix((anchor - first).astype(U))
    return owner[first], first, last, inner, whole


def _segments(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The batch, or overlapping parts of a single long text with the position of their first byte."""
    if len(data) <= 2 * SEGMENT or len(bounds) > 2:
        yield data, bounds, 0
        return
    for at in range(0, max(1, len(data) - LENGTH + 1), SEGMENT):
        part = data[at : at + SEGMENT + LENGTH - 1]
        yield part, np.array([0, len(part)]), at


def _emit_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: ranks, row key, and first start and length packed into ``place``."""
    for batch in blocks(batches, "text", min(BATCH, SEGMENT)):
        data, bounds = utf8(batch.column("text"))
        uid, check = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "check"))
        for part, limits, at in _segments(data, bounds):
            owner, first, last, inner, whole = anchored_blocks(part, limits)
            place = ((first - limits[owner] + at) * WINDOW + (last - first)).astype(np.int64)
            columns = [inner.view(np.int64), whole.view(np.int64), uid[owner], check[owner], place]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["inner", "whole", "uid", "check", "place"])


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The numbers of every row, without an object for each; none for a null."""
    bounds, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return (values[a:b] if there.as_py() else values[:0] for a, b, there in zip(bounds, bounds[1:], column.is_valid()))


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed texts with the digest of the untouched text."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed, sizes, digests = [], [], []
        for text in batch.column("text"):
            raw = (text.as_py() or "").encode()
            packed.append(press.compress(raw))
            sizes.append(len(raw))
            digests.append(hashlib.sha256(raw).hexdigest())
        arrays = [
            *[batch.column(c) for c in ("doc_id", "uid", "check")], pa.array(packed, pa.binary()), pa.array(sizes, pa.int64()),
            pa.array(digests, pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "uid", "check", "packed", "n_bytes", "kept_sha256"])


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the intervals."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.concatenate([new[1:], [True]])]


def cut(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """What is left without the runs."""
    edges = [0, *np.stack([starts, ends], axis=1).ravel().tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _settle_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the known intervals; a document with undecided starts stays open, and one with a part in the third rank
    keeps its text and its lists."""
    plain = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = zip(batch.column("packed"), batch.column("kept_sha256").to_pylist(), _lists(batch.column("places")), _lists(batch.column("roles")))
        out = {name: [] for name in ("n_removed", "n_spans", "kept_sha256", "is_open", "packed", "known", "undecided", "lent")}
        for packed, digest, place, role in rows:
            first, n = place // WINDOW, place % WINDOW
            known, own, lent = role != UNDECIDED, role == UNDECIDED, role == LENDER
            starts, ends = union(first[known], (first + n + LENGTH)[known])
            is_open = bool(own.any())
            if len(starts) and not is_open:
                digest = hashlib.sha256(cut(plain.decompress(packed.as_py()), starts, ends)).hexdigest()
            out["n_removed"].append(int((ends - starts).sum()))
            out["n_spans"].append(len(starts))
            out["kept_sha256"].append(digest)
            out["is_open"].append(is_open)
            out["packed"].append(packed.as_py() if is_open or lent.any() else None)
            out["known"].append(np.stack([starts, ends], axis=1).ravel() if is_open else None)
            for name, chosen in (("undecided", own), ("lent", lent)):
                out[name].append(np.stack([first[chosen], n[chosen]], axis=1).ravel() if chosen.any() else None)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary(), *[pa.list_(pa.int64())] * 3]
        kept = ["doc_id", "uid", "check", "n_bytes"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in kept], *[pa.array(v, k) for v, k in zip(out.values(), kinds)]], [*kept, *out]
        )


def _starts_of(ranges: np.ndarray) -> np.ndarray:
    pairs = ranges.reshape(-1, 2)
    sizes = pairs[:, 1] + 1
    offsets = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.unique(np.repeat(pairs[:, 0], sizes) + offsets)


def _rank_pairs(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    name = names(data, (128,))[128]
    return name[starts], name[starts + LENGTH - 128]


def _emit_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Third ranks of the undecided and the lent starts; lent ones are only counted (``start`` null).

    A pair that occurs twice within the batch is settled at once: one row counts it for the others (``start`` null) and
    its undecided starts are given as settled, each under a pair of its own (``settled``). The rest are one row per start.
    """
    plain = zstandard.ZstdDecompressor()

    def rows_of(held: list[tuple]) -> pa.RecordBatch:
        uid, check, start, one, two, own = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((two, one))
        new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
        size = np.diff(np.append(np.flatnonzero(new), len(order)))
        single = np.repeat(size == 1, size)
        alone, several = order[single & own[order]], order[~single & own[order]]
        leads = np.concatenate([order[np.flatnonzero(new)[size > 1]], order[single & ~own[order]]])
        twice = int((size > 1).sum())
        none = [None] * len(leads)
        columns = [
            pa.array(np.concatenate([one[alone].view(np.int64), one[leads].view(np.int64), uid[several]])),
            pa.array(np.concatenate([two[alone].view(np.int64), two[leads].view(np.int64), start[several]])),
            pa.array(np.arange(len(alone) + len(leads) + len(several)) >= len(alone) + len(leads)),
            pa.array(np.concatenate([np.ones(len(alone)), np.full(twice, 2), np.ones(len(leads) - twice), np.full(len(several), 2)]).astype(np.int32)),
            pa.concat_arrays([pa.array(uid[alone]), pa.array(none, pa.int64()), pa.array(uid[several])]),
            pa.concat_arrays([pa.array(check[alone]), pa.array(none, pa.int32()), pa.array(check[several])]),
            pa.concat_arrays([pa.array(start[alone]), pa.array(none, pa.int64()), pa.array(start[several])]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["one", "two", "settled", "n", "uid", "check", "start"])

    for batch in batches:
        held, size = [], 0
        columns = [*[batch.column(c) for c in ("packed", "uid", "check")], *[_lists(batch.column(c)) for c in ("undecided", "lent")]]
        for packed, uid, check, undecided, lent in zip(*columns):
            data, uid, check = np.frombuffer(plain.decompress(packed.as_py()), np.uint8), uid.as_py(), check.as_py()
            needed, others = _starts_of(undecided), _starts_of(lent)
            starts, own = np.concatenate([needed, others]), np.arange(len(needed) + len(others)) < len(needed)
            for at in range(0, len(data) - LENGTH + 1, SEGMENT):
                chosen = (starts >= at) & (starts < at + SEGMENT)
                inside = starts[chosen]
                if len(inside):
                    one, two = _rank_pairs(data[at : at + SEGMENT + LENGTH - 1], inside - at)
                    held.append((np.full(len(inside), uid), np.full(len(inside), check, np.int32), inside, one, two, own[chosen]))
                    size += len(inside)
            if size > 1 << 18:
                yield rows_of(held)
                held, size = [], 0
        if held:
            yield rows_of(held)


def _settle_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the known intervals and the strings at the repeated starts of the open documents."""
    plain = zstandard.ZstdDecompressor()
    for batch in batches:
        removed, spans, digests = [], [], []
        for packed, known, starts in zip(batch.column("packed"), *[_lists(batch.column(c)) for c in ("known", "found")]):
            raw, pairs = plain.decompress(packed.as_py()), known.reshape(-1, 2)
            begin, end = union(np.concatenate([pairs[:, 0], starts]), np.concatenate([pairs[:, 1], starts + LENGTH]))
            removed.append(int((end - begin).sum()))
            spans.append(len(begin))
            digests.append(hashlib.sha256(cut(raw, begin, end)).hexdigest())
        arrays = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, RESULT)


RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def remove_repeats(spark: SparkSession, documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row; see the module."""
    rows = only(documents, doc_id=doc_id, text=F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    rows = rows.select("doc_id", "text", F.xxhash64("text", "doc_id").alias("uid"), F.hash("doc_id", "text").alias("check"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    # First and second rank.
    found = rows.select("text", "uid", "check").mapInArrow(
        _emit_blocks, "inner long, whole long, uid long, check int, place long"
    )
    ranks = found.groupBy("inner").agg(
        F.count(F.lit(1)).alias("n"), (F.min("whole") == F.max("whole")).alias("pure")
    ).where("n > 1").select("inner", "pure")
    shared_path = work_path(spark, "shared-blocks")
    with shuffles_freed(spark):
        found.join(ranks, "inner").write.parquet(shared_path)
    shared = spark.read.parquet(shared_path)
    block = F.struct("uid", "check", "place")
    strings = shared.groupBy("inner", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(block).alias("lender"))
    role = (
        F.when(F.col("pure"), KNOWN).when(F.col("n") == 1, UNDECIDED).when(block == F.col("lender"), LENDER).otherwise(KNOWN)
    )
    decided = shared.join(strings, ["inner", "whole"]).select("uid", "check", "place", role.alias("role"))
    # All blocks of one document, each once however often the row is repeated: bounded by its text.
    listed = decided.groupBy("uid", "check").agg(F.collect_set(F.struct("place", "role")).alias("blocks")).select(
        "uid", "check", F.col("blocks.place").alias("places"), F.col("blocks.role").alias("roles")
    )
    small = rows.mapInArrow(
        _shrink, f"doc_id {kind}, uid long, check int, packed binary, n_bytes long, kept_sha256 string"
    )
    path = work_path(spark, "settled")
    known = small.join(listed, ["uid", "check"], "left").mapInArrow(
        _settle_known,
        f"doc_id {kind}, uid long, check int, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "is_open boolean, packed binary, known array<long>, undecided array<long>, lent array<long>",
    )
    with shuffles_freed(spark):
        known.write.parquet(path)
    settled = spark.read.parquet(path)

    # Third rank, of the starts that are still undecided.
    still_open = settled.where("is_open")
    ranked = settled.where(F.col("packed").isNotNull())
    starts = ranked.select("packed", "uid", "check", "undecided", "lent").mapInArrow(
        _emit_starts, "one long, two long, settled boolean, n int, uid long, check int, start long"
    )
    # One exchange for counts and starts; a task sends a pair at most twice in a batch, however often it occurs.
    total = F.sum("n").over(Window.partitionBy("one", "two", "settled"))
    repeated = starts.withColumn("total", total).where((F.col("total") > 1) & F.col("start").isNotNull()).select("uid", "check", "start")
    by_row = repeated.groupBy("uid", "check").agg(F.collect_set("start").alias("found"))
    closed = still_open.select("doc_id", "uid", "check", "n_bytes", "packed", "known").join(by_row, ["uid", "check"], "left").mapInArrow(
        _settle_open, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
    return settled.where("NOT is_open").select(*RESULT).unionByName(closed)
