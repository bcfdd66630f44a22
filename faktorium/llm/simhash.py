"""SimHash near-duplicates by a segment-popcount embedding.

Fingerprints of 64 bits are mapped to the bit counts of their ``SEGMENTS`` segments. Flipping one bit changes one
count by one, so the Manhattan distance of two count vectors is never above the Hamming distance of the fingerprints:
it is a lower bound, and everything within ``distance`` bits lies within that radius of the grid.

The range join runs over grid cells. The segments form ``GROUPS`` groups; a radius of 4 can spoil at most 4 of 8
groups, so two fingerprints in range have equal counts in at least 4 of them. Each choice of those groups is one grid
whose cell is the counts of the chosen segments: rows meet in a cell, never in a product of tables. Inside a cell the
exact distance decides.

Only distinct fingerprints are joined (copies are combined map-side first), and a cell answers with links of a
spanning forest of its members instead of all pairs: the reachable sets are the same. The search of a cell takes the
members within range of a reached one out of the open list, so that dense cells cost about one pass per member
still open and not the square of the cell.

Edge cases: a text without words (or null) has fingerprint zero and is linked like any other; a text of fewer than
``width`` words has its whole word sequence as single shingle; rows that repeat an id are rows of one component; a
null id never is a component's name unless no member has an id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faktorium.llm.components import components
from faktorium.llm.texts import only, row_hash, whole_row
from faktorium.session import work_path

WIDTH, DISTANCE, SEED = 4, 4, 42
SEGMENTS, GROUPS = 32, 8


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """SimHash of the word shingles of one text; bit i is set if it is set in more than half of the hashes."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[: max(1, len(parts) - width + 1)].tolist(), ends[min(width, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[s:e], seed) for s, e in zip(first, last)])
    counts, n = np.zeros(64, np.int64), len(first)
    table = np.frombuffer(raw, np.uint8).reshape(n, 8)
    for i in range(0, n, 1 << 15):
        counts += np.unpackbits(table[i : i + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed 64-bit number) per row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, width) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    rows = only(documents, doc_id=doc_id, text=F.col(f"`{text}`").cast("string"))
    return rows.mapInArrow(hashed, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def popcounts(fps: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """The embedding: bit counts of the segments, one row per fingerprint."""
    bits = np.unpackbits(np.ascontiguousarray(fps.astype(">u8")).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.reshape(len(fps), segments, 64 // segments).sum(axis=2, dtype=np.uint8)


def cells(distance: int = DISTANCE, segments: int = SEGMENTS, groups: int = GROUPS):
    """A ``mapInArrow`` function: one row per fingerprint and grid, ``cell`` packs the grid and its counts."""
    grids = list(combinations(range(groups), groups - distance))
    each, base = segments // groups, 64 // segments + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(fps):
                continue
            counts = popcounts(fps, segments).reshape(len(fps), groups, each).astype(np.int64)
            code = (counts * base ** np.arange(each)).sum(axis=2)
            out = np.empty((len(grids), len(fps)), np.int64)
            for i, grid in enumerate(grids):
                out[i] = i
                for g in grid:
                    out[i] = out[i] * base**each + code[:, g]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out.ravel()), pa.array(np.tile(fps.view(np.int64), len(grids)))], ["cell", "fp"]
            )

    return place


def forest(members: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the members of one cell, each link verified."""
    sources, targets = [], []
    still = members
    while len(still):
        queue, still = [still[0]], still[1:]
        while queue and len(still):
            node = queue.pop()
            near = np.bitwise_count(still ^ node) <= distance
            if near.any():
                found = still[near]
                sources.append(np.full(len(found), node))
                targets.append(found)
                queue.extend(found)
                still = still[~near]
    if not sources:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(sources), np.concatenate(targets)


def cell_links(distance: int = DISTANCE):
    """A ``mapInArrow`` function over rows sorted by cell: the forest links of every cell."""

    def answer(cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        ends = np.concatenate([starts[1:], [len(cell)]])
        pairs = starts[ends - starts == 2]
        near = np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= distance
        u, v = [fp[pairs][near]], [fp[pairs + 1][near]]
        many = ends - starts > 2
        for s, e in zip(starts[many].tolist(), ends[many].tolist()):
            a, b = forest(fp[s:e], distance)
            u.append(a)
            v.append(b)
        return np.concatenate(u), np.concatenate(v)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        last: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in _with_end(batches):
            if batch is not None:
                if not batch.num_rows:
                    continue
                new_cell = batch.column("cell").to_numpy(zero_copy_only=False)
                new_fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                last.append((new_cell, new_fp))
                if new_cell[-1] == last[0][0][0]:
                    continue
            if not last:
                continue
            cell = np.concatenate([x[0] for x in last])
            fp = np.concatenate([x[1] for x in last])
            # The last cell may go on in the next batch.
            cut = len(cell) if batch is None else int(np.searchsorted(cell, cell[-1]))
            last = [(cell[cut:], fp[cut:])] if cut < len(cell) else []
            u, v = answer(cell[:cut], fp[:cut])
            if len(u):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"]
                )

    return link


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Verified links ``u, v`` between distinct fingerprints ``fp`` that connect all within ``distance`` bits."""
    placed = distinct.select("fp").mapInArrow(cells(distance), "cell long, fp long")
    sorted_cells = placed.repartition("cell").sortWithinPartitions("cell", "fp")
    return sorted_cells.mapInArrow(cell_links(distance), "u long, v long").distinct()


def near_duplicates(
    spark: SparkSession, documents: DataFrame, doc_id: str = "doc_id", text: str = "text",
    width: int = WIDTH, distance: int = DISTANCE,
) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest id that a chain of links reaches, per row."""
    path = work_path(spark, "fingerprints")
    fingerprints(documents, doc_id, text, width).write.parquet(path)
    rows = spark.read.parquet(path)
    ids_path = work_path(spark, "fingerprint-ids")
    rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")).write.parquet(ids_path)
    ids = spark.read.parquet(ids_path)
    linked = components(spark, near_links(ids, distance)).withColumnRenamed("node", "fp")
    named = ids.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_fp = named.select("fp", "component").join(names, "component").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(
    spark: SparkSession, documents: DataFrame, doc_id: str = "doc_id", text: str = "text",
    width: int = WIDTH, distance: int = DISTANCE,
) -> DataFrame:
    """The documents without near-duplicates: of each component one row stays, the one with the smallest id.

    Ids that are null come last and rows of equal id in the order of a hash of all their columns, wherever they lie. A
    stored row number names the rows that go: an id that is null or repeated says nothing about other rows of that id.
    """
    stored = work_path(spark, "numbered")
    documents.select(
        whole_row(documents).alias("row"), row_hash(documents).alias("tie"), F.monotonically_increasing_id().alias("row_no")
    ).write.parquet(stored)
    numbered = spark.read.parquet(stored)
    name = F.col(f"row.`{doc_id}`")
    keyed = numbered.select(
        F.struct(name.isNull().alias("no_id"), name.alias("id"), "tie", "row_no").alias("key"), F.col(f"row.`{text}`").alias("text")
    )
    groups = near_duplicates(spark, keyed, "key", "text", width, distance)
    dropped = groups.where(F.col("doc_id.row_no") != F.col("component_id.row_no")).select("doc_id.row_no")
    path = work_path(spark, "near-copies")
    dropped.write.parquet(path)
    return numbered.join(spark.read.parquet(path), "row_no", "left_anti").select("row.*")
