"""Packing documents into windows by the sum-of-squares rule.

Each task packs the documents that it reads: no shuffle and no order between tasks. A document longer than a window
fills whole windows and leaves a rest. Rests are placed online: a level array counts the open windows of every fill
level, and a rest goes to the level (or to a new window) that makes the sum of the squared counts smallest. At most
``open_limit`` windows stay open; when there are more, and at the end of the task, the open windows are emptied from
the least filled on and their pieces are cut to fill the others, so that at most one window of a task stays short.

``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` per piece. A window's number is its task's number
followed by its number within the task. Edge cases: an empty or null text is one end id; rows that repeat an id are
packed as rows of their own; a null id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faktorium.llm.tokens import END_ID, table

WINDOW = 4096
OPEN_LIMIT = 8192
TASK_BITS = 40

Piece = tuple[int, int, int]  # document, start, length


class SumOfSquares:
    """Online packing of lengths below ``window``; ``place`` returns a window that became full, or None."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = defaultdict(list)
        self.n_open = 0

    def best_level(self, length: int) -> int:
        """The fill level whose use keeps the sum of squares smallest; 0 is a new window. Ties: the fullest level."""
        counts = self.levels
        after = counts[length:].copy()  # level h turns into h + length
        cost = 2 * after + 1
        cost[-1] = 0  # a full window is no longer open
        before = counts[: len(cost)]
        cost = np.where(before > 0, cost - 2 * before + 1, np.iinfo(np.int64).max)
        cost[0] = 2 * counts[length] + 1
        return len(cost) - 1 - int(np.argmin(cost[::-1]))

    def place(self, piece: Piece) -> list[Piece] | None:
        level = self.best_level(piece[2])
        if level:
            pieces = self.open[level].pop()
            self.levels[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        level += piece[2]
        if level == self.window:
            return pieces
        self.open[level].append(pieces)
        self.levels[level] += 1
        self.n_open += 1
        return None

    def settle(self, keep: int) -> Iterator[list[Piece]]:
        """Empty the least filled open windows into the fullest ones, cutting pieces, until ``keep`` are open."""
        stacks = sorted((level, pieces) for level, found in self.open.items() for pieces in found)
        self.__init__(self.window)
        first, last = 0, len(stacks) - 1
        while last - first + 1 > keep and first < last:
            level, pieces = stacks[last]
            need = self.window - level
            while need and first < last:
                have, donor = stacks[first]
                document, start, length = donor.pop()
                take = min(need, length)
                pieces.append((document, start + length - take, take))
                if take < length:
                    donor.append((document, start, length - take))
                need -= take
                stacks[first] = (have - take, donor)
                if have == take:
                    first += 1
            if need:
                stacks[last] = (self.window - need, pieces)
                break
            yield pieces
            last -= 1
        for level, pieces in stacks[first : last + 1]:
            self.open[level].append(pieces)
            self.levels[level] += 1
            self.n_open += 1


def pack(
    documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID,
    window: int = WINDOW, open_limit: int = OPEN_LIMIT,
) -> DataFrame:
    """Tokenize and pack every row; see the module for the columns."""
    end = np.array([end_id], "<u4").tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_of, packer = table(path), SumOfSquares(window)
        first_number = TaskContext.get().partitionId() << TASK_BITS
        number, next_document = 0, 0
        documents_open: dict[int, tuple] = {}  # id, ids of the rest, place of the rest, all ids, ids not yet packed
        out: list[tuple] = []

        def close(pieces: list[Piece]) -> None:
            nonlocal number
            offset = 0
            for document, start, length in pieces:
                name, ids, base, total, left = documents_open[document]
                view = memoryview(ids)[4 * (start - base) : 4 * (start - base + length)]
                out.append((name, start, length, zlib.crc32(view), total, first_number + number, offset))
                offset += length
                left -= length
                if left:
                    documents_open[document] = (name, ids, base, total, left)
                else:
                    del documents_open[document]
            number += 1

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * 7
            arrays = [pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:]]]
            return pa.RecordBatch.from_arrays(arrays, NAMES)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for name, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = pieces_of.ids(value) + end
                total = len(ids) // 4
                whole = total - total % window
                for start in range(0, whole, window):
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + window)])
                    out.append((name, start, window, crc, total, first_number + number, 0))
                    number += 1
                if total > whole:
                    documents_open[next_document] = (name, ids[4 * whole :], whole, total, total - whole)
                    full = packer.place((next_document, whole, total - whole))
                    next_document += 1
                    if full:
                        close(full)
                    if packer.n_open > open_limit:
                        for full in packer.settle(open_limit // 2):
                            close(full)
            yield batch_of(out)
            out.clear()
        if id_type is not None:
            for full in packer.settle(1):
                close(full)
            for pieces in [p for found in packer.open.values() for p in found]:
                close(pieces)
            yield batch_of(out)

    rows = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        packed, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
