"""Texts as columns and as byte arrays.

Inside tasks a batch of texts is one array of UTF-8 bytes with the offset of
every document, so that words, n-grams and windows are found for the whole
batch by array operations and never per character.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 4, 2

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
# Word bytes of the learned models: digits, letters and every byte of a character beyond ASCII.
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True

_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; a null text is an empty one."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def is_held_out(doc_id: Column) -> Column:
    """True for the documents that no model may learn from; a null id counts as its empty text."""
    key = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % HELD_OUT_MODULUS == HELD_OUT_REMAINDER


def held_out_id(doc_id: object) -> bool:
    """``is_held_out`` of one value, for tests."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT_MODULUS == HELD_OUT_REMAINDER


def only(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Select columns under new names, so that other columns of the input can't clash with later ones."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, out of the way of the columns that an operator adds; ``select("row.*")`` unpacks it."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns, null or not: a place among rows that are equal otherwise, wherever they lie."""
    return F.xxhash64(*[x for c in df.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`").cast("string"))])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each one; a null text is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(batches: Iterable[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``limit`` text bytes; a longer text is a batch of its own."""
    for batch in batches:
        _, bounds = utf8(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(bounds, bounds[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def fold(data: np.ndarray) -> np.ndarray:
    return _FOLD[data]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every ``data[start:end]``, the same wherever the bytes stand."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", len(data) + 1)[starts])


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word of folded bytes; words don't cross documents."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _WORD[data]
    first, last = inside[:-1].copy(), inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    last[:] &= ~inside[1:]
    filled = bounds[:-1][bounds[1:] > bounds[:-1]]
    ends = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    first[filled] = inside[filled]
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(bounds, starts, side="right") - 1
