"""Phrase collocations: how often the words of a frequent phrase stand together, against how often its two parts stand at all.

Every word of a text starts a suffix: the word and the words behind it in its piece, ``LONGEST`` at most. A phrase occurs
as often as there are suffixes that begin with it, so all counts are the sizes of partitions of the suffixes that are
equal in their first words.

1. Each task sorts the suffixes of a block of texts and counts equal ones once, with a weight; the sorted block and a
   sample of its suffixes go to the shared folder. Equal suffixes of a block are one row from here on, so a phrase that
   makes up most of the corpus weighs no more than the number of blocks.
2. Blocks are routed by their leading words. Splitters from the samples cut the order of all suffixes into buckets of
   about ``BUCKET_ROWS`` rows; leading words that are too frequent for one bucket are cut inside, at their second to fourth word.
3. A bucket is partitioned by a multikey three-way quicksort of pointers to its suffixes: less, equal and greater in the
   first word, the equal part again by the next word, down to the last. The weight of an equal part is the count of its
   phrase. A part below ``LEAST`` is abandoned, whatever it holds. Phrases that may go on in a neighbour bucket are those
   that one of its two splitters begins with; these few are counted apart and added up over the buckets.
4. Counts are joined to the parts of every cut of a candidate; scores are exact integers. A longer candidate takes a
   shorter one along by one aggregate over all its contiguous parts.

Bounds: a task holds one block (``BLOCK_BYTES`` of text and some 25 times that in arrays, or one word if that is longer)
or one bucket. Longer texts are taken in slices that end between words and see the next ``LONGEST - 1`` words. The
driver and every task hold one splitter per bucket, at most ``MAX_BUCKETS``; beyond 10^12 distinct suffixes the buckets
grow instead.

Edge cases: a null text is empty; a null language is ``und``, together with rows that say so; words are compared as
UTF-8 bytes after A-Z are lower-cased; repeated rows count every time; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faktorium.llm.texts import fold, only, utf8
from faktorium.session import work_path

LONGEST = 4
LEAST = 30
TOP = 2000
COVER = 80
BLOCK_BYTES = 6 << 20
BUCKET_ROWS = 1_000_000
SAMPLE_ROWS = 1 << 14
MAX_BUCKETS = 1 << 19

# Blocks are megabytes that are compressed already: each is a page of its own, and the writer's and the reader's codecs, which
# keep buffers of the size of a page outside the heap, have nothing to do.
LARGE_VALUES = {"compression": "uncompressed", "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}

_BLANKS, _STOPS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANKS)] = 1
_KIND[list(_STOPS)] = 2
_BETWEEN = re.compile(rb"[\x20\x09.,;:!?\x0a-\x0d]")

#: Language, then words: the key of a suffix, each as bytes; a word that isn't there is empty and comes first.
KEYS = ["lang", *[f"w{i}" for i in range(1, LONGEST + 1)]]
Key = tuple[bytes, ...]


# --- sorted blocks of suffixes --------------------------------------------------------------------------------------


class Block:
    """Sorted, distinct suffixes: columns of numbers into sorted lists of languages and words (0: no word), and weights."""

    def __init__(self, langs: list[bytes], words: pa.Array, columns: list[np.ndarray], weights: np.ndarray):
        self.langs, self.words, self.columns, self.weights = langs, words, columns, weights

    def __len__(self) -> int:
        return len(self.weights)

    def key(self, i: int) -> Key:
        found = [int(c[i]) for c in self.columns]
        return (self.langs[found[0]], *[self.words[w - 1].as_py() if w else b"" for w in found[1:]])

    def find(self, key: Key, words: list[bytes]) -> int:
        """The first suffix that isn't before ``key``; ``words`` is the list of all words."""
        low, high = 0, len(self)
        for i, (part, column) in enumerate(zip(key, self.columns)):
            names = words if i else self.langs
            at = bisect_left(names, part) if part or not i else -1
            there = at < 0 or (at < len(names) and names[at] == part)
            number = at + 1 if i else at
            if not there:
                return low + int(np.searchsorted(column[low:high], number))
            low, high = low + int(np.searchsorted(column[low:high], number)), low + int(np.searchsorted(column[low:high], number, "right"))
        return low

    def part(self, start: int, stop: int) -> Block:
        """Some of the suffixes, with the words that they use."""
        columns = [c[start:stop] for c in self.columns]
        used = np.zeros(len(self.words) + 1, bool)
        for c in columns[1:]:
            used[c] = True
        used[0] = False
        numbers = np.cumsum(used, dtype=np.int32)
        numbers[~used] = 0
        words = self.words.take(pa.array(np.flatnonzero(used) - 1))
        return Block(self.langs, words, [columns[0], *[numbers[c] for c in columns[1:]]], self.weights[start:stop])

    def pack(self) -> bytes:
        """One compressed record; numbers are stored byte by byte, as the high ones hardly vary."""
        names, values = ["langs", "words"], [pa.array(self.langs, pa.binary()), self.words]
        for name, column in zip([*KEYS, "weight"], [*self.columns, self.weights]):
            for shift in range(0, max(1, int(column.max(initial=0)).bit_length()), 8):
                names.append(f"{name}-{shift}")
                values.append(pa.array((column >> shift).astype(np.uint8)))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values]
        batch, sink = pa.RecordBatch.from_arrays(lists, names), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(batch)
        return sink.getvalue().to_pybytes()

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        with pa.ipc.open_stream(pa.BufferReader(data)) as stream:
            batch = stream.read_next_batch()
        lists = {name: batch.column(name).values for name in batch.schema.names}

        def column(name: str, kind: type) -> np.ndarray:
            total = np.zeros(len(lists["weight-0"]), kind)
            for shift in range(0, 64, 8):
                if f"{name}-{shift}" in lists:
                    total |= lists[f"{name}-{shift}"].to_numpy().astype(kind) << shift
            return total

        return cls(lists["langs"].to_pylist(), lists["words"], [column(k, np.int32) for k in KEYS], column("weight", np.int64))


def slices(lang: bytes, text: bytes, limit: int) -> Iterator[tuple[bytes, bytes, int]]:
    """A text in slices of about ``limit`` bytes: language, bytes, and how many of them the slice owns.

    A slice ends between two words; the words behind, up to the end of the piece, let its last suffixes be whole.
    """
    ahead = re.compile(rb"(?:[\x20\x09]*[^\x20\x09.,;:!?\x0a-\x0d]+){0,%d}" % (LONGEST - 1))
    start = 0
    while len(text) - start > limit and (gap := _BETWEEN.search(text, start + limit)):
        yield lang, text[start : ahead.match(text, gap.start()).end()], gap.start() - start
        start = gap.start()
    yield lang, text[start:], len(text) - start


def sort_block(items: Sequence[tuple[bytes, bytes, int]]) -> Block:
    """The distinct suffixes that begin in what the slices own."""
    data = fold(np.frombuffer(b"\n".join([*[text for _, text, _ in items], b""]), np.uint8))
    sizes = np.array([len(text) + 1 for _, text, _ in items], np.int64)
    bases = np.cumsum(sizes) - sizes
    kind = _KIND[data]
    inside = np.zeros(len(data) + 1, bool)
    np.equal(kind, 0, out=inside[1:])
    edges = np.flatnonzero(inside[1:] != inside[:-1]).astype(np.int32)
    starts, ends = edges[::2], edges[1::2]
    piece = np.searchsorted(np.flatnonzero(kind == 2).astype(np.int32), starts).astype(np.int32)

    # All words one behind the other, and a number for each in the order of their bytes. What isn't needed any more is let go.
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    values = data[inside[1:]]
    del data, kind, inside, ends
    encoded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values)]).dictionary_encode()
    del offsets, values
    order = pc.sort_indices(encoded.dictionary).to_numpy()
    numbers = np.empty(len(order), np.int32)
    numbers[order] = np.arange(1, len(order) + 1, dtype=np.int32)
    words = encoded.dictionary.take(pa.array(order))

    columns = [numbers[encoded.indices.to_numpy()]]
    del encoded, order, numbers
    for _ in range(LONGEST - 1):
        following = np.zeros_like(columns[0])
        following[:-1] = np.where(piece[1:] == piece[:-1], columns[-1][1:], 0)
        columns.append(following)
    del piece, following

    langs = sorted({lang for lang, _, _ in items})
    places = {lang: i for i, lang in enumerate(langs)}
    item = (np.searchsorted(bases, starts, side="right") - 1).astype(np.int32)
    columns.insert(0, np.array([places[lang] for lang, _, _ in items], np.int32)[item])
    own = starts < (bases + np.array([n for _, _, n in items], np.int64))[item]
    del edges, starts, item
    if not own.all():
        columns = [c[own] for c in columns]

    base = np.int64(len(words) + 1)
    keys = [columns[3] * base + columns[4], columns[1] * base + columns[2], *([columns[0]] if len(langs) > 1 else [])]
    rank = np.lexsort(keys)
    new = np.zeros(len(rank), bool)
    new[:1] = True
    while keys:
        ranked = keys.pop()[rank]
        new[1:] |= ranked[1:] != ranked[:-1]
    heads = np.flatnonzero(new)
    first = rank[heads]
    return Block(langs, words, [c[first] for c in columns], np.diff(heads, append=len(rank)))


def sort_blocks(limit: int):
    """A ``mapInArrow`` function over ``lang, text``: packed blocks, their sizes and samples of their suffixes."""

    def stored(items: list) -> pa.RecordBatch:
        block = sort_block(items)
        n = max(1, len(block) // SAMPLE_ROWS) if len(block) else 0
        sample = [dict(zip(KEYS, block.key(i))) for i in (np.arange(n) * 2 + 1) * len(block) // max(1, 2 * n)]
        kind = pa.list_(pa.struct([(k, pa.binary()) for k in KEYS]))
        return pa.RecordBatch.from_arrays(
            [pa.array([block.pack()], pa.binary()), pa.array([len(block)], pa.int64()), pa.array([sample], kind)], ["block", "n", "sample"]
        )

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, held = [], 0
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            langs, lang_bounds = utf8(batch.column("lang"))
            for i in range(batch.num_rows):
                lang = langs[lang_bounds[i] : lang_bounds[i + 1]].tobytes()
                for item in slices(lang, data[bounds[i] : bounds[i + 1]].tobytes(), limit):
                    items.append(item)
                    held += len(item[1])
                    if held >= limit:
                        yield stored(items)
                        items, held = [], 0
        if items:
            yield stored(items)

    return sort


# --- routing and counting -------------------------------------------------------------------------------------------


def splitters(blocks: DataFrame, bucket_rows: int) -> list[Key]:
    """The least suffixes of all buckets but the first, in order."""
    total = blocks.agg(F.sum("n")).first()[0] or 0
    buckets = min(-(-total // bucket_rows), MAX_BUCKETS)
    if buckets <= 1:
        return []
    rows = blocks.select(F.inline("sample")).repartitionByRange(buckets, *KEYS)
    least = rows.groupBy(F.spark_partition_id()).agg(F.min(F.struct(*KEYS)).alias("key")).collect()
    return sorted(tuple(bytes(v) for v in r["key"]) for r in least)[1:]


def route(bounds: Sequence[Key]):
    """A ``mapInArrow`` function: every block cut at the splitters, as ``bucket, page``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("block"):
                block = Block.unpack(data.as_py())
                words = block.words.to_pylist()
                edges = [0, *[block.find(b, words) for b in bounds], len(block)]
                for bucket, (start, stop) in enumerate(zip(edges, edges[1:])):
                    if start < stop:
                        page = block.part(start, stop).pack()
                        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([page], pa.binary())], ["bucket", "page"])

    return cut


def quicksort_counts(columns: Sequence[np.ndarray], weights: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Depth, a pointer and the weight of every set of suffixes that are equal in their first columns and weigh ``least``.

    A multikey three-way quicksort of pointers: parts below ``least`` are abandoned.
    """
    parts = [(np.arange(len(weights)), 0)]
    while parts:
        pointers, depth = parts.pop()
        keys = columns[depth][pointers]
        some = keys[:: max(1, len(keys) // 25)]
        pivot = np.partition(some, len(some) // 2)[len(some) // 2]
        below = keys < pivot
        equal = keys == pivot
        for part in (pointers[below], pointers[~(below | equal)]):
            if len(part) and weights[part].sum() >= least:
                parts.append((part, depth))
        part = pointers[equal]
        weight = int(weights[part].sum())
        # Number 0 in a column of words is the end of a piece.
        if weight >= least and (pivot or not depth):
            yield depth, int(part[0]), weight
            if depth + 1 < len(columns):
                parts.append((part, depth + 1))


def joined(pages: Iterable[bytes]) -> tuple[pa.Array, pa.Array, list[np.ndarray], np.ndarray]:
    """The pages of a bucket under common numbers: languages, words, columns and weights."""
    blocks = [Block.unpack(p) for p in pages]

    def common(lists: list[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
        encoded = pa.concat_arrays(lists).dictionary_encode()
        return encoded.dictionary, np.split(encoded.indices.to_numpy().astype(np.int32), np.cumsum([len(x) for x in lists])[:-1])

    langs, lang_numbers = common([pa.array(b.langs, pa.binary()) for b in blocks])
    words, word_numbers = common([b.words for b in blocks])
    columns = [np.concatenate([n[b.columns[0]] for b, n in zip(blocks, lang_numbers)])]
    shifted = [np.concatenate([[0], n + 1]).astype(np.int32) for n in word_numbers]
    for i in range(1, len(KEYS)):
        columns.append(np.concatenate([n[b.columns[i]] for b, n in zip(blocks, shifted)]))
    return langs, words, columns, np.concatenate([b.weights for b in blocks])


def count_bucket(bounds: Sequence[Key], least: int):
    """An ``applyInPandas`` function: ``lang, phrase, words, n`` of the frequent phrases and the edges of a bucket."""

    def count(pages: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pages["bucket"].iloc[0])
        langs, words, columns, weights = joined(pages["page"])
        edges = {}
        for key in bounds[max(0, bucket - 1) : bucket + 1]:
            part = np.ones(len(weights), bool)
            for depth, name in enumerate(key):
                if depth and not name:
                    break
                number = pc.index(words if depth else langs, pa.scalar(name, pa.binary())).as_py()
                part &= columns[depth] == (number + 1 if depth else number)
                if number < 0 or not part.any():
                    break
                edges[key[: depth + 1]] = int(weights[part].sum())
        found = [(key[0], b" ".join(key[1:]), len(key) - 1, n) for key, n in edges.items()]
        for depth, pointer, n in quicksort_counts(columns, weights, least):
            numbers = [int(columns[i][pointer]) for i in range(depth + 1)]
            key = (langs[numbers[0]].as_py(), *[words[w - 1].as_py() for w in numbers[1:]])
            if key not in edges:
                found.append((key[0], b" ".join(key[1:]), depth, n))
        return pd.DataFrame(found, columns=["lang", "phrase", "words", "n"])

    return count


def count_phrases(
    spark: SparkSession, documents: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST,
    block_bytes: int = BLOCK_BYTES, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``lang, phrase, words, n``: all phrases of up to ``LONGEST`` words with ``n >= least``; 0 words count every word."""
    language = F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und"))
    rows = only(documents, lang=language, text=F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    path = work_path(spark, "suffix-blocks")
    sample = ", ".join(f"{k}: binary" for k in KEYS)
    sorted_blocks = rows.mapInArrow(sort_blocks(block_bytes), f"block binary, n long, sample array<struct<{sample}>>")
    sorted_blocks.write.options(**LARGE_VALUES).parquet(path)
    blocks = spark.read.parquet(path)
    bounds = splitters(blocks, bucket_rows)
    pages = blocks.select("block").mapInArrow(route(bounds), "bucket long, page binary")
    counted = pages.groupBy("bucket").applyInPandas(count_bucket(bounds, least), "lang binary, phrase binary, words int, n long")
    summed = counted.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return summed.select(F.col("lang").cast("string").alias("lang"), F.col("phrase").cast("string").alias("phrase"), "words", "n")


# --- candidates and scores ------------------------------------------------------------------------------------------


def _exact(value: Column) -> Column:
    return value.cast("decimal(30,0)")


def score(counts: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, l, r, score`` of every candidate: its lowest-scoring cut, of equal ones the first."""
    candidates = counts.where("words >= 2").withColumnRenamed("n", "a")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)"))
    left = counts.where("words >= 1").select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = counts.where("words >= 1").select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    parts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    parts = parts.withColumn("product", _exact(F.col("a")) * 2000000).withColumn("both", _exact(F.col("l")) + F.col("r"))
    scored = parts.withColumn("score", F.expr("product div both"))
    best = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def covered(counts: DataFrame) -> DataFrame:
    """``lang, phrase, longest_n``: the most frequent longer candidate around every phrase inside one."""
    longer = counts.where("words >= 3").withColumn("names", F.split("phrase", " "))
    inside = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("words") - 1),
            lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.array_join(F.slice("names", i, k), " ")),
        )
    )
    return longer.select("lang", "n", F.explode(inside).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longest_n"))


def collocations(counts: DataFrame, top: int = TOP, percent: int = COVER) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` candidates of every language."""
    rows = score(counts).join(covered(counts), ["lang", "phrase"], "left")
    swallowed = F.col("longest_n").isNotNull() & (_exact(F.col("longest_n")) * 100 >= _exact(F.col("a")) * percent)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.where(~swallowed).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(
    spark: SparkSession, documents: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP,
    percent: int = COVER, block_bytes: int = BLOCK_BYTES, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """The collocations of a table; the counts are stored in the shared folder on the way."""
    path = work_path(spark, "phrase-counts")
    count_phrases(spark, documents, text, lang, least, block_bytes, bucket_rows).write.parquet(path)
    return collocations(spark.read.parquet(path), top, percent)
