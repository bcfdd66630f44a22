"""Language identification by multinomial naive Bayes over hashed character n-grams.

Fit: counts of n-grams of code points per (language, bucket) are summed by Spark over a bounded sample of labelled
documents: of each language the ``DOCS_PER_LANGUAGE`` rows with the smallest hash of id and text, so every language has
some, copies don't widen the sample, and a row enters or not wherever it lies. Every language is learned, in blocks of
``BLOCK_LANGUAGES``: the counts of one block at a time come to the driver.

Scoring adds the log probabilities of all n-grams of a batch of whole texts at once and keeps the best language so far.
The matrix of log probabilities has 2**``BUCKET_BITS`` numbers of 4 bytes per language; at most ``PART_LANGUAGES`` of
them (128 MB) are on the driver and broadcast at a time. With more languages the rows go through one pass per part, which
carries the best so far along.

Edge cases: a null text or one without any letter is ``und`` with score 0; a null language is no label; without any
label every text is ``und``; an empty table gives an empty result. Ties go to the first language in sorted order.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from faktorium.llm.texts import blocks, is_held_out, only
from faktorium.session import work_path

BUCKET_BITS = 15
ORDERS = (1, 2, 3)
DOCS_PER_LANGUAGE = 4000
# Languages that a task counts or scores at a time, and whose counts the driver holds.
BLOCK_LANGUAGES = 128
SMOOTHING = 0.5
# Languages of one broadcast.
PART_LANGUAGES = 1024
# Rows that may enter the sample, as a multiple of the rows that are wanted, so that few are too few.
MARGIN = 2
HASH_RANGE = 1 << 62
# Bytes of text that a worker scores at a time; its arrays take some 60 times as much.
BLOCK_BYTES = 1 << 20
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class LanguagePart:
    """Some of the languages of a model, for scoring."""

    languages: list[str]
    log_probs: np.ndarray  # (2**BUCKET_BITS, languages), float32, the numbers of a language side by side
    priors: np.ndarray


@dataclass
class LanguageModel:
    """Languages in sorted order, their priors, and the stored counts that the log probabilities come from."""

    languages: list[str]
    priors: np.ndarray
    counts: DataFrame | None  # place of the language, bucket, n

    def part(self, start: int, stop: int) -> LanguagePart:
        stop = min(stop, len(self.languages))
        log_probs = np.zeros((stop - start, 1 << BUCKET_BITS), np.float32)
        for low in range(start, stop, BLOCK_LANGUAGES):
            high = min(low + BLOCK_LANGUAGES, stop)
            table = self.counts.where((F.col("place") >= low) & (F.col("place") < high)).toArrow()
            counts = np.zeros((high - low, 1 << BUCKET_BITS))
            counts[table.column("place").to_numpy() - low, table.column("bucket").to_numpy()] = table.column("n").to_numpy()
            counts += SMOOTHING
            log_probs[low - start : high - start] = np.log(counts / counts.sum(axis=1, keepdims=True))
        return LanguagePart(self.languages[start:stop], log_probs.T, self.priors[start:stop])

    def parts(self) -> Iterator[LanguagePart]:
        for start in range(0, len(self.languages), PART_LANGUAGES):
            yield self.part(start, start + PART_LANGUAGES)

    @property
    def log_probs(self) -> np.ndarray:
        """All log probabilities, for small models."""
        found = [part.log_probs for part in self.parts()]
        return np.concatenate(found, axis=1) if found else np.zeros((1 << BUCKET_BITS, 0), np.float32)


def gram_buckets(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of code points of the lower-cased texts, and the document of each; none crosses documents."""
    lowered = [(t or "").lower() for t in text.to_pylist()]
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    wide = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(lowered), dtype=np.int32), lengths)
    gram = np.zeros(len(wide), np.uint64)
    buckets, owners = [], []
    for order in range(1, max(ORDERS) + 1):
        n = len(wide) - order + 1
        if n <= 0:
            break
        # A code point has 21 bits, so three of them are one number.
        gram = (gram[:n] << np.uint64(21)) | wide[order - 1 : order - 1 + n]
        if order in ORDERS:
            inside = owner[:n] == owner[order - 1 : order - 1 + n]
            hashed = (gram[inside] + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
            hashed = (hashed ^ (hashed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            buckets.append((hashed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
            owners.append(owner[:n][inside])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(buckets), np.concatenate(owners)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts of one task; holds rows of counts for about ``BLOCK_LANGUAGES`` languages at a time."""
    totals: dict[str, np.ndarray] = {}

    def taken() -> Iterator[pa.RecordBatch]:
        for name, row in totals.items():
            used = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(row[used], pa.int64())],
                ["lang", "bucket", "n"],
            )
        totals.clear()

    for batch in blocks(batches, "text", BLOCK_BYTES):
        names, codes = np.unique(batch.column("lang").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        buckets, owners = gram_buckets(batch.column("text"))
        codes = codes[owners].astype(np.int64)
        for start in range(0, len(names), BLOCK_LANGUAGES):
            some = names[start : start + BLOCK_LANGUAGES].tolist()
            inside = (codes >= start) & (codes < start + len(some))
            keys = ((codes[inside] - start) << BUCKET_BITS) + buckets[inside]
            found = np.bincount(keys, minlength=len(some) << BUCKET_BITS)
            if totals and len(totals.keys() | set(some)) > BLOCK_LANGUAGES:
                yield from taken()
            for name, row in zip(some, found.reshape(len(some), -1)):
                totals[name] = totals.get(name, 0) + row
    yield from taken()


def sample_limit(n: Column, least: Column) -> Column:
    """Largest hash that enters the sample of a language with ``n`` rows, whose smallest hash is ``least``: never below it."""
    wanted = MARGIN * DOCS_PER_LANGUAGE
    rows = F.greatest(n, F.lit(wanted)).cast("decimal(19,0)")
    share = F.call_function("div", F.lit(str(wanted * HASH_RANGE)).cast("decimal(38,0)"), rows)
    return F.greatest(share, least)


def fit(documents: DataFrame, learn: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> LanguageModel:
    """Learn from the rows where ``learn`` holds and the language is known."""
    spark = documents.sparkSession
    rows = documents.where(learn & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    hashed = F.shiftrightunsigned(F.xxhash64(F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`").cast("string")), 2)
    rows = only(rows, text=text, lang=F.col(f"`{lang}`").cast("string"), h=hashed)
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least"))
    sizes = sizes.select("lang", "n", sample_limit(F.col("n"), F.col("least")).alias("most")).collect()
    sizes = {r["lang"]: (r["n"], r["most"]) for r in sizes}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros(0, np.float32), None)
    places = F.broadcast(spark.createDataFrame([(x, i, sizes[x][1]) for i, x in enumerate(languages)], "lang string, place int, most long"))
    near = rows.join(places, "lang").where(F.col("h") <= F.col("most"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = near.withColumn("rank", place).where(F.col("rank") <= DOCS_PER_LANGUAGE)
    # Few rows are left, of every language about as many; they are dealt out again to be counted.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    summed = (
        chosen.select("text", "lang", "h").repartition(parts, "h").select("text", "lang").mapInArrow(_counts, "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).join(places, "lang").select("place", "bucket", "n")
    )
    path = work_path(spark, "gram-counts")
    summed.write.parquet(path)
    n = np.array([sizes[x][0] for x in languages], np.float64)
    return LanguageModel(languages, np.log(n / n.sum()).astype(np.float32), spark.read.parquet(path))


def has_letters(text: pa.Array) -> np.ndarray:
    """Whether a text has any letter, which doesn't depend on a model; a null text has none."""
    return np.array([bool(v and _LETTER.search(v)) for v in text.to_pylist()], bool)


@dataclass
class Scores:
    """Per text: the best language so far, its log score, and the sum of all languages relative to it."""

    best: np.ndarray  # of str
    largest: np.ndarray
    others: np.ndarray

    @classmethod
    def none(cls, n: int) -> Scores:
        return cls(np.full(n, UNDETERMINED, object), np.full(n, -np.inf), np.zeros(n))

    def add(self, part: LanguagePart, buckets: np.ndarray, owners: np.ndarray) -> None:
        """Take the languages of one more part into account."""
        n = len(self.largest)
        for start in range(0, len(part.languages), BLOCK_LANGUAGES):
            names = np.array(part.languages[start : start + BLOCK_LANGUAGES], object)
            total = np.tile(part.priors[start : start + BLOCK_LANGUAGES].astype(np.float64), (n, 1))
            for i in range(len(names)):
                total[:, i] += np.bincount(owners, weights=part.log_probs[:, start + i][buckets], minlength=n)
            top = np.maximum(self.largest, total.max(axis=1))
            self.best = np.where(total.max(axis=1) > self.largest, names[total.argmax(axis=1)], self.best)
            self.others = self.others * np.exp(self.largest - top) + np.exp(total - top[:, None]).sum(axis=1)
            self.largest = top

    def result(self, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
        known = letters & (self.others > 0)
        score = np.where(known, 1 / np.maximum(self.others, 1.0), 0.0)
        return [b if k else UNDETERMINED for b, k in zip(self.best, known)], score


def score_texts(model: LanguageModel, text: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of every text."""
    scores, (buckets, owners) = Scores.none(len(text)), gram_buckets(text)
    for part in model.parts():
        scores.add(part, buckets, owners)
    return scores.result(has_letters(text))


def _pass(part: LanguagePart, rows: DataFrame, text: str, carried: list[str]) -> DataFrame:
    """One pass over the rows: the columns ``carried`` hold the scores before and after it."""
    shared = rows.sparkSession.sparkContext.broadcast(part)
    kept = [c for c in rows.columns if c not in carried]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text, BLOCK_BYTES):
            best, largest, others = [batch.column(c) for c in carried]
            scores = Scores(
                np.array(best.to_pylist(), object), largest.to_numpy(zero_copy_only=False), others.to_numpy(zero_copy_only=False)
            )
            scores.add(shared.value, *gram_buckets(batch.column(text)))
            added = [pa.array(scores.best, pa.string()), pa.array(scores.largest), pa.array(scores.others)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *added], kept + carried)

    ordered = rows.select(*[F.col(f"`{c}`") for c in kept + carried])
    return ordered.mapInArrow(scored, _nullable(ordered.schema))


def _nullable(schema: StructType) -> StructType:
    return StructType([StructField(f.name, f.dataType, True) for f in schema.fields])


def predict(
    spark: SparkSession, model: LanguageModel, documents: DataFrame, text: str = "text",
    predicted_name: str = "lang_pred", score_name: str = "lang_score", letters_name: str | None = None,
) -> DataFrame:
    """All columns of the documents with the language and its score, which replace columns of these names.

    With ``letters_name`` there is also a flag whether the text has any letter.
    """
    added = {predicted_name: F.lit(""), score_name: F.lit(0.0)}
    if letters_name is not None:
        added[letters_name] = F.lit(True)
    rows = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c not in added])
    kept = rows.columns
    free = (max(map(len, documents.columns)) + 1) * "_"
    carried = [f"{free}best", f"{free}largest", f"{free}others"]
    parts = len(range(0, len(model.languages), PART_LANGUAGES))
    if parts > 1:
        start = [F.lit(UNDETERMINED), F.lit(float("-inf")), F.lit(0.0)]
        rows = rows.select("*", *[value.alias(c) for value, c in zip(start, carried)])
        for part in itertools.islice(model.parts(), parts - 1):
            rows = _pass(part, rows, text, carried)
    last = [model.part((parts - 1) * PART_LANGUAGES, parts * PART_LANGUAGES)] if parts else []
    shared, names = spark.sparkContext.broadcast(last), [*kept, *added]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text, BLOCK_BYTES):
            scores = Scores.none(batch.num_rows)
            if parts > 1:
                best, largest, others = [batch.column(c) for c in carried]
                scores = Scores(
                    np.array(best.to_pylist(), object), largest.to_numpy(zero_copy_only=False), others.to_numpy(zero_copy_only=False)
                )
            buckets, owners = gram_buckets(batch.column(text))
            for part in shared.value:
                scores.add(part, buckets, owners)
            letters = has_letters(batch.column(text))
            predicted, score = scores.result(letters)
            arrays = [*[batch.column(c) for c in kept], pa.array(predicted, pa.string()), pa.array(score, pa.float64())]
            if letters_name is not None:
                arrays.append(pa.array(letters))
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = rows.select(*[F.col(f"`{c}`") for c in kept], *[value.alias(name) for name, value in added.items()]).schema
    return rows.mapInArrow(scored, _nullable(schema))


def learnable(doc_id: str = "doc_id") -> Column:
    return ~is_held_out(F.col(f"`{doc_id}`"))
