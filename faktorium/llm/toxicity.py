"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct buckets of its words, of pairs of neighbours and of pairs with one word between
them. The model is fitted on at most ``SAMPLE_ROWS`` labelled documents (the first ones in the order of a hash of the
id): their features are computed in parallel and one task runs the online updates, with a learning rate per
coordinate. L1 leaves most weights at zero, so the weights that are broadcast are a short sparse vector of at most
``2**BUCKET_BITS`` entries. Scoring runs over all whole texts, a batch at a time.

Edge cases: a null or empty text has no features and gets the score of the bias; null labels are ignored, of several
labels of a document the largest counts; without labels every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faktorium.llm.texts import blocks, fold, is_held_out, mix, only, span_hashes, utf8, words

BUCKET_BITS = 20
SAMPLE_ROWS = 12_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.1
THRESHOLD = 0.3


@dataclass
class ToxicityModel:
    buckets: np.ndarray  # int32, sorted
    weights: np.ndarray  # float32
    bias: float


def gram_buckets(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every word, neighbour pair and skip pair; none crosses documents."""
    data, bounds = utf8(text)
    data = fold(data)
    starts, ends, owner = words(data, bounds)
    word = span_hashes(data, starts, ends)
    hashes, owners = [word], [owner]
    for distance in (1, 2):
        if len(word) > distance:
            inside = owner[:-distance] == owner[distance:]
            pair = word[:-distance] * np.uint64(0x9E3779B97F4A7C15) + word[distance:] + np.uint64(distance)
            hashes.append(mix(pair[inside]))
            owners.append(owner[:-distance][inside])
    return (np.concatenate(hashes) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32), np.concatenate(owners)


class Ftrl:
    """FTRL-proximal with binary features; the last coordinate is the bias, which is not regularised."""

    def __init__(self, size: int = 1 << BUCKET_BITS):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.bias = size

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == self.bias, 0.0, L1)
        w = -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def update(self, buckets: np.ndarray, label: int) -> float:
        at = np.append(buckets, self.bias)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
        g = p - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g
        return p


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text"):
        buckets, owners = gram_buckets(batch.column("text"))
        keys = np.unique((owners.astype(np.int64) << BUCKET_BITS) | buckets)
        bounds = np.searchsorted(keys, np.arange(batch.num_rows + 1, dtype=np.int64) << BUCKET_BITS)
        flat = (keys & ((1 << BUCKET_BITS) - 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("label"), lists], ["place", "label", "buckets"])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [
        (np.asarray(b, np.int32), y)
        for batch in batches
        for b, y in zip((x.values.to_numpy() for x in batch.column("buckets")), batch.column("label").to_pylist())
    ]
    model = Ftrl()
    for _ in range(EPOCHS if rows else 0):
        for buckets, label in rows:
            model.update(buckets, label)
    everywhere = np.arange(model.bias + 1)
    w = model.weights(everywhere)
    used = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(w[used], pa.float64())], ["bucket", "weight"])


def fit(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> ToxicityModel:
    """Learn from the labelled documents that aren't held out."""
    known = only(labels, id=doc_id, label=F.col(f"`{label}`").cast("int")).where("id IS NOT NULL AND label IS NOT NULL")
    known = known.where(~is_held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    place = F.xxhash64(F.col("id"))
    sample = known.select("id", "label", place.alias("place")).orderBy("place", "id").limit(sample_rows)
    chosen = only(documents, doc_id=doc_id, text=F.col(f"`{text}`").cast("string")).join(
        F.broadcast(sample), F.col("doc_id") == F.col("id")
    )
    features = chosen.select("text", "label", "place").mapInArrow(_features, "place long, label int, buckets array<int>")
    trained = features.repartition(1).sortWithinPartitions("place").mapInArrow(_train, "bucket int, weight double")
    table = trained.toArrow()
    buckets, weights = table.column("bucket").to_numpy(), table.column("weight").to_numpy()
    is_bias = buckets == 1 << BUCKET_BITS
    order = np.argsort(buckets[~is_bias])
    return ToxicityModel(
        buckets[~is_bias][order].astype(np.int32), weights[~is_bias][order].astype(np.float32), float(weights[is_bias].sum())
    )


_dense: dict[int, tuple[ToxicityModel, np.ndarray]] = {}


def score_texts(model: ToxicityModel, text: pa.Array) -> np.ndarray:
    held = _dense.get(id(model))
    if held is None:
        table = np.zeros(1 << BUCKET_BITS, np.float32)
        table[model.buckets] = model.weights
        _dense.clear()
        held = _dense[id(model)] = (model, table)
    buckets, owners = gram_buckets(text)
    used = held[1][buckets] != 0
    keys = np.unique((owners[used].astype(np.int64) << BUCKET_BITS) | buckets[used])
    total = np.bincount(keys >> BUCKET_BITS, weights=held[1][keys & ((1 << BUCKET_BITS) - 1)], minlength=len(text))
    return 1 / (1 + np.exp(-np.clip(total + model.bias, -30, 30)))


def predict(spark: SparkSession, model: ToxicityModel, documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` per row."""
    shared = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            score = score_texts(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    rows = only(documents, doc_id=doc_id, text=F.col(f"`{text}`").cast("string"))
    return rows.mapInArrow(scored, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
