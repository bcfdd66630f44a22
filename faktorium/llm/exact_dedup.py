"""Exact deduplication with a heavy-hitter split.

1. Every row is reduced to (id, digest of its normalised text), written once to the shared folder.
2. Each task keeps a Misra-Gries summary of its digests: ``counters`` counters, whatever its input. The counters of
   all tasks are added per digest. The sum falls short of a digest's true count by at most rows / counters, and at
   most ``counters`` digests reach a sum of rows / counters, so every digest with 2 * rows / counters copies is found.
3. The candidates (at most ``counters``) are counted exactly over all rows. These verified winners are broadcast,
   and their copies are answered map-side, without a shuffle.
4. The remaining digests, none of which is frequent, are grouped by an ordinary shuffle.

Edge cases: a null text is an empty text; of rows with equal id and text one stays; a null id loses against any
other id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faktorium.llm.texts import lower_ascii, only, row_hash, whole_row
from faktorium.session import work_path

COUNTERS = 2048


def digests(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``digest`` (SHA-256 of the text with A-Z lower-cased) per row."""
    normalised = lower_ascii(F.col(f"`{text}`"))
    return only(documents, doc_id=doc_id, digest=F.unhex(F.sha2(normalised.cast("binary"), 256)))


def misra_gries(counters: int):
    """A ``mapInPandas`` function: the Misra-Gries summary of the digests of one task."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[bytes, int] = {}
        for batch in batches:
            for digest, n in batch["digest"].map(bytes).value_counts().items():
                kept[digest] = kept.get(digest, 0) + n
            if len(kept) > counters:
                # Take the (counters + 1)-th largest count off every counter: what is left fits.
                cut = sorted(kept.values(), reverse=True)[counters]
                kept = {k: n - cut for k, n in kept.items() if n > cut}
        yield pd.DataFrame({"digest": list(kept), "n": pd.Series(list(kept.values()), dtype="int64")})

    return summarise


def frequent(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Digest, copies and best row of the verified heavy hitters: at most ``counters`` rows."""
    total = rows.count()
    summaries = rows.select("digest").mapInPandas(misra_gries(counters), "digest binary, n long")
    candidates = (
        summaries.groupBy("digest").agg(F.sum("n").alias("n"))
        .where((F.col("n") * counters >= total) & (F.col("n") > 1)).select("digest")
    )
    return (
        rows.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row_no")).alias("best"))
    )


def find_copies(
    spark: SparkSession, documents: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """One row per document: ``doc_id, row_no, digest, keep_id, group_size, kept``."""
    path = work_path(spark, "digests")
    digests(documents, doc_id, text).withColumn("row_no", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    winners_path = work_path(spark, "frequent")
    frequent(rows, counters).write.parquet(winners_path)
    winners = spark.read.parquet(winners_path)
    heavy = rows.join(F.broadcast(winners), "digest")
    light = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    best = light.groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row_no")).alias("best")
    )
    both = heavy.unionByName(light.join(best, "digest"))
    return both.select(
        "doc_id", "row_no", "digest", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row_no") == F.col("best.row_no")).alias("kept"),
    )


def drop_copies(
    spark: SparkSession, documents: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """The documents without their exact copies, all columns kept.

    Copies of frequent texts are removed map-side by the broadcast winners; the other documents meet by digest in one
    ordinary shuffle and the row with the largest id stays; of rows of that id the one with the smallest hash of all its
    columns, so that the result doesn't depend on where rows lie. No group of that shuffle has more than about
    2 * rows / ``counters`` rows.
    """
    path = work_path(spark, "digests")
    digests(documents, doc_id, text).withColumn("row_no", F.monotonically_increasing_id()).write.parquet(path)
    winners_path = work_path(spark, "frequent")
    frequent(spark.read.parquet(path), counters).select("digest", F.col("best.doc_id").alias("keep_id")).write.parquet(winners_path)
    winners = F.broadcast(spark.read.parquet(winners_path))

    normalised = lower_ascii(F.col(f"`{text}`"))
    marked = documents.select(
        whole_row(documents).alias("row"), F.col(f"`{doc_id}`").alias("id"),
        F.unhex(F.sha2(normalised.cast("binary"), 256)).alias("digest"), row_hash(documents).alias("tie"),
    )
    best = marked.join(winners, "digest").where(F.col("id").eqNullSafe(F.col("keep_id")))
    heavy = best.groupBy("digest").agg(F.min_by("row", "tie").alias("row"))
    light = marked.join(winners, "digest", "left_anti")
    order = Window.partitionBy("digest").orderBy(F.col("id").desc_nulls_last(), "tie")
    light = light.withColumn("place", F.row_number().over(order)).where("place = 1")
    return light.select("row.*").unionByName(heavy.select("row.*"))
