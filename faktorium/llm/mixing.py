"""Mixing sources to target weights by systematic sampling.

Every source gets a target in words; its documents all expect ``target / size of the source`` copies. Within a source
the expected copies are summed in a fixed order (size class, then a hash of the id), one random offset per source is
added, and a document is emitted once for each integer that its interval crosses. Documents of a size class are
neighbours in that order, so each class is taken in proportion and the words taken come near the target.

The prefix sums are split: a source is cut into consecutive buckets (size class, then leading digits of the hash), the
sum inside a bucket is a window of bounded length and the sums of the earlier buckets come from a small table. So a
source that holds most of all rows is spread over as many tasks as it has buckets. All sums are integers, in parts of
``UNIT`` per copy, so that the result doesn't depend on the order of additions.

Edge cases: a null text has size 0; null is a source of its own, ordered last; a source without words gets nothing; a
null id hashes as an empty one; rows that repeat id and size are ordered by a hash of
all their columns; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faktorium.llm.texts import row_hash, whole_row

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
UNIT = 100_000_000
SEED = "mix-1"
HASH_DIGITS = 2  # 256 buckets per source and size class


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def size_class(size: Column) -> Column:
    """Number of binary digits and the first three of them: four classes per doubling, in order of size."""
    digits = F.bin(size)
    return F.length(digits) * 1000 + F.substring(digits, 1, 3).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Add ``target`` to a table of ``source, source_size`` (one row per source).

    Sources in code point order, null last, take the weights in turn. A target stops at ``max_repeat`` times the size
    of its source and the excess is shared again by weight; the fixed point of that has one level for all sources
    below their limit. With the sources in the order of limit / weight the level is found by running sums.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeat)
    everything = Window.partitionBy(F.lit(0))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("all_words", F.sum("source_size").over(everything))
        .withColumn("all_weights", F.sum("weight").over(everything))
        .withColumn("rest", F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("rest_weight", F.col("all_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("rest") / F.col("rest_weight"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("place", F.row_number().over(filling))
        .withColumn("final", F.min(F.when(F.col("fits"), F.struct("place", "level"))).over(everything)["level"])
    )
    return rows.select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.col("final") * F.col("weight")).alias("target")
    )


def copies(
    sized: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "size",
    weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED,
) -> DataFrame:
    """``row`` (all columns of ``sized``), ``source_size``, ``target`` (both of the row's source) and ``copies``."""
    source_column, id_text = F.col(f"`{source}`").cast("string"), F.col(f"`{doc_id}`").cast("string")
    rows = sized.select(
        whole_row(sized).alias("row"), F.col(f"`{size}`").alias("_size"), id_text.alias("_id"),
        F.coalesce(F.concat(F.lit("s"), source_column), F.lit("n")).alias("_key"), size_class(F.col(f"`{size}`")).alias("_class"),
        F.md5(F.coalesce(id_text, F.lit("")).cast("binary")).alias("_hash"), row_hash(sized).alias("_tie"),
    ).withColumn("_slice", F.substring("_hash", 1, HASH_DIGITS))
    bucket = ["_key", "_class", "_slice"]
    buckets = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("words"))
    sources = buckets.groupBy("_key").agg(F.sum("words").alias("source_size"))
    sources = sources.withColumn("source", F.when(F.col("_key") != "n", F.expr("substring(_key, 2)")))
    targets = source_targets(sources.select("source", "source_size"), weights, max_repeat)
    share = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0)
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce("source", F.lit(""))).cast("binary")), 1, 8)
    targets = targets.select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_key"), "source_size", "target",
        share.cast("long").alias("_expected"),
        (F.conv(digits, 16, 10).cast("long") % UNIT).alias("_offset"),
    )
    earlier = Window.partitionBy("_key").orderBy("_class", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = buckets.select(*bucket, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_rank")).join(targets, "_key")
    inside = Window.partitionBy(*bucket).orderBy("_hash", "_id", "_size", "_tie")
    joined = rows.withColumn("_before", F.row_number().over(inside) - 1).join(placed, bucket)
    # Only the part of a copy that is left over matters, so the product stays small at any number of rows.
    phase = ((F.col("_rank") + F.col("_before")) % UNIT * F.col("_expected") + F.col("_offset")) % UNIT
    crossed = F.floor((phase + F.col("_expected")) / UNIT).cast("long")
    return joined.select("row", "source_size", "target", crossed.alias("copies"))


def mix(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED,
) -> DataFrame:
    """The mixed documents: every row as often as the mix takes it, all columns kept."""
    sized = documents.select(
        whole_row(documents).alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"),
        word_count(F.col(f"`{text}`")).alias("size"),
    )
    taken = copies(sized, "doc_id", "source", "size", weights, max_repeat, seed).where("copies > 0")
    repeated = taken.select("row.row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select("row.*")
