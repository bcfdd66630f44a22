"""Ordered window operators that stay distributed when one group is very large.

A window function sends a whole group to one task, but one seller, package or
correlation id may hold a large share of all rows.  So every group is cut into
consecutive *buckets*, named by integer expressions that grow with the window
order.  Results are computed inside a bucket and then shifted by what the
earlier buckets of the group add up to.

One pass over the key columns alone sums up the buckets; one pass over the rows
computes the window.  Bucket sums and rows are partitioned by the same key, so
the rows are exchanged once.  The key is a struct: null group values are one
group, as in a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WHOLE = (Window.unboundedPreceding, Window.currentRow)


def _bucketed(df: DataFrame, group: Sequence[str], split_by: Sequence[Column]) -> DataFrame:
    """Add ``_bucket``: the group and the place of the row's bucket in it."""
    places = [e.cast("long").alias(f"_place_{i}") for i, e in enumerate(split_by)]
    return df.withColumn("_bucket", F.struct(F.struct(*group).alias("group"), *places))


def _earlier(sums: DataFrame, value: str) -> DataFrame:
    """``_bucket, _before``: the sum of ``value`` over the earlier buckets of the group."""
    before = Window.partitionBy("_bucket.group").orderBy("_bucket").rowsBetween(*WHOLE)
    return sums.select("_bucket", (F.sum(value).over(before) - F.col(value)).alias("_before"))


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], split_by: Sequence[Column], out: str) -> DataFrame:
    """``row_number()`` from 1 inside ``group`` in the given order."""
    rows = _bucketed(df, group, split_by)
    sizes = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    local = rows.withColumn(out, F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)).cast("long"))
    shifted = local.join(_earlier(sizes, "_n"), "_bucket")
    return shifted.withColumn(out, F.col(out) + F.col("_before")).drop("_bucket", "_before")


def running_sum(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], split_by: Sequence[Column], value: str, out: str
) -> DataFrame:
    """Running sum of an integer column, current row included."""
    rows = _bucketed(df, group, split_by)
    sums = rows.groupBy("_bucket").agg(F.sum(value).alias("_n"))
    window = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(*WHOLE)
    shifted = rows.withColumn(out, F.sum(value).over(window)).join(_earlier(sums, "_n"), "_bucket")
    return shifted.withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0))).drop("_bucket", "_before")


def previous_value(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], split_by: Sequence[Column], value: str, out: str
) -> DataFrame:
    """``lag(value)``: the value of the row before, null on the first row of a group."""
    rows = _bucketed(df, group, split_by)
    window = Window.partitionBy("_bucket").orderBy(*order)
    local = rows.withColumn(out, F.lag(value).over(window)).withColumn("_first", F.row_number().over(window) == 1)
    lasts = rows.groupBy("_bucket").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    before = Window.partitionBy("_bucket.group").orderBy("_bucket")
    joined = local.join(lasts.select("_bucket", F.lag("_last").over(before).alias("_last")), "_bucket")
    return joined.withColumn(out, F.when(F.col("_first"), F.col("_last")).otherwise(F.col(out))).drop("_first", "_last", "_bucket")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key as an aggregate, so that copies are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_first"))
    return first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in [*order, *rest]]).select(*df.columns)


def explode_items(df: DataFrame, keep: Sequence[str], array: str | Column, item: str, position: str | None = None) -> DataFrame:
    """One row per array item, in a form that computes the array once.

    For a plain ``explode`` the optimizer infers a filter on the array and
    pushes it below the projection that built it, which would parse or validate
    every document a second time.
    """
    if position is None:
        rows = df.select(*keep, F.explode_outer(array).alias(item))
    else:
        rows = df.select(*keep, F.posexplode_outer(array).alias(position, item))
    return rows.where(F.col(item).isNotNull())
