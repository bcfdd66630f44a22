"""Sessions, submissions, receipts, duplicates and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faktorium.operators import skew


def with_lines(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    return invoices.join(lines, "invoice_id")


def with_parties(invoices: DataFrame, sellers: DataFrame, buyers: DataFrame) -> DataFrame:
    """Seller and buyer data by id; parties grow with the data, so the size decides about a broadcast."""
    return invoices.join(sellers, "seller_id", "left").join(buyers, "buyer_id", "left")


def session_processed(session_status: DataFrame) -> DataFrame:
    """Sessions whose success count is present and positive."""
    return session_status.where(F.col("successful_count").isNotNull() & (F.col("successful_count") > 0))


def receipt_ready(session_status: DataFrame) -> DataFrame:
    return session_status.where(F.col("status_code") == 200)


def session_counts(invoice_status: DataFrame) -> DataFrame:
    """Total, accepted and rejected per session.

    ``any_accepted`` is true from the first success on; ``all_processed`` needs
    a final state for every invoice.
    """
    counts = invoice_status.groupBy("session_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("state") == "accepted").alias("accepted"),
        F.count_if(F.col("state") == "rejected").alias("rejected"),
    )
    return counts.withColumn("any_accepted", F.col("accepted") > 0).withColumn(
        "all_processed", F.col("accepted") + F.col("rejected") == F.col("total")
    )


def reconcile_submissions(invoices: DataFrame, invoice_status: DataFrame, receipts: DataFrame) -> DataFrame:
    """Submitted, then clearance number, then receipt, with the first gap named.

    ``invoices``: ``reference``; ``invoice_status``: ``reference, status_code,
    clearance_number``; ``receipts``: ``clearance_number, receipt_id``.
    """
    with_status = invoices.join(invoice_status, "reference", "left")
    # Rows without a clearance number get a key of their own instead of one shared null.
    keyed = with_status.withColumn(
        "_key", F.coalesce("clearance_number", F.concat(F.lit("none:"), F.col("reference").cast("string")))
    )
    found = keyed.join(receipts.withColumnRenamed("clearance_number", "_key"), "_key", "left").drop("_key")
    outcome = (
        F.when(F.col("status_code").isNull(), "no status")
        .when(F.col("clearance_number").isNull(), "rejected")
        .when(F.col("receipt_id").isNull(), "no receipt")
        .otherwise("complete")
    )
    return found.withColumn("outcome", outcome)


def keep_first_submission(submissions: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the earliest."""
    return skew.first_per_key(submissions, keys, order)


def first_document(documents: DataFrame, scope: str, order: Sequence[str]) -> DataFrame:
    """The first document (or receipt page) of every session."""
    return skew.first_per_key(documents, [scope], order)


first_receipt_page = first_document


def duplicate_groups(submissions: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their first row and the number of extra copies."""
    # A single column stays a hash aggregate; a minimum over a struct has to sort.
    single = len(order) == 1
    first = F.min(order[0]) if single else F.min(F.struct(*order))
    grouped = submissions.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), first.alias("_first"))
    found = {c: F.col("_first") if single else F.col(f"_first.{c}") for c in order}
    return grouped.where("_n > 1").select(
        *keys, (F.col("_n") - 1).alias("copies"), *[column.alias(f"first_{c}") for c, column in found.items()]
    )


def find_duplicates(submissions: DataFrame, scope: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """All rows after the first of their key inside a session or package.

    The first row comes from an aggregate; only keys with copies are joined
    back, and adaptive execution splits a key that holds many copies.
    """
    names = [scope, *keys]
    groups = duplicate_groups(submissions, names, order)
    first = F.struct(*[F.col(f"first_{c}") for c in order])
    joined = submissions.join(groups, names)
    return joined.where(F.struct(*[F.col(c) for c in order]) > first).select(*submissions.columns)


def not_in_code_list(df: DataFrame, value: str, list_name: str, code_list: DataFrame) -> DataFrame:
    """Rows whose value is not in the code list; code lists have a fixed, small size."""
    allowed = code_list.where(F.col("list") == list_name).select(F.col("value").alias(value))
    return df.join(F.broadcast(allowed), value, "left_anti")


def with_error_text(df: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Catalogue text of the error codes; Spark broadcasts the catalogue when its size allows."""
    return df.join(catalogue.select(F.col("code").alias("error_code"), F.col("text").alias("error_text")), "error_code", "left")


def compare_expected(actual: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer, null-safe comparison: one row per key with the fields that differ."""
    fields = [c for c in expected.columns if c not in keys]
    left = actual.select(*keys, F.struct(*fields).alias("_actual"))
    right = expected.select(*keys, F.struct(*fields).alias("_expected"))
    joined = left.join(right, list(keys), "full_outer")
    differs = F.filter(
        F.array(*[F.when(~F.col(f"_actual.{c}").eqNullSafe(F.col(f"_expected.{c}")), c) for c in fields]),
        lambda x: x.isNotNull(),
    )
    state = (
        F.when(F.col("_expected").isNull(), "unexpected").when(F.col("_actual").isNull(), "missing")
        .when(F.size(differs) > 0, "different").otherwise("equal")
    )
    return joined.select(*keys, state.alias("state"), F.array_join(differs, ",").alias("fields"))


def compare_outcome(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Expected against actual acceptance (``passed`` and ``should_pass``)."""
    joined = expected.join(actual, key, "left")
    return joined.withColumn("as_expected", F.col("passed").eqNullSafe(F.col("should_pass")))


def golden_diff(actual: DataFrame, golden: DataFrame) -> DataFrame:
    """Rows that only one side has, copies counted: one signed count per distinct row."""
    columns = golden.columns
    signed = actual.select(*columns, F.lit(1).alias("_n")).unionByName(golden.withColumn("_n", F.lit(-1)))
    excess = signed.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    copies = excess.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_n"))))
    return copies.select(*columns, F.when(F.col("_n") > 0, "actual").otherwise("golden").alias("side"))


def union_sources(*sources: DataFrame) -> DataFrame:
    """Canonical invoices of all formats; absent columns become null."""
    first, *rest = sources
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def row_key(*columns: str) -> Column:
    return F.concat_ws("|", *columns)
