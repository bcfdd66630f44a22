"""Corrections, advances and changed parties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faktorium.functions.money import from_grosze
from faktorium.operators import skew
from faktorium.operators.chains import find_roots


def correction_delta(lines: DataFrame, by: Sequence[str] = ("invoice_id", "line_no")) -> DataFrame:
    """After minus before; ``before_correction`` marks the old state of a line."""
    signed = [
        F.sum(F.when(F.col("before_correction"), -F.col(f"{c}_gr")).otherwise(F.col(f"{c}_gr"))).alias(f"{c}_gr")
        for c in ("net", "tax", "gross")
    ]
    sums = lines.groupBy(*by).agg(*signed)
    return sums.select(*by, *[from_grosze(F.col(f"{c}_gr")).alias(f"{c}_delta") for c in ("net", "tax", "gross")])


def correction_running_balance(documents: DataFrame) -> DataFrame:
    """Original plus all corrections so far, in date order.

    ``documents`` has ``original_id, document_id (bigint), issue_date, gross_gr``.
    """
    summed = skew.running_sum(
        documents,
        ["original_id"],
        [F.col("issue_date"), F.col("document_id")],
        [F.datediff("issue_date", F.lit("1970-01-01")), F.floor(F.col("document_id") / 1_000_000)],
        "gross_gr",
        "balance_gr",
    )
    return summed.withColumn("balance", from_grosze(F.col("balance_gr"))).drop("balance_gr")


def correction_effect_date(kind: Column, original_date: Column, correction_date: Column) -> Column:
    """1: date of the original, 2: date of the correction, 3: other (null, for review)."""
    return F.when(kind == "1", original_date).when(kind == "2", correction_date)


def link_corrections(corrections: DataFrame, originals: DataFrame) -> DataFrame:
    """Find the corrected invoice by clearance number, else by seller, number and date.

    Corrections carry ``correction_id, ref_clearance, seller_nip, ref_number,
    ref_date``; originals ``invoice_id, clearance_number, seller_nip, number,
    issue_date``.  A missing clearance number becomes a key of its own, so that
    such rows spread over all partitions.
    """
    by_number = originals.select(
        F.col("clearance_number").alias("_key"), F.col("invoice_id").alias("_by_number"), F.col("issue_date").alias("_d1")
    )
    by_triple = originals.select(
        "seller_nip", F.col("number").alias("ref_number"), F.col("issue_date").alias("ref_date"),
        F.col("invoice_id").alias("_by_triple"),
    )
    keyed = corrections.withColumn(
        "_key", F.coalesce("ref_clearance", F.concat(F.lit("none:"), F.col("correction_id").cast("string")))
    )
    linked = keyed.join(by_number, "_key", "left").join(by_triple, ["seller_nip", "ref_number", "ref_date"], "left")
    how = F.when(F.col("_by_number").isNotNull(), "clearance").when(F.col("_by_triple").isNotNull(), "number")
    return linked.select(
        *corrections.columns,
        F.coalesce("_by_number", "_by_triple").alias("original_id"),
        F.coalesce("_d1", F.when(F.col("_by_triple").isNotNull(), F.col("ref_date"))).alias("original_date"),
        F.coalesce(how, F.lit("none")).alias("linked_by"),
    )


def correction_chains(spark: SparkSession, linked: DataFrame) -> DataFrame:
    """The invoice that each correction goes back to: ``root_id``, ``depth`` and ``is_cycle`` next to the columns of ``linked``.

    ``linked`` is what ``link_corrections`` gives when the originals include the
    corrections themselves, under their ``correction_id``.  A correction that is
    linked to nothing has no root and depth 0; one whose chain goes in circles
    has no root either and is reported.
    """
    roots = find_roots(spark, linked, "correction_id", "original_id")
    joined = linked.join(roots, "correction_id", "left")
    return joined.select(
        *linked.columns, F.col("root").alias("root_id"), F.when(F.col("is_cycle"), None).otherwise(F.coalesce("steps", F.lit(0))).alias("depth"),
        F.coalesce("is_cycle", F.lit(False)).alias("is_cycle"),
    )


def link_advances(final: DataFrame, advances: DataFrame) -> DataFrame:
    """Advance invoices of every settlement invoice: ``final`` has ``invoice_id, advance_refs``."""
    refs = final.select("invoice_id", F.explode("advance_refs").alias("reference"))
    return refs.join(advances, "reference", "left")


def link_changed_buyers(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("invoice_id", "link_id")) -> DataFrame:
    """Buyer before and after the correction, joined on the buyer link id."""
    old = before.select(*keys, F.col("buyer").alias("buyer_before"))
    new = after.select(*keys, F.col("buyer").alias("buyer_after"))
    return old.join(new, list(keys)).withColumn("is_changed", F.col("buyer_before") != F.col("buyer_after"))
