"""Line arithmetic, VAT totals and VAT buckets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faktorium import codes
from faktorium.functions.money import from_grosze, multiply_quantity, tax_grosze
from faktorium.operators import skew


def _times(df: DataFrame, unit: Column) -> Column:
    """Unit amount times quantity; whole quantities stay in integer arithmetic."""
    if isinstance(df.schema["quantity"].dataType, T.IntegralType):
        return unit * F.col("quantity")
    return multiply_quantity(unit, F.col("quantity"))


def line_amounts(lines: DataFrame, mode: str = "per_unit") -> DataFrame:
    """Net, VAT and gross of every line in grosze.

    ``per_unit`` rounds VAT on the unit price and multiplies; ``per_line`` takes
    the discount off the unit price and rounds VAT on the line.
    """
    if mode == "per_unit":
        unit_tax = tax_grosze(F.col("unit_net_gr"), F.col("rate"))
        return (
            lines.withColumn("net_gr", _times(lines, F.col("unit_net_gr")))
            .withColumn("tax_gr", _times(lines, unit_tax))
            .withColumn("gross_gr", _times(lines, F.col("unit_net_gr") + unit_tax))
        )
    if mode == "per_line":
        net = _times(lines, F.col("unit_net_gr") - F.coalesce("unit_discount_gr", F.lit(0)))
        return (
            lines.withColumn("net_gr", net)
            .withColumn("tax_gr", tax_grosze(F.col("net_gr"), F.col("rate")))
            .withColumn("gross_gr", F.col("net_gr") + F.col("tax_gr"))
        )
    raise ValueError(f"unknown mode {mode}")


def _sums(*names: str) -> list[Column]:
    return [F.sum(f"{n}_gr").alias(f"{n}_gr") for n in names]


def _as_amounts(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, from_grosze(F.col(f"{name}_gr"))).drop(f"{name}_gr")
    return df


def invoice_totals(lines: DataFrame) -> DataFrame:
    """Sum of net, VAT and gross per invoice."""
    return _as_amounts(lines.groupBy("invoice_id").agg(*_sums("net", "tax", "gross")), "net", "tax", "gross")


def vat_summary(lines: DataFrame) -> DataFrame:
    """Net, VAT and gross per invoice and VAT code."""
    grouped = lines.groupBy("invoice_id", "vat_code").agg(*_sums("net", "tax", "gross"))
    return _as_amounts(grouped, "net", "tax", "gross")


def vat_summary_with_total(lines: DataFrame) -> DataFrame:
    """One "of which" row per VAT code and one "total" row per invoice.

    Lines are summed per code first, so the grouping sets expand the small
    result and not the lines.
    """
    per_code = lines.groupBy("invoice_id", "vat_code").agg(*_sums("net", "tax", "gross"))
    both = per_code.groupingSets(
        [[F.col("invoice_id"), F.col("vat_code")], [F.col("invoice_id")]], F.col("invoice_id"), F.col("vat_code")
    ).agg(F.grouping("vat_code").cast("int").alias("is_total"), *_sums("net", "tax", "gross"))
    labelled = both.withColumn("row_kind", F.when(F.col("is_total") == 1, "total").otherwise("of which"))
    return _as_amounts(labelled.drop("is_total"), "net", "tax", "gross")


def bucket_of(vat_code: Column, override: Column | None = None) -> Column:
    """Summary bucket of a VAT code; a line may name its own bucket."""
    mapped = F.element_at(codes.literal_map(codes.VAT_BUCKETS), vat_code)
    return F.coalesce(override, mapped) if override is not None else mapped


def bucket_sums(bucket: Column, absent: Column | None = None) -> list[Column]:
    """Net and VAT sums per bucket, ``p_13_<bucket>_gr`` and ``p_14_<bucket>_gr``; ``absent`` stands for a bucket without lines."""
    columns: list[Column] = []
    for name in codes.BUCKETS:
        for kind, amount in ((13, "net_gr"), (14, "tax_gr")):
            if kind == 13 or name in codes.TAXED_BUCKETS:
                total = F.sum(F.when(bucket == name, F.col(amount)))
                columns.append((total if absent is None else F.coalesce(total, absent)).alias(f"p_{kind}_{name}_gr"))
    return columns


def vat_buckets(lines: DataFrame, override: str | None = None) -> DataFrame:
    """Wide row of net and VAT sums per bucket, absent buckets as zero.

    VAT of a bucket is the sum of the line VAT; conditional sums need one
    exchange on the invoice id.
    """
    marked = lines.withColumn("_bucket", bucket_of(F.col("vat_code"), F.col(override) if override else None))
    columns = bucket_sums(F.col("_bucket"), F.lit(0).cast("long"))
    wide = marked.groupBy("invoice_id").agg(*columns, F.sum("gross_gr").alias("p_15_gr"))
    return _as_amounts(wide, *[c[:-3] for c in wide.columns if c.endswith("_gr")])


def bucket_tax_columns(rates: Sequence[int]) -> list[Column]:
    """Net per rate as conditional sums: ``net_<rate>``."""
    return [F.sum(F.when(F.col("rate") == r, F.col("net_gr")).otherwise(0)).alias(f"net_{r}") for r in rates]


def vat_residual(lines: DataFrame) -> DataFrame:
    """Difference between summed per-unit VAT and VAT on the summed net per rate."""
    rates = codes.TAX_RATES
    sums = lines.groupBy("invoice_id").agg(F.sum("tax_gr").alias("line_tax_gr"), *bucket_tax_columns(rates))
    bucket = sum((tax_grosze(F.col(f"net_{r}"), F.lit(r)) for r in rates), F.lit(0).cast("long"))
    out = sums.withColumn("bucket_tax_gr", bucket).withColumn(
        "residual_gr", F.col("line_tax_gr") - F.col("bucket_tax_gr")
    )
    return _as_amounts(
        out.select("invoice_id", "line_tax_gr", "bucket_tax_gr", "residual_gr"), "line_tax", "bucket_tax", "residual"
    )


def ubl_tax_totals(lines: DataFrame, payments: DataFrame) -> DataFrame:
    """UBL totals: tax subtotals per category and rate, and the monetary total.

    ``payments`` has ``invoice_id`` and ``paid_gr``.
    """
    category = F.element_at(codes.literal_map(codes.UBL_CATEGORIES), F.col("vat_code"))
    subtotals = lines.groupBy("invoice_id", category.alias("category"), "rate").agg(*_sums("net", "tax"))
    per_invoice = subtotals.groupBy("invoice_id").agg(
        F.sum("net_gr").alias("line_extension_gr"),
        F.sum("tax_gr").alias("tax_total_gr"),
        # bounded by the number of category and rate pairs
        F.sort_array(F.collect_list(F.struct("category", "rate", "net_gr", "tax_gr"))).alias("subtotals"),
    )
    joined = per_invoice.join(payments, "invoice_id", "left").withColumn("paid_gr", F.coalesce("paid_gr", F.lit(0)))
    inclusive = F.col("line_extension_gr") + F.col("tax_total_gr")
    return joined.select(
        "invoice_id",
        from_grosze(F.col("tax_total_gr")).alias("tax_amount"),
        "subtotals",
        from_grosze(F.col("line_extension_gr")).alias("tax_exclusive"),
        from_grosze(inclusive).alias("tax_inclusive"),
        from_grosze(F.col("paid_gr")).alias("prepaid"),
        from_grosze(inclusive - F.col("paid_gr")).alias("payable"),
    )


def number_lines(
    lines: DataFrame, order: Sequence[str], split_by: Sequence[Column]
) -> DataFrame:
    """Ordinal of a line inside its invoice, from 1."""
    return skew.number_rows(lines, ["invoice_id"], [F.col(c) for c in order], split_by, "line_no")


def nest_lines(lines: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Lines as an ordered array per invoice.

    An invoice is one document and so one row, however long; one beyond the
    limit of the schema is reported by the cardinality rules.
    """
    ordered = F.sort_array(F.collect_list(F.struct("line_no", *[f for f in fields if f != "line_no"])))
    return lines.groupBy("invoice_id").agg(ordered.alias("positions"))


def nest_in_order(lines: DataFrame, order: Sequence[str], fields: Mapping[str, Column], sums: Sequence[Column] = ()) -> DataFrame:
    """Lines as an array ``positions`` in a complete order, next to other aggregates of the invoice.

    The array is sorted where it is built, so the lines are exchanged once and
    need no numbers before; lines that tie in ``order`` come in the order of ``fields``.
    """
    line = F.struct(*order, F.struct(*[c.alias(n) for n, c in fields.items()]).alias("_fields"))
    nested = lines.groupBy("invoice_id").agg(F.sort_array(F.collect_list(line)).alias("_lines"), *sums)
    return nested.withColumn("positions", F.col("_lines._fields")).drop("_lines")


def explode_lines(nested: DataFrame, keep: Sequence[str] = ("invoice_id",)) -> DataFrame:
    """One row per position, numbered from 1 in array order."""
    rows = skew.explode_items(nested, keep, "positions", "_line", "_pos")
    fields = [f for f in rows.schema["_line"].dataType.names if f != "line_no"]
    return rows.select(*keep, (F.col("_pos") + 1).cast("long").alias("line_no"), *[F.col(f"_line.{f}") for f in fields])
