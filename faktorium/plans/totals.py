"""Queries on line amounts, VAT summaries and settlements."""

from __future__ import annotations

from pyspark.sql import functions as F

from faktorium.functions.money import from_grosze
from faktorium.operators import lines as ops
from faktorium.plans import tables as t
from faktorium.plans.registry import query

M = t.money_sql


def _amounts(spark, sf, mode="per_unit"):
    return ops.line_amounts(t.invoice_lines(spark, sf), mode)


@query("invoice_totals", f"""
WITH {t.AMOUNTS_SQL}
SELECT invoice_id, {M('sum(net_gr)')} AS net, {M('sum(tax_gr)')} AS tax, {M('sum(gross_gr)')} AS gross
FROM amounts GROUP BY invoice_id""")
def invoice_totals(spark, sf):
    return ops.invoice_totals(_amounts(spark, sf))


@query("vat_summary", f"""
WITH {t.AMOUNTS_SQL}
SELECT invoice_id, vat_code, {M('sum(net_gr)')} AS net, {M('sum(tax_gr)')} AS tax, {M('sum(gross_gr)')} AS gross
FROM amounts GROUP BY invoice_id, vat_code""")
def vat_summary(spark, sf):
    return ops.vat_summary(_amounts(spark, sf))


@query("vat_summary_with_total", f"""
WITH {t.AMOUNTS_SQL}
SELECT invoice_id, vat_code, CASE WHEN grouping(vat_code) = 1 THEN 'total' ELSE 'of which' END AS row_kind,
       {M('sum(net_gr)')} AS net, {M('sum(tax_gr)')} AS tax, {M('sum(gross_gr)')} AS gross
FROM amounts GROUP BY GROUPING SETS ((invoice_id, vat_code), (invoice_id))""")
def vat_summary_with_total(spark, sf):
    return ops.vat_summary_with_total(_amounts(spark, sf))


@query("line_amounts_per_unit", f"""
WITH {t.AMOUNTS_SQL}
SELECT invoice_id, part_id, supplier_id, {M('net_gr')} AS net, {M('tax_gr')} AS tax, {M('gross_gr')} AS gross
FROM amounts""")
def line_amounts_per_unit(spark, sf):
    return _amounts(spark, sf).select(
        "invoice_id", "part_id", "supplier_id", *[from_grosze(F.col(f"{c}_gr")).alias(c) for c in ("net", "tax", "gross")]
    )


PER_LINE_SQL = t.LINES_SQL + """,
per_line AS (
  SELECT *, quantity * (unit_net_gr - unit_discount_gr) AS net_gr,
         (2 * quantity * (unit_net_gr - unit_discount_gr) * rate + 100) // 200 AS tax_gr
  FROM lines)
"""


@query("line_amounts_per_line", f"""
WITH {PER_LINE_SQL}
SELECT invoice_id, part_id, supplier_id, {M('net_gr')} AS net, {M('tax_gr')} AS tax,
       {M('net_gr + tax_gr')} AS gross
FROM per_line""")
def line_amounts_per_line(spark, sf):
    return _amounts(spark, sf, "per_line").select(
        "invoice_id", "part_id", "supplier_id", *[from_grosze(F.col(f"{c}_gr")).alias(c) for c in ("net", "tax", "gross")]
    )


def _bucket_sql() -> str:
    from faktorium import codes

    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in codes.VAT_BUCKETS.items())
    columns = []
    for b in codes.BUCKETS:
        columns.append(M(f"sum(CASE WHEN bucket = '{b}' THEN net_gr ELSE 0 END)") + f" AS p_13_{b}")
        if b in codes.TAXED_BUCKETS:
            columns.append(M(f"sum(CASE WHEN bucket = '{b}' THEN tax_gr ELSE 0 END)") + f" AS p_14_{b}")
    return f"""
WITH {t.AMOUNTS_SQL}, marked AS (SELECT *, CASE vat_code {cases} END AS bucket FROM amounts)
SELECT invoice_id, {', '.join(columns)}, {M('sum(gross_gr)')} AS p_15
FROM marked GROUP BY invoice_id"""


@query("vat_buckets", _bucket_sql())
def vat_buckets(spark, sf):
    return ops.vat_buckets(_amounts(spark, sf))


EVERY_CODE = ["23", "22", "8", "7", "5", "4", "3", "0", "0 KR", "0 WDT", "0 EX", "zw", "np", "np I", "np II", "oo", "taxi", "margin"]
EVERY_BUCKET = ["1", "1", "2", "2", "3", "4", "4", "6_1", "6_1", "6_2", "6_3", "7", "8", "8", "9", "10", "5", "11"]
_SUMS = ", ".join(
    M(f"sum(CASE WHEN bucket = '{b}' THEN {amount} ELSE 0 END)") + f" AS p_{kind}_{b}"
    for b in ["1", "2", "3", "4", "5", "6_1", "6_2", "6_3", "7", "8", "9", "10", "11"]
    for kind, amount in ((13, "net_gr"), (14, "tax_gr")) if kind == 13 or b in "12345"
)


@query("vat_buckets_every_code", f"""
WITH {t.AMOUNTS_SQL}, marked AS (SELECT *, {EVERY_BUCKET}[1 + part_id % 18] AS bucket FROM amounts)
SELECT invoice_id, {_SUMS}, {M('sum(gross_gr)')} AS p_15 FROM marked GROUP BY invoice_id""")
def vat_buckets_every_code(spark, sf):
    """Every VAT code, and the two buckets that a line has to name itself."""
    code = F.element_at(F.array(*[F.lit(c) for c in EVERY_CODE]), (F.col("part_id") % 18 + 1).cast("int"))
    named = F.when(F.col("vat_code") == "taxi", "5").when(F.col("vat_code") == "margin", "11")
    lines = _amounts(spark, sf).withColumn("vat_code", code).withColumn("bucket", named)
    return ops.vat_buckets(lines, "bucket")


@query("vat_residual", f"""
WITH {t.AMOUNTS_SQL},
per_rate AS (SELECT invoice_id, rate, sum(net_gr) AS net_gr, sum(tax_gr) AS tax_gr FROM amounts GROUP BY 1, 2),
per_invoice AS (
  SELECT invoice_id, sum(tax_gr) AS line_gr, sum((2 * net_gr * rate + 100) // 200) AS bucket_gr
  FROM per_rate GROUP BY 1)
SELECT invoice_id, {M('line_gr')} AS line_tax, {M('bucket_gr')} AS bucket_tax, {M('line_gr - bucket_gr')} AS residual
FROM per_invoice""")
def vat_residual(spark, sf):
    return ops.vat_residual(_amounts(spark, sf))


@query("ubl_tax_totals", f"""
WITH {t.AMOUNTS_SQL}, {t.HEADERS_SQL},
subs AS (
  SELECT invoice_id, CASE vat_code WHEN '0' THEN 'Z' WHEN 'zw' THEN 'E' ELSE 'S' END AS category, rate,
         sum(net_gr) AS net_gr, sum(tax_gr) AS tax_gr
  FROM amounts GROUP BY 1, 2, 3),
tot AS (
  SELECT invoice_id, sum(net_gr) AS net_gr, sum(tax_gr) AS tax_gr,
         string_agg(category || ':' || rate || ':' || net_gr || ':' || tax_gr, ';' ORDER BY category, rate) AS subtotals
  FROM subs GROUP BY 1)
SELECT tot.invoice_id, {M('tax_gr')} AS tax_amount, subtotals, {M('net_gr')} AS tax_exclusive,
       {M('net_gr + tax_gr')} AS tax_inclusive,
       {M("CASE WHEN status = 'F' THEN declared_gr ELSE 0 END")} AS prepaid,
       {M("net_gr + tax_gr - CASE WHEN status = 'F' THEN declared_gr ELSE 0 END")} AS payable
FROM tot JOIN headers h ON h.invoice_id = tot.invoice_id""")
def ubl_tax_totals(spark, sf):
    payments = t.invoice_headers(spark, sf).select(
        "invoice_id", F.when(F.col("status") == "F", F.col("declared_gr")).otherwise(0).alias("paid_gr")
    )
    totals = ops.ubl_tax_totals(_amounts(spark, sf), payments)
    text = F.transform("subtotals", lambda s: F.concat_ws(":", s["category"], s["rate"], s["net_gr"], s["tax_gr"]))
    return totals.withColumn("subtotals", F.array_join(text, ";"))
