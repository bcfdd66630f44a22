"""The given tables seen as invoices, lines, logs and sessions.

Every builder has an SQL counterpart below it; both must stay identical.
Amounts are whole grosze (bigint) until the last projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faktorium.functions.money import divide_half_up

# Complete order of the lines of an invoice: two rows that tie are identical.
LINE_ORDER = [
    "raw_line_no", "supplier_id", "part_id", "quantity", "ext_gr",
    "discount_pct", "tax_index", "ship_date", "return_flag", "line_status",
]

# What of it tells lines apart that differ in article, quantity, amounts or VAT code; the rest orders equal positions.
POSITION_ORDER = LINE_ORDER[: LINE_ORDER.index("tax_index") + 1]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shift_years(date: Column) -> Column:
    """Move the order dates into the range that the invoice schema allows."""
    return F.add_months(date.cast("date"), 144)


def cents(amount: Column) -> Column:
    """Doubles that hold two decimals to whole hundredths; the nearest integer is never a tie."""
    return F.rint(amount * 100).cast("long")


def vat_code_of(index: Column) -> Column:
    return (
        F.when(index == 0, "0").when(index == 1, "23").when(index == 2, "22").when(index == 6, "zw")
        .otherwise(index.cast("string"))
    )


def invoice_lines(spark: SparkSession, sf_dir: str, by_invoice: bool = False) -> DataFrame:
    """All lines; ``by_invoice`` brings those of an invoice together before anything is derived from them, so that only the given columns are exchanged."""
    source = read_table(spark, sf_dir, "lineitem")
    index = cents(F.col("l_tax")).cast("int")
    quantity = F.col("l_quantity").cast("long")
    base = source.select(
        F.col("l_orderkey").alias("invoice_id"),
        F.col("l_linenumber").cast("long").alias("raw_line_no"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supplier_id"),
        quantity.alias("quantity"),
        cents(F.col("l_extendedprice")).alias("ext_gr"),
        cents(F.col("l_discount")).alias("discount_pct"),
        index.alias("tax_index"),
        shift_years(F.col("l_shipdate")).alias("ship_date"),
        F.col("l_returnflag").alias("return_flag"),
        F.col("l_linestatus").alias("line_status"),
    )
    if by_invoice:
        base = base.repartition("invoice_id")
    code = vat_code_of(F.col("tax_index"))
    unit = divide_half_up(F.col("ext_gr"), F.col("quantity"))
    return (
        base.withColumn("unit_net_gr", unit)
        .withColumn("unit_discount_gr", divide_half_up(F.col("unit_net_gr") * F.col("discount_pct"), F.lit(100)))
        .withColumn("vat_code", code)
        .withColumn("rate", F.when(code == "zw", 0).otherwise(code.cast("int")).cast("long"))
        .withColumn("annex15", F.col("part_id") % 10 == 0)
    )


LINES_SQL = """
l0 AS (
  SELECT l_orderkey AS invoice_id, CAST(l_linenumber AS BIGINT) AS raw_line_no, l_partkey AS part_id,
         l_suppkey AS supplier_id, CAST(l_quantity AS BIGINT) AS quantity,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS ext_gr,
         CAST(round(l_discount * 100) AS BIGINT) AS discount_pct,
         CAST(round(l_tax * 100) AS INTEGER) AS tax_index,
         CAST(CAST(l_shipdate AS DATE) + INTERVAL 12 YEAR AS DATE) AS ship_date,
         l_returnflag AS return_flag, l_linestatus AS line_status
  FROM lineitem),
l1 AS (
  SELECT *, (2 * ext_gr + quantity) // (2 * quantity) AS unit_net_gr,
         CASE tax_index WHEN 0 THEN '0' WHEN 1 THEN '23' WHEN 2 THEN '22' WHEN 6 THEN 'zw'
              ELSE CAST(tax_index AS VARCHAR) END AS vat_code,
         CAST(CASE tax_index WHEN 1 THEN 23 WHEN 2 THEN 22 WHEN 6 THEN 0 ELSE tax_index END AS BIGINT) AS rate,
         part_id % 10 = 0 AS annex15
  FROM l0),
lines AS (
  SELECT *, (2 * unit_net_gr * discount_pct + 100) // 200 AS unit_discount_gr FROM l1)
"""

LINE_ORDER_SQL = ", ".join(LINE_ORDER)

# Per-unit amounts of a line: VAT is rounded on the unit, then multiplied.
AMOUNTS_SQL = LINES_SQL + """,
amounts AS (
  SELECT *, unit_net_gr * quantity AS net_gr,
         ((unit_net_gr * rate * 2 + 100) // 200) * quantity AS tax_gr,
         (unit_net_gr + (unit_net_gr * rate * 2 + 100) // 200) * quantity AS gross_gr
  FROM lines)
"""

NUMBERED_SQL = AMOUNTS_SQL + f""",
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY {LINE_ORDER_SQL}) AS line_no FROM amounts)
"""


def invoice_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    issue = shift_years(F.col("o_orderdate"))
    return orders.select(
        F.col("o_orderkey").alias("invoice_id"),
        F.col("o_custkey").alias("customer_id"),
        issue.alias("issue_date"),
        F.col("o_orderstatus").alias("status"),
        cents(F.col("o_totalprice")).alias("declared_gr"),
        F.when(F.col("o_custkey") % 5 == 0, "EUR").otherwise("PLN").alias("currency"),
        (F.lit(7310000000).cast("long") + F.col("o_custkey")).cast("string").alias("buyer_nip"),
    )


HEADERS_SQL = """
headers AS (
  SELECT o_orderkey AS invoice_id, o_custkey AS customer_id,
         CAST(CAST(o_orderdate AS DATE) + INTERVAL 12 YEAR AS DATE) AS issue_date, o_orderstatus AS status,
         CAST(round(o_totalprice * 100) AS BIGINT) AS declared_gr,
         CASE WHEN o_custkey % 5 = 0 THEN 'EUR' ELSE 'PLN' END AS currency,
         CAST(7310000000 + o_custkey AS VARCHAR) AS buyer_nip
  FROM orders)
"""


def seller_nip(supplier_id: Column) -> Column:
    return (F.lit(1230000000).cast("long") + supplier_id).cast("string")


# A minimum over a struct would sort all lines; over one decimal it is a hash
# aggregate.  Line number and supplier share 38 digits without overlap.
_SHIFT = 10**19


def first_supplier() -> Column:
    """Aggregate: packed line number and supplier of the first line."""
    packed = F.col("raw_line_no").cast("decimal(18,0)") * F.lit(str(_SHIFT)).cast("decimal(20,0)")
    return F.min((packed + F.col("supplier_id").cast("decimal(19,0)")).cast("decimal(38,0)"))


def supplier_of(packed: Column) -> Column:
    return (packed % F.lit(str(_SHIFT)).cast("decimal(20,0)")).cast("long")


def money_sql(expression: str) -> str:
    """SQL text that turns grosze into DECIMAL(18,2) without a division."""
    return f"CAST(CAST({expression} AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(2,2)) AS DECIMAL(18,2))"


def totals_sql() -> str:
    """Headers joined to summed lines and the seller of the first line."""
    return (
        NUMBERED_SQL
        + ","
        + HEADERS_SQL
        + """,
sums AS (
  SELECT invoice_id, CAST(sum(net_gr) AS BIGINT) AS net_gr, CAST(sum(tax_gr) AS BIGINT) AS tax_gr,
         CAST(sum(gross_gr) AS BIGINT) AS gross_gr, count(*) AS line_count,
         CAST(1230000000 + min(CASE WHEN line_no = 1 THEN supplier_id END) AS VARCHAR) AS seller_nip
  FROM numbered GROUP BY invoice_id),
invoices AS (
  SELECT h.*, s.net_gr, s.tax_gr, s.gross_gr, s.line_count, s.seller_nip
  FROM headers h JOIN sums s ON h.invoice_id = s.invoice_id)
"""
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header rows with totals; the seller is the supplier of the first line."""
    from faktorium.operators.lines import line_amounts

    lines = line_amounts(invoice_lines(spark, sf_dir))
    sums = lines.groupBy("invoice_id").agg(
        F.sum("net_gr").alias("net_gr"),
        F.sum("tax_gr").alias("tax_gr"),
        F.sum("gross_gr").alias("gross_gr"),
        F.count(F.lit(1)).alias("line_count"),
        first_supplier().alias("_first"),
    )
    sums = sums.withColumn("seller_nip", seller_nip(supplier_of(F.col("_first")))).drop("_first")
    return invoice_headers(spark, sf_dir).join(sums, "invoice_id")
