"""Invoice numbers and document order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faktorium.operators import skew


def number_invoices(invoices: DataFrame, scope: str = "seller_month") -> DataFrame:
    """``n/month/year``: n counts per seller and month, or over the whole batch.

    Needs ``invoice_id (bigint), issue_date`` and ``seller_nip`` or ``batch_id``.
    """
    month, year = F.month("issue_date"), F.year("issue_date")
    block = F.floor(F.col("invoice_id") / 1_000_000)
    if scope == "seller_month":
        keyed = invoices.withColumn("_month", year * 12 + month)
        numbered = skew.number_rows(
            keyed, ["seller_nip", "_month"], [F.col("issue_date"), F.col("invoice_id")],
            [F.dayofmonth("issue_date"), block], "_n",
        ).drop("_month")
    elif scope == "batch":
        numbered = skew.number_rows(invoices, ["batch_id"], [F.col("invoice_id")], [block], "_n")
    else:
        raise ValueError(f"unknown scope {scope}")
    return numbered.withColumn("number", F.concat_ws("/", "_n", month, year)).drop("_n")


def page_of_invoices(df: DataFrame, key: str, size: int = 100, after: object | None = None) -> DataFrame:
    """One result page in key order; the next page starts after the last key seen."""
    rest = df if after is None else df.where(F.col(key) > F.lit(after))
    return rest.orderBy(key).limit(size)


def sort_documents(df: DataFrame, name: str = "file_name") -> DataFrame:
    return df.orderBy(name)
