"""Payments, settlements, advances and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faktorium.functions.money import divide_half_up, from_grosze
from faktorium.operators.skew import explode_items


def payment_state(df: DataFrame) -> DataFrame:
    """Paid (default: gross) and still due, never negative."""
    paid = F.coalesce("paid", "gross")
    due = F.greatest(F.lit(0).cast("decimal(18,2)"), (F.col("gross") - paid).cast("decimal(18,2)"))
    return df.withColumn("still_due", due).withColumn("paid", paid)


def settlement(invoices: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Due = gross + charges - deductions; a negative result is an overpayment.

    ``invoices`` has ``invoice_id, gross_gr``; ``adjustments`` has
    ``invoice_id, kind ('charge' or 'deduction'), amount_gr``.
    """
    sums = adjustments.groupBy("invoice_id").agg(
        F.sum(F.when(F.col("kind") == "charge", F.col("amount_gr")).otherwise(0)).alias("charges_gr"),
        F.sum(F.when(F.col("kind") == "deduction", F.col("amount_gr")).otherwise(0)).alias("deductions_gr"),
    )
    joined = invoices.join(sums, "invoice_id", "left").na.fill(0, ["charges_gr", "deductions_gr"])
    due = F.col("gross_gr") + F.col("charges_gr") - F.col("deductions_gr")
    return joined.select(
        "invoice_id",
        from_grosze(F.col("gross_gr")).alias("gross"),
        from_grosze(F.col("charges_gr")).alias("charges"),
        from_grosze(F.col("deductions_gr")).alias("deductions"),
        from_grosze(F.greatest(due, F.lit(0))).alias("to_pay"),
        from_grosze(F.greatest(-due, F.lit(0))).alias("to_settle"),
    )


def partial_payments(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Sum and last date of the part payments, and whether the invoice is paid.

    ``payments`` has ``invoice_id, amount_gr, paid_on``.
    """
    sums = payments.groupBy("invoice_id").agg(
        F.sum("amount_gr").alias("paid_gr"), F.max("paid_on").alias("last_paid_on"), F.count("*").alias("payment_count")
    )
    joined = invoices.join(sums, "invoice_id", "left").na.fill(0, ["paid_gr", "payment_count"])
    state = (
        F.when(F.col("paid_gr") == 0, "unpaid").when(F.col("paid_gr") >= F.col("gross_gr"), "paid").otherwise("partly")
    )
    return joined.select(
        "invoice_id", "payment_count", from_grosze(F.col("paid_gr")).alias("paid"), "last_paid_on", state.alias("state")
    )


def advance_balance(invoices: DataFrame, advances: DataFrame) -> DataFrame:
    """Gross minus the advance parts (``invoice_id, amount_gr``)."""
    sums = advances.groupBy("invoice_id").agg(F.sum("amount_gr").alias("advance_gr"))
    joined = invoices.join(sums, "invoice_id", "left").na.fill(0, ["advance_gr"])
    return joined.select(
        "invoice_id",
        from_grosze(F.col("advance_gr")).alias("advances"),
        from_grosze(F.col("gross_gr") - F.col("advance_gr")).alias("balance"),
    )


def buyer_shares(invoices: DataFrame, further_buyers: DataFrame) -> DataFrame:
    """Share of the main buyer: 100 minus the other shares, or equal parts when none is given.

    ``further_buyers`` has ``invoice_id, share decimal(9,6)``, null when not given.
    """
    sums = further_buyers.groupBy("invoice_id").agg(
        F.count(F.lit(1)).alias("buyers"),
        F.count("share").alias("given"),
        F.sum((F.col("share") * 1_000_000).cast("long")).alias("micro"),
    )
    joined = invoices.join(sums, "invoice_id", "left").na.fill(0, ["buyers", "given", "micro"])
    hundred = F.lit(100_000_000).cast("long")
    micro = F.when(F.col("given") > 0, hundred - F.col("micro")).otherwise(
        divide_half_up(hundred, F.col("buyers") + 1)
    )
    share = (micro.cast("decimal(18,0)") * F.lit("0.000001").cast("decimal(6,6)")).cast("decimal(18,6)")
    return joined.select("invoice_id", "buyers", share.alias("main_share"), (micro >= 0).alias("is_consistent"))


def foreign_vat_in_pln(tax: Column, rate: Column) -> Column:
    """VAT of a foreign-currency bucket in PLN; both factors are exact decimals."""
    return F.round(tax.cast("decimal(18,2)") * rate.cast("decimal(19,6)"), 2).cast("decimal(18,2)")


# Unit words of a relative payment term and the event that starts it.
DAY_UNITS = ["dzień", "dni"]
WEEK_UNITS = ["tydzień", "tygodnie", "tygodni"]
MONTH_UNITS = ["miesiąc", "miesiące", "miesięcy"]
YEAR_UNITS = ["rok", "lata", "lat"]
ISSUE_EVENTS = ["data wystawienia", "wystawienie faktury"]


def payment_deadlines(df: DataFrame) -> DataFrame:
    """One row per deadline; relative terms count from the issue date when that is their event.

    ``deadlines`` is an array of ``date, count, unit, event``.
    """
    rows = explode_items(df, ["invoice_id", "issue_date"], "deadlines", "_d", "_pos")
    count, unit, event = F.col("_d.count").cast("int"), F.lower("_d.unit"), F.lower("_d.event")
    relative = (
        F.when(unit.isin(DAY_UNITS), F.date_add("issue_date", count))
        .when(unit.isin(WEEK_UNITS), F.date_add("issue_date", count * 7))
        .when(unit.isin(MONTH_UNITS), F.add_months("issue_date", count))
        .when(unit.isin(YEAR_UNITS), F.add_months("issue_date", count * 12))
    )
    resolved = F.coalesce(F.col("_d.date"), F.when(event.isin(ISSUE_EVENTS), relative))
    return rows.select("invoice_id", (F.col("_pos") + 1).alias("deadline_no"), resolved.alias("due_on"))
