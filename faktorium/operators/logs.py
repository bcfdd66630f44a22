"""Analysis of the processing log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faktorium.operators import skew


def logs_by_correlation(log: DataFrame, correlation_id: str) -> DataFrame:
    return log.where(F.col("correlation_id") == correlation_id)


def logs_by_event_type(log: DataFrame, event_type: str) -> DataFrame:
    return log.where(F.col("event_type") == event_type)


def logs_by_level(log: DataFrame, level: str = "ERROR") -> DataFrame:
    return log.where(F.col("level") == level)


def mentions(number: str) -> Column:
    return (F.col("invoice_number") == number) | F.contains(F.col("message"), F.lit(number))


def audit_trail(log: DataFrame, number: str) -> DataFrame:
    """Every record that names the invoice, in its field or in the message."""
    return log.where(F.coalesce(mentions(number), F.lit(False)))


def slow_operations(log: DataFrame, bound_ms: int = 1000) -> DataFrame:
    return log.where(F.col("duration_ms") > bound_ms)


def trace_invoice(log: DataFrame, number: str) -> DataFrame:
    """All records of every operation in which the invoice was seen."""
    seen = log.where(F.col("invoice_number") == number).select("correlation_id").distinct()
    return log.join(seen, "correlation_id", "left_semi")


def first_trace_id(log: DataFrame, number: str) -> DataFrame:
    """The earliest correlation id of an invoice."""
    return (
        log.where((F.col("invoice_number") == number) & F.col("correlation_id").isNotNull())
        .orderBy("timestamp", "correlation_id").select("correlation_id", "timestamp").limit(1)
    )


def error_counts(log: DataFrame, by: str = "hour") -> DataFrame:
    """Errors per hour or per event type."""
    errors = log.where(F.col("level") == "ERROR")
    if by == "hour":
        return errors.groupBy(F.date_trunc("hour", "timestamp").alias("hour")).agg(F.count("*").alias("errors"))
    if by == "event_type":
        return errors.groupBy("event_type").agg(F.count("*").alias("errors"))
    raise ValueError(f"unknown grouping {by}")


def errors_in_last_hour(log: DataFrame) -> DataFrame:
    """Errors within one hour of the newest record."""
    newest = log.agg(F.max("timestamp").alias("_newest")).scalar()
    recent = log.where((F.col("level") == "ERROR") & (F.col("timestamp") > newest - F.expr("INTERVAL 1 HOUR")))
    return recent.agg(F.count("*").alias("errors"))


def trace_summary(log: DataFrame) -> DataFrame:
    """First and last time, number of records, stages, any error and elapsed time per operation.

    The set of stages is bounded by the stage vocabulary.
    """
    micros = F.unix_micros("timestamp")
    return log.groupBy("correlation_id").agg(
        F.min("timestamp").alias("first_at"),
        F.max("timestamp").alias("last_at"),
        F.count("*").alias("records"),
        F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("stages"),
        F.bool_or(F.col("level") == "ERROR").alias("has_error"),
        (F.max(micros) - F.min(micros)).alias("elapsed_us"),
    )


def batch_report(log: DataFrame) -> DataFrame:
    """Started, completed and failed batches per day."""
    hits = lambda kind: F.count_if(F.col("event_type") == kind)
    return log.groupBy(F.to_date("timestamp").alias("day")).agg(
        hits("batch_start").alias("started"), hits("batch_complete").alias("completed"), hits("batch_failed").alias("failed")
    )


def stage_latency(log: DataFrame, tie: str) -> DataFrame:
    """Time since the previous record of the same operation; ``tie`` orders equal times.

    Records without a correlation id belong to no operation and have no latency.
    """
    hour = F.floor(F.unix_seconds("timestamp") / 3600)
    timed = log.where(F.col("correlation_id").isNotNull()).withColumn("_us", F.unix_micros("timestamp"))
    lagged = skew.previous_value(timed, ["correlation_id"], [F.col("timestamp"), F.col(tie)], [hour], "_us", "_previous")
    latencies = lagged.withColumn("latency_us", F.col("_us") - F.col("_previous")).drop("_us", "_previous")
    alone = log.where(F.col("correlation_id").isNull()).withColumn("latency_us", F.lit(None).cast("long"))
    return latencies.unionByName(alone)


def to_log_records(df: DataFrame, stage: str) -> DataFrame:
    """Results of a processing step (``number, error``) as log records with their JSON text."""
    success = F.col("error").isNull()
    rows = df.select(
        F.when(success, "INFO").otherwise("ERROR").alias("level"),
        F.concat(F.lit("Invoice "), F.col("number"), F.lit(f" - {stage}")).alias("message"),
        F.col("number").alias("invoice_number"),
        F.lit(stage).alias("stage"),
        success.alias("success"),
        F.col("error"),
        F.lit("invoice_processing").alias("event_type"),
    )
    return rows.withColumn("value", F.to_json(F.struct(*rows.columns)))
