"""Processing logs: JSON lines of two writers, read in batch or followed as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faktorium.sources.followed import follow_lines

# Fixed keys of the two dialects and the log column they feed.
DIALECTS = {
    "python": {
        "timestamp": ["timestamp"], "level": ["level"], "logger": ["logger"], "message": ["message"],
        "module": ["module"], "function": ["function"], "line": ["line"], "exception": ["exception"],
        "correlation_id": ["correlation_id"],
    },
    "java": {
        "timestamp": ["timestamp", "@timestamp"], "level": ["level"], "logger": ["logger_name"],
        "message": ["message"], "thread": ["thread_name"], "application": ["application"],
        "environment": ["environment"], "exception": ["stack_trace"], "correlation_id": ["correlation_id"],
    },
}
LOG_COLUMNS = [
    "timestamp", "level", "logger", "message", "module", "function", "line", "thread", "application", "environment",
    "exception", "correlation_id",
]
# Free fields that analyses use by name; the remaining ones stay in ``extra``.
NAMED_EXTRAS = {
    "event_type": "string", "invoice_number": "string", "stage": "string", "duration_ms": "double",
    "success": "boolean", "error": "string",
}


def parse_event_log(lines: DataFrame, dialect: str) -> DataFrame:
    """Text lines (column ``value``) to the log schema; a line that is no JSON keeps its text in ``message``."""
    keys = DIALECTS[dialect]
    parsed = lines.select("value", F.from_json("value", "map<string,string>").alias("_m"))

    def first(names: Sequence[str]) -> Column:
        return F.coalesce(*[F.col("_m")[n] for n in names])

    columns = [(first(keys[c]) if c in keys else F.lit(None).cast("string")).alias(c) for c in LOG_COLUMNS]
    named = [F.col("_m")[c].try_cast(kind).alias(c) for c, kind in NAMED_EXTRAS.items()]
    used = [n for names in keys.values() for n in names] + list(NAMED_EXTRAS)
    extra = F.map_filter("_m", lambda k, v: ~k.isin(used))
    rows = parsed.select(*columns, *named, extra.alias("extra"), "value")
    return (
        rows.withColumn("timestamp", F.col("timestamp").try_cast("timestamp"))
        .withColumn("line", F.col("line").try_cast("int"))
        .withColumn("message", F.when(F.col("extra").isNull(), F.col("value")).otherwise(F.col("message")))
        .drop("value")
    )


def read_event_log(spark: SparkSession, path: str | list[str], dialect: str = "python") -> DataFrame:
    return parse_event_log(spark.read.text(path), dialect)


def union_logs(*logs: DataFrame) -> DataFrame:
    """All logs together, rotated files and both dialects."""
    first, *rest = logs
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def stream_event_log(spark: SparkSession, folder: str, dialect: str = "python", pattern: str = "*") -> DataFrame:
    """Follow the logs of a folder while they grow and are rotated by renaming; every record comes once.

    ``pattern`` names the files of one log, rotated ones included (``app.log*``).
    """
    return parse_event_log(follow_lines(spark, folder, pattern), dialect)


def write_error_log(log: DataFrame, path: str) -> None:
    """Errors only, one folder per day."""
    errors = log.where(F.col("level") == "ERROR").withColumn("date", F.to_date("timestamp"))
    errors.write.mode("append").partitionBy("date").json(path)


def apply_retention(log: DataFrame, days_all: int = 30, days_error: int = 90) -> DataFrame:
    """Keep the last days of the log, and errors for longer, counted from the newest date."""
    newest = log.agg(F.max("date").alias("_newest")).scalar()
    age = F.datediff(newest, F.col("date"))
    return log.where((age < days_all) | ((F.col("level") == "ERROR") & (age < days_error)))
