"""Queries on processing logs, sessions and reconciliation, over ``events`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from faktorium import codes
from faktorium.functions.money import from_grosze
from faktorium.operators import lines as ops
from faktorium.operators import logs
from faktorium.operators import reconcile as rec
from faktorium.plans import tables as t
from faktorium.plans.registry import query
from faktorium.session import work_path
from faktorium.sources import logs as source

M = t.money_sql
TS = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"
TRACED = "7/1/2024"

LOG_SQL = """
log AS (
  SELECT event_id, ts, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
         CAST(user_id AS VARCHAR) AS correlation_id, event_type,
         CASE WHEN event_id % 3 <> 0 THEN (props->>'k') || '/1/2024' END AS invoice_number,
         'Invoice ' || (props->>'k') || '/1/2024 - ' || event_type AS message,
         CAST(round(value * 100) AS BIGINT) AS duration_ms, props->>'k' AS k
  FROM events)
"""


def event_log(spark, sf):
    events = t.read_table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    number = F.concat(k, F.lit("/1/2024"))
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.col("user_id").cast("string").alias("correlation_id"), "event_type",
        F.when(F.col("event_id") % 3 != 0, number).alias("invoice_number"),
        F.concat(F.lit("Invoice "), number, F.lit(" - "), F.col("event_type")).alias("message"),
        F.round(F.col("value") * 100).cast("long").alias("duration_ms"), k.alias("k"),
    )


def stamp(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@query("logs_by_correlation", f"WITH {LOG_SQL} SELECT event_id, event_type FROM log WHERE correlation_id = '8'")
def logs_by_correlation(spark, sf):
    return logs.logs_by_correlation(event_log(spark, sf), "8").select("event_id", "event_type")


@query("logs_by_event_type", f"WITH {LOG_SQL} SELECT event_id, message FROM log WHERE event_type = 'purchase'")
def logs_by_event_type(spark, sf):
    return logs.logs_by_event_type(event_log(spark, sf), "purchase").select("event_id", "message")


@query("logs_by_level", f"WITH {LOG_SQL} SELECT event_id, {TS} AS at FROM log WHERE level = 'ERROR'")
def logs_by_level(spark, sf):
    return logs.logs_by_level(event_log(spark, sf)).select("event_id", stamp("timestamp").alias("at"))


@query("audit_trail", f"WITH {LOG_SQL} SELECT event_id, message FROM log WHERE contains(message, '{TRACED}') OR invoice_number = '{TRACED}'")
def audit_trail(spark, sf):
    return logs.audit_trail(event_log(spark, sf), TRACED).select("event_id", "message")


@query("slow_operations", f"WITH {LOG_SQL} SELECT event_id, duration_ms FROM log WHERE duration_ms > 1000")
def slow_operations(spark, sf):
    return logs.slow_operations(event_log(spark, sf)).select("event_id", "duration_ms")


@query("trace_invoice", f"""
WITH {LOG_SQL} SELECT event_id, correlation_id FROM log
WHERE correlation_id IN (SELECT correlation_id FROM log WHERE invoice_number = '{TRACED}')""")
def trace_invoice(spark, sf):
    return logs.trace_invoice(event_log(spark, sf), TRACED).select("event_id", "correlation_id")


@query("first_trace_id", f"""
WITH {LOG_SQL} SELECT correlation_id, {TS} AS at FROM log WHERE invoice_number = '{TRACED}' ORDER BY ts, correlation_id LIMIT 1""")
def first_trace_id(spark, sf):
    return logs.first_trace_id(event_log(spark, sf), TRACED).select("correlation_id", stamp("timestamp").alias("at"))


@query("log_errors_hourly", f"""
WITH {LOG_SQL} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS errors
FROM log WHERE level = 'ERROR' GROUP BY 1""")
def log_errors_hourly(spark, sf):
    return logs.error_counts(event_log(spark, sf)).select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "errors")


@query("log_errors_by_type", f"WITH {LOG_SQL} SELECT event_type, count(*) AS errors FROM log WHERE level = 'ERROR' GROUP BY 1")
def log_errors_by_type(spark, sf):
    return logs.error_counts(event_log(spark, sf), "event_type")


@query("log_errors_last_hour", f"""
WITH {LOG_SQL} SELECT count(*) AS errors FROM log
WHERE level = 'ERROR' AND ts > (SELECT max(ts) FROM log) - INTERVAL 1 HOUR""")
def log_errors_last_hour(spark, sf):
    return logs.errors_in_last_hour(event_log(spark, sf))


@query("log_trace", f"""
WITH {LOG_SQL},
g AS (SELECT correlation_id, min(ts) AS a, max(ts) AS b, count(*) AS records, bool_or(level = 'ERROR') AS has_error FROM log GROUP BY 1),
s AS (SELECT correlation_id, string_agg(event_type, ',' ORDER BY event_type) AS stages
      FROM (SELECT DISTINCT correlation_id, event_type FROM log) GROUP BY 1)
SELECT g.correlation_id, strftime(a, '%Y-%m-%d %H:%M:%S.%f') AS first_at, strftime(b, '%Y-%m-%d %H:%M:%S.%f') AS last_at,
       records, stages, has_error, epoch_us(b) - epoch_us(a) AS elapsed_us
FROM g JOIN s ON s.correlation_id = g.correlation_id""")
def log_trace(spark, sf):
    summary = logs.trace_summary(event_log(spark, sf))
    return summary.withColumn("first_at", stamp("first_at")).withColumn("last_at", stamp("last_at"))


@query("log_batch_report", f"""
WITH {LOG_SQL}
SELECT CAST(ts AS DATE) AS day, count(CASE WHEN event_type = 'signup' THEN 1 END) AS started,
       count(CASE WHEN event_type = 'purchase' THEN 1 END) AS completed,
       count(CASE WHEN event_type = 'error' THEN 1 END) AS failed FROM log GROUP BY 1""")
def log_batch_report(spark, sf):
    kinds = codes.literal_map({"signup": "batch_start", "purchase": "batch_complete", "error": "batch_failed"})
    return logs.batch_report(event_log(spark, sf).withColumn("event_type", F.element_at(kinds, F.col("event_type"))))


@query("log_latency", f"""
WITH {LOG_SQL}
SELECT event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY correlation_id ORDER BY ts, event_id), -1) AS latency_us
FROM log""")
def log_latency(spark, sf):
    latency = logs.stage_latency(event_log(spark, sf), "event_id")
    return latency.select("event_id", F.coalesce("latency_us", F.lit(-1)).alias("latency_us"))


@query("to_log_records", f"""
WITH {t.HEADERS_SQL}
SELECT CASE WHEN status = 'O' THEN 'ERROR' ELSE 'INFO' END AS level, 'Invoice ' || invoice_id || ' - validation' AS message,
       status <> 'O' AS success,
       CASE WHEN status = 'O' THEN 'not paid' END AS error FROM headers""")
def to_log_records(spark, sf):
    results = t.invoice_headers(spark, sf).select(
        F.col("invoice_id").cast("string").alias("number"), F.when(F.col("status") == "O", "not paid").alias("error")
    )
    parsed = source.parse_event_log(logs.to_log_records(results, "validation").select("value"), "python")
    return parsed.select("level", "message", "success", "error")


def _written_logs(spark, sf):
    """The events as JSON lines: the even ones as one writer would log them, the odd ones as the other."""
    log = event_log(spark, sf)
    when = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    common = ["level", "message", "correlation_id", "event_type", "invoice_number", "duration_ms"]
    python = F.to_json(F.struct(when.alias("timestamp"), F.lit("generator").alias("logger"), F.lit(7).alias("line"), *common, "k", "event_id"))
    java = F.to_json(F.struct(when.alias("@timestamp"), F.lit("app.Service").alias("logger_name"), F.lit("main").alias("thread_name"), *common, "k", "event_id"))
    first, second = work_path(spark, "log-python"), work_path(spark, "log-java")
    log.where("event_id % 2 = 0").select(python.alias("value")).write.text(first)
    log.where("event_id % 2 = 1").select(java.alias("value")).write.text(second)
    return first, second


@query("read_event_log", f"""
WITH {LOG_SQL}
SELECT event_id, {TS} AS at, level, CASE WHEN event_id % 2 = 0 THEN 'generator' ELSE 'app.Service' END AS logger,
       CASE WHEN event_id % 2 = 1 THEN 'main' END AS thread, message, correlation_id, event_type, invoice_number,
       duration_ms, k, 2 AS extras FROM log""")
def read_event_log(spark, sf):
    first, second = _written_logs(spark, sf)
    log = source.union_logs(source.read_event_log(spark, first, "python"), source.read_event_log(spark, second, "java"))
    return log.select(
        F.col("extra")["event_id"].cast("long").alias("event_id"), stamp("timestamp").alias("at"), "level", "logger", "thread",
        "message", "correlation_id", "event_type", "invoice_number", F.col("duration_ms").cast("long").alias("duration_ms"),
        F.col("extra")["k"].alias("k"), F.size("extra").alias("extras"),
    )


@query("union_logs", f"WITH {LOG_SQL} SELECT level, event_type, count(*) AS records FROM log GROUP BY 1, 2")
def union_logs(spark, sf):
    log = event_log(spark, sf)
    early, late = log.where("event_id % 2 = 0").drop("k"), log.where("event_id % 2 = 1")
    return source.union_logs(early, late).groupBy("level", "event_type").agg(F.count("*").alias("records"))


@query("write_error_log", f"WITH {LOG_SQL} SELECT CAST(ts AS DATE) AS date, correlation_id, message FROM log WHERE level = 'ERROR'")
def write_error_log(spark, sf):
    path = work_path(spark, "error-log")
    source.write_error_log(event_log(spark, sf), path)
    schema = "timestamp timestamp, level string, correlation_id string, message string, date date"
    return spark.read.schema(schema).json(path).select("date", "correlation_id", "message")


@query("apply_retention", f"""
WITH {LOG_SQL}, d AS (SELECT *, CAST(ts AS DATE) AS date FROM log), n AS (SELECT max(date) AS newest FROM d)
SELECT event_id, level FROM d, n WHERE newest - date < 10 OR (level = 'ERROR' AND newest - date < 20)""")
def apply_retention(spark, sf):
    dated = event_log(spark, sf).withColumn("date", F.to_date("timestamp"))
    return source.apply_retention(dated, 10, 20).select("event_id", "level")


# --- Sessions ---------------------------------------------------------------------
SESSION_SQL = LOG_SQL + """,
status AS (
  SELECT event_id, CAST(correlation_id AS BIGINT) AS session_id, ts, k,
         CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' ELSE 'open' END AS state FROM log),
counts AS (
  SELECT session_id, count(*) AS total, count(CASE WHEN state = 'accepted' THEN 1 END) AS accepted,
         count(CASE WHEN state = 'rejected' THEN 1 END) AS rejected FROM status GROUP BY 1)
"""


def _status(spark, sf):
    state = F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "error", "rejected").otherwise("open")
    return event_log(spark, sf).select(
        "event_id", F.col("correlation_id").cast("long").alias("session_id"), "timestamp", "k", state.alias("state")
    )


@query("session_counts", f"""
WITH {SESSION_SQL} SELECT *, accepted > 0 AS any_accepted, accepted + rejected = total AS all_processed FROM counts""")
def session_counts(spark, sf):
    return rec.session_counts(_status(spark, sf))


@query("session_processed", f"WITH {SESSION_SQL} SELECT session_id, accepted AS successful_count FROM counts WHERE accepted > 0")
def session_processed(spark, sf):
    counts = rec.session_counts(_status(spark, sf)).select("session_id", F.col("accepted").alias("successful_count"))
    return rec.session_processed(counts)


@query("receipt_ready", f"WITH {SESSION_SQL} SELECT session_id, 200 AS status_code FROM counts WHERE accepted > rejected")
def receipt_ready(spark, sf):
    code = F.when(F.col("accepted") > F.col("rejected"), 200).otherwise(150)
    return rec.receipt_ready(rec.session_counts(_status(spark, sf)).select("session_id", code.alias("status_code")))


FIRST_SQL = "SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS rn FROM status"


@query("first_document", f"""
WITH {SESSION_SQL}, r AS ({FIRST_SQL.format(keys='session_id')})
SELECT session_id, event_id, state FROM r WHERE rn = 1""")
def first_document(spark, sf):
    return rec.first_document(_status(spark, sf), "session_id", ["timestamp", "event_id"]).select("session_id", "event_id", "state")


@query("keep_first_submission", f"""
WITH {SESSION_SQL}, r AS ({FIRST_SQL.format(keys='session_id, k')})
SELECT session_id, k, event_id, state FROM r WHERE rn = 1""")
def keep_first_submission(spark, sf):
    first = rec.keep_first_submission(_status(spark, sf), ["session_id", "k"], ["timestamp", "event_id"])
    return first.select("session_id", "k", "event_id", "state")


@query("find_duplicates", f"""
WITH {SESSION_SQL}, r AS ({FIRST_SQL.format(keys='session_id, k')}) SELECT session_id, k, event_id FROM r WHERE rn > 1""")
def find_duplicates(spark, sf):
    found = rec.find_duplicates(_status(spark, sf), "session_id", ["k"], ["timestamp", "event_id"])
    return found.select("session_id", "k", "event_id")


@query("duplicate_lines", f"""
WITH {t.LINES_SQL} SELECT invoice_id, raw_line_no, count(*) - 1 AS copies, min(part_id) AS first_part_id
FROM lines GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_lines(spark, sf):
    return rec.duplicate_groups(t.invoice_lines(spark, sf), ["invoice_id", "raw_line_no"], ["part_id"])


@query("reconcile", f"""
WITH {t.LINES_SQL}, {t.HEADERS_SQL},
c AS (SELECT DISTINCT invoice_id FROM lines)
SELECT h.invoice_id AS reference, CASE WHEN c.invoice_id IS NULL THEN 'no status' WHEN status = 'O' THEN 'rejected'
  WHEN customer_id % 4 = 0 THEN 'no receipt' ELSE 'complete' END AS outcome
FROM headers h LEFT JOIN c ON c.invoice_id = h.invoice_id""")
def reconcile(spark, sf):
    headers = t.invoice_headers(spark, sf)
    submitted = headers.select(F.col("invoice_id").alias("reference"))
    answered = headers.join(t.invoice_lines(spark, sf).select("invoice_id").distinct(), "invoice_id")
    accepted = F.col("status") != "O"
    clearance = F.concat(F.lit("C-"), F.col("invoice_id").cast("string"))
    status = answered.select(
        F.col("invoice_id").alias("reference"), F.when(accepted, 200).otherwise(400).alias("status_code"),
        F.when(accepted, clearance).alias("clearance_number"),
    )
    receipts = headers.where("customer_id % 4 <> 0").select(clearance.alias("clearance_number"), F.col("invoice_id").alias("receipt_id"))
    return rec.reconcile_submissions(submitted, status, receipts).select("reference", "outcome")


@query("with_lines", f"""
WITH {t.LINES_SQL}, {t.HEADERS_SQL}
SELECT h.invoice_id, issue_date, part_id, supplier_id, vat_code FROM headers h JOIN lines l ON l.invoice_id = h.invoice_id""")
def with_lines(spark, sf):
    headers = t.invoice_headers(spark, sf).select("invoice_id", "issue_date")
    return rec.with_lines(headers, t.invoice_lines(spark, sf).select("invoice_id", "part_id", "supplier_id", "vat_code"))


@query("with_parties", f"""
WITH {t.totals_sql()}
SELECT i.invoice_id, s_name AS seller_name, c_name AS buyer_name, c_mktsegment AS buyer_segment
FROM invoices i LEFT JOIN supplier s ON CAST(1230000000 + s.s_suppkey AS VARCHAR) = i.seller_nip
LEFT JOIN customer c ON c.c_custkey = i.customer_id""")
def with_parties(spark, sf):
    found = t.invoices(spark, sf).select("invoice_id", F.col("seller_nip").alias("seller_id"), F.col("customer_id").alias("buyer_id"))
    sellers = t.read_table(spark, sf, "supplier").select(t.seller_nip(F.col("s_suppkey")).alias("seller_id"), F.col("s_name").alias("seller_name"))
    buyers = t.read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("buyer_id"), F.col("c_name").alias("buyer_name"), F.col("c_mktsegment").alias("buyer_segment")
    )
    return rec.with_parties(found, sellers, buyers).select("invoice_id", "seller_name", "buyer_name", "buyer_segment")


@query("code_list_antijoin", """
SELECT c_custkey, chr(65 + c_nationkey % 26) || 'U' || chr(65 + CAST(c_custkey % 26 AS INTEGER)) AS currency FROM customer
WHERE chr(65 + c_nationkey % 26) || 'U' || chr(65 + CAST(c_custkey % 26 AS INTEGER)) NOT IN (""" + ", ".join(f"'{c}'" for c in codes.CURRENCIES) + ")")
def code_list_antijoin(spark, sf):
    letter = lambda c: F.char(F.lit(65) + F.col(c) % 26)
    rows = t.read_table(spark, sf, "customer").select(
        "c_custkey", F.concat(letter("c_nationkey"), F.lit("U"), letter("c_custkey")).alias("currency")
    )
    return rec.not_in_code_list(rows, "currency", "currency", codes.code_list(spark)).select("c_custkey", "currency")


@query("compare_expected", f"""
WITH {t.totals_sql()},
a AS (SELECT invoice_id, gross_gr, line_count FROM invoices),
e AS (SELECT invoice_id, CASE WHEN invoice_id % 7 = 0 THEN gross_gr + 1 ELSE gross_gr END AS gross_gr,
             CASE WHEN invoice_id % 5 = 0 THEN 0 ELSE line_count END AS line_count
      FROM (SELECT h.invoice_id, s.gross_gr, s.line_count FROM headers h LEFT JOIN sums s ON s.invoice_id = h.invoice_id))
SELECT coalesce(a.invoice_id, e.invoice_id) AS invoice_id,
  CASE WHEN a.invoice_id IS NULL THEN 'missing' WHEN a.gross_gr IS DISTINCT FROM e.gross_gr OR a.line_count IS DISTINCT FROM e.line_count
       THEN 'different' ELSE 'equal' END AS state,
  concat_ws(',', CASE WHEN a.gross_gr IS DISTINCT FROM e.gross_gr THEN 'gross_gr' END,
            CASE WHEN a.line_count IS DISTINCT FROM e.line_count THEN 'line_count' END) AS fields
FROM a FULL OUTER JOIN e ON a.invoice_id = e.invoice_id""")
def compare_expected(spark, sf):
    actual = t.invoices(spark, sf).select("invoice_id", "gross_gr", "line_count")
    headers = t.invoice_headers(spark, sf).select("invoice_id").join(actual, "invoice_id", "left")
    expected = headers.select(
        "invoice_id",
        F.when(F.col("invoice_id") % 7 == 0, F.col("gross_gr") + 1).otherwise(F.col("gross_gr")).alias("gross_gr"),
        F.when(F.col("invoice_id") % 5 == 0, 0).otherwise(F.col("line_count")).alias("line_count"),
    )
    return rec.compare_expected(actual, expected, ["invoice_id"])


@query("golden_diff", f"""
WITH {t.LINES_SQL},
a AS (SELECT invoice_id, part_id, quantity FROM lines),
g AS (SELECT invoice_id, part_id, CASE WHEN invoice_id % 9 = 0 THEN quantity + 1 ELSE quantity END AS quantity FROM lines)
SELECT *, 'actual' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM g)
UNION ALL SELECT *, 'golden' FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM a)""")
def golden_diff(spark, sf):
    actual = t.invoice_lines(spark, sf).select("invoice_id", "part_id", "quantity")
    changed = F.when(F.col("invoice_id") % 9 == 0, F.col("quantity") + 1).otherwise(F.col("quantity"))
    return rec.golden_diff(actual, actual.withColumn("quantity", changed))


@query("compare_outcome", f"""
WITH {t.totals_sql()}
SELECT h.invoice_id, h.status <> 'O' AS should_pass, i.invoice_id IS NOT NULL AND i.gross_gr <= i.declared_gr AS passed,
  (h.status <> 'O') = (i.invoice_id IS NOT NULL AND i.gross_gr <= i.declared_gr) AS as_expected
FROM headers h LEFT JOIN invoices i ON i.invoice_id = h.invoice_id""")
def compare_outcome(spark, sf):
    expected = t.invoice_headers(spark, sf).select("invoice_id", (F.col("status") != "O").alias("should_pass"))
    actual = t.invoices(spark, sf).select("invoice_id", (F.col("gross_gr") <= F.col("declared_gr")).alias("passed"))
    return rec.compare_outcome(actual, expected, "invoice_id").withColumn("passed", F.coalesce("passed", F.lit(False))).withColumn(
        "as_expected", F.col("passed") == F.col("should_pass")
    )
