"""Queries on packaging, generation and streaming."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import functions as F

from faktorium.functions import ids, text
from faktorium.functions.money import from_grosze
from faktorium.operators import convert
from faktorium.operators import generate as gen
from faktorium.operators import package as pkg
from faktorium.plans import tables as t
from faktorium.plans.documents import created_at, records
from faktorium.plans.registry import query
from faktorium.session import work_path
from faktorium.sources import invoices as source
from faktorium.sources.followed import LogFolder
from faktorium.sources.logs import stream_event_log as stream_log
from faktorium.streaming import jobs

M = t.money_sql
PART_BYTES = 20_000


def _documents(spark, sf):
    docs = t.read_table(spark, sf, "documents")
    return docs.select(F.col("source").alias("package_id"), "doc_id", F.col("text").alias("content"), F.octet_length("text").cast("long").alias("size_bytes"))


PARTS_SQL = f"""
r AS (SELECT source AS package_id, doc_id, text, CAST(strlen(text) AS BIGINT) AS size_bytes,
             sum(CAST(strlen(text) AS BIGINT)) OVER (PARTITION BY source ORDER BY doc_id) AS run FROM documents),
packed AS (SELECT *, CAST((run - size_bytes) // {PART_BYTES} + 1 AS BIGINT) AS part_no FROM r),
payloads AS (SELECT package_id, part_no, count(*) AS documents, string_agg(text, chr(10) ORDER BY doc_id) AS payload FROM packed GROUP BY 1, 2),
parts AS (SELECT package_id, part_no, documents, CAST(strlen(payload) AS BIGINT) AS size_bytes, base64(unhex(sha256(payload))) AS sha256_b64 FROM payloads)
"""


@query("pack_parts", f"WITH {PARTS_SQL} SELECT package_id, doc_id, size_bytes, part_no FROM packed")
def pack_parts(spark, sf):
    return pkg.pack_parts(_documents(spark, sf).drop("content"), PART_BYTES)


@query("pack_parts_by_count", f"""
WITH {PARTS_SQL}, tot AS (SELECT package_id, sum(size_bytes) AS total FROM packed GROUP BY 1)
SELECT p.package_id, doc_id, CAST(((run - size_bytes) * greatest(2, CAST(ceil(total / 1000000.0) AS BIGINT))) // greatest(total, 1) + 1 AS BIGINT) AS part_no
FROM packed p JOIN tot ON tot.package_id = p.package_id""")
def pack_parts_by_count(spark, sf):
    return pkg.pack_parts(_documents(spark, sf).drop("content"), 1_000_000, parts=2).drop("size_bytes")


def _parts(spark, sf):
    documents = _documents(spark, sf)
    return pkg.build_parts(pkg.pack_parts(documents.drop("content"), PART_BYTES), documents)


@query("build_parts", f"WITH {PARTS_SQL} SELECT package_id, part_no, documents, size_bytes, sha256_b64 FROM parts")
def build_parts(spark, sf):
    return _parts(spark, sf).drop("payload")


# Parts of a piece and nodes of a tree node in the queries, so that the given packages have many.
FAN_OUT = 4
MANIFEST_SQL = f"""WITH {PARTS_SQL},
tops AS (SELECT package_id, count(*) AS part_count, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, max(part_no) AS top, min(part_no) AS first FROM parts GROUP BY 1),
t0 AS (SELECT package_id, part_no - 1 AS no, sha256_b64 AS h FROM parts),
"""
for _i in range(1, 8):
    _keep = f"CASE WHEN max(top) <= {FAN_OUT ** (_i - 1)} THEN min(h) ELSE base64(unhex(sha256(string_agg(h, '' ORDER BY no)))) END" if _i > 1 else (
        "base64(unhex(sha256(string_agg(h, '' ORDER BY no))))")
    MANIFEST_SQL += f"t{_i} AS (SELECT package_id, no // {FAN_OUT} AS no, {_keep} AS h FROM t{_i - 1} JOIN tops USING (package_id) GROUP BY 1, 2),\n"
MANIFEST_SQL += "m AS (SELECT package_id, part_count, size_bytes, h AS sha256_b64 FROM tops JOIN t7 USING (package_id))\n"


@query("package_manifest", MANIFEST_SQL + "SELECT package_id, part_count, size_bytes, sha256_b64 FROM m")
def package_manifest(spark, sf):
    return pkg.package_manifest(_parts(spark, sf).drop("payload"), FAN_OUT)


@query("build_manifest", MANIFEST_SQL + f"""
, e AS (SELECT package_id, (part_no - 1) // {FAN_OUT} + 1 AS piece_no, part_no,
           '{{"ordinalNumber":' || part_no || ',"fileSize":' || size_bytes || ',"fileHash":"' || sha256_b64 || '"}}' AS entry FROM parts)
SELECT package_id, 0::BIGINT AS piece_no, '{{"formCode":{{"systemCode":"FA (2)","schemaVersion":"1-0E","value":"FA"}},"offlineMode":false,"batchFile":{{"fileSize":'
  || size_bytes || ',"fileHash":"' || sha256_b64 || '","fileParts":[' AS request FROM m
UNION ALL
SELECT package_id, piece_no, CASE WHEN piece_no > (min(first) - 1) // {FAN_OUT} + 1 THEN ',' ELSE '' END || string_agg(entry, ',' ORDER BY part_no)
  || CASE WHEN piece_no = (max(top) - 1) // {FAN_OUT} + 1 THEN ']}}}}' ELSE '' END
FROM e JOIN tops USING (package_id) GROUP BY package_id, piece_no""")
def build_manifest(spark, sf):
    return pkg.build_manifest(_parts(spark, sf).drop("payload"), fan_out=FAN_OUT)


@query("verify_parts", f"""WITH {PARTS_SQL}
SELECT package_id, part_no, CASE WHEN part_no % 3 = 0 THEN 21157 ELSE 0 END AS size_error,
       CASE WHEN part_no % 3 = 0 OR part_no % 3 = 1 THEN 21158 ELSE 0 END AS hash_error FROM parts""")
def verify_parts(spark, sf):
    parts = _parts(spark, sf)
    k = F.col("part_no") % 3
    damaged = F.when(k == 0, F.concat("payload", F.lit("!"))).when(k == 1, F.translate("payload", "e", "x")).otherwise(F.col("payload"))
    manifest = parts.select("package_id", "part_no", "size_bytes", "sha256_b64")
    checked = pkg.verify_parts(manifest, parts.withColumn("payload", damaged))
    return checked.select("package_id", "part_no", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("size_error", "hash_error")])


@query("hash_and_size", """
SELECT doc_id, base64(unhex(sha256(text))) AS plain_sha256_b64, CAST(strlen(text) AS BIGINT) AS plain_size,
       CAST((strlen(text) // 16 + 1) * 16 AS BIGINT) AS cipher_size, TRUE AS is_restored FROM documents""")
def hash_and_size(spark, sf):
    """Plain and encrypted hash and size; keys are derived per package."""
    docs = pkg.hash_and_size(_documents(spark, sf).withColumn("plain", F.col("content")))
    keys = docs.select("package_id").distinct().select(
        "package_id", F.unhex(F.sha2("package_id", 256)).alias("key"), F.unhex(F.md5("package_id")).alias("iv")
    )
    cipher = pkg.hash_and_size(pkg.encrypt_documents(docs, keys, "package_id"), prefix="cipher")
    back = text.decrypt_content(F.col("content"), F.unhex(F.sha2("package_id", 256)), F.unhex(F.md5("package_id")))
    return cipher.select("doc_id", "plain_sha256_b64", "plain_size", "cipher_size", (back.cast("string") == F.col("plain")).alias("is_restored"))


@query("verify_files", """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 21402 ELSE 0 END AS size_error, CASE WHEN doc_id % 4 = 1 THEN 21403 ELSE 0 END AS hash_error FROM documents""")
def verify_files(spark, sf):
    k = F.col("doc_id") % 4
    declared = _documents(spark, sf).select(
        "doc_id", "content", F.when(k == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"),
        F.when(k == 1, text.content_hash(F.concat("content", F.lit("?")))).otherwise(text.content_hash(F.col("content"))).alias("sha256_b64"),
    )
    checked = pkg.verify_files(declared)
    return checked.select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("size_error", "hash_error")])


# --- Generation ----------------------------------------------------------------------------------------
CONFIG = source.GenerationConfig()


def _draw_sql(slot: str, low: int, high: int, *keys: str) -> str:
    parts = " || '-' || ".join(["'42'", f"'{slot}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST('0x' || substr(md5({parts}), 1, 13) AS BIGINT) % {high - low + 1} + {low})"


GENERATED_SQL = f"""
seeds AS (SELECT o_orderkey AS seq FROM orders),
gl AS (SELECT seq, unnest(range(1, {_draw_sql('positions', 1, 5, 'seq')} + 1)) AS line_no FROM seeds),
gd AS (SELECT seq, line_no, {_draw_sql('product', 0, 3, 'seq', 'line_no')} AS p, {_draw_sql('quantity', 1, 10, 'seq', 'line_no')} AS quantity,
              {_draw_sql('price', 0, 1000000, 'seq', 'line_no')} AS share FROM gl),
gp AS (SELECT *, ['Stol debowy', 'Krzeslo', 'Polka scienna', 'Komoda'][p + 1] AS product,
              [64000, 8500, 3000, 41000][p + 1] + ([126000, 17500, 11500, 57000][p + 1] * share) // 1000000 AS unit_net_gr FROM gd),
gen AS (SELECT *, unit_net_gr * quantity AS net_gr, ((unit_net_gr * 46 + 100) // 200) * quantity AS tax_gr FROM gp)
"""


def _seeds(spark, sf):
    return t.read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"))


@query("generate_lines", f"""
WITH {GENERATED_SQL} SELECT seq, line_no, product, quantity, {M('unit_net_gr')} AS unit_net, {M('net_gr')} AS net, {M('tax_gr')} AS tax,
  {M('net_gr + tax_gr')} AS gross FROM gen""")
def generate_lines(spark, sf):
    lines = gen.generate_lines(_seeds(spark, sf), CONFIG)
    return lines.select("seq", "line_no", "product", "quantity", *[from_grosze(F.col(f"{c}_gr")).alias(c) for c in ("unit_net", "net", "tax", "gross")])


def _draw_below_sql(slot: str, count: str, *keys: str) -> str:
    """A draw from 0 to a count that a column holds."""
    parts = " || '-' || ".join(["'42'", f"'{slot}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST('0x' || substr(md5({parts}), 1, 13) AS BIGINT) % {count})"


@query("generate_configured", f"""
WITH pool AS (SELECT p_type AS product, CAST(floor(min(p_retailprice)) AS BIGINT) * 100 AS low, CAST(ceil(max(p_retailprice)) AS BIGINT) * 100 AS high FROM part GROUP BY 1),
products AS (SELECT *, row_number() OVER (ORDER BY product) - 1 AS p, count(*) OVER () AS n FROM pool),
l AS (SELECT o_orderkey AS seq, unnest(range(1, {_draw_sql('positions', 2, 4, 'o_orderkey')} + 1)) AS line_no FROM orders),
d AS (SELECT seq, line_no, {_draw_below_sql('product', '(SELECT max(n) FROM products)', 'seq', 'line_no')} AS p, {_draw_sql('quantity', 3, 7, 'seq', 'line_no')} AS quantity,
             {_draw_sql('price', 0, 1000000, 'seq', 'line_no')} AS share FROM l),
u AS (SELECT *, low + (high - low) * share // 1000000 AS unit_net_gr FROM d JOIN products USING (p))
SELECT seq, line_no, product, quantity, {M('unit_net_gr')} AS unit_net, {M('((unit_net_gr * 16 + 100) // 200) * quantity')} AS tax FROM u""")
def generate_configured(spark, sf):
    """Product pool and ranges come from a settings file, written from the given parts."""
    price = lambda c: c.cast("long").cast("string")
    pool = t.read_table(spark, sf, "part").groupBy("p_type").agg(
        price(F.floor(F.min("p_retailprice"))).alias("low"), price(F.ceil(F.max("p_retailprice"))).alias("high")
    )
    entry = F.concat(F.lit("  - {name: "), "p_type", F.lit(", price_net_min: "), "low", F.lit(", price_net_max: "), "high", F.lit("}"))
    settings = "invoice: {tax_rate: 8}\ngeneration: {min_positions: 2, max_positions: 4, min_quantity: 3, max_quantity: 7}\nproducts:\n"
    path = work_path(spark, "settings")
    pool.agg(F.concat(F.lit(settings), F.array_join(F.sort_array(F.collect_list(entry)), "\n")).alias("value")).write.text(path)
    lines = gen.generate_lines(_seeds(spark, sf), source.load_generation_config(path, spark))
    return lines.select("seq", "line_no", "product", "quantity", *[from_grosze(F.col(f"{c}_gr")).alias(n) for c, n in (("unit_net", "unit_net"), ("tax", "tax"))])


@query("generate_invoices", f"""
WITH {GENERATED_SQL},
h AS (SELECT seq, DATE '2025-12-17' - CAST({_draw_sql('days', 0, 30, 'seq')} AS INTEGER) AS issue_date FROM seeds),
s AS (SELECT seq, count(*) AS line_count, CAST(sum(net_gr) AS BIGINT) AS n, CAST(sum(tax_gr) AS BIGINT) AS t FROM gen GROUP BY 1)
SELECT h.seq, issue_date, issue_date + 7 AS payment_to, h.seq || '/' || month(issue_date) || '/' || year(issue_date) AS number, line_count,
       {M('n')} AS net, {M('t')} AS tax, {M('n + t')} AS gross FROM h JOIN s ON s.seq = h.seq""")
def generate_invoices(spark, sf):
    made = gen.generate_invoices(_seeds(spark, sf), CONFIG, F.lit("2025-12-17").cast("date"))
    return made.select("seq", "issue_date", "payment_to", "number", "line_count", *[from_grosze(F.col(f"{c}_gr")).alias(c) for c in ("net", "tax", "gross")])


@query("generate_buyers", f"""
WITH {GENERATED_SQL}
SELECT seq, ['Tartak Sosenka', 'Piekarnia Zorza', 'Hurtownia Kotwica', 'Warsztat Iskra', 'Drukarnia Atrament', 'Mleczarnia Biedronka Polna',
            'Szkutnia Bryza', 'Garbarnia Rogoz', 'Cegielnia Glinka', 'Pasieka Lipowa', 'Kuznia Podkowa', 'Tkalnia Osnowa'][{_draw_sql('name', 0, 11, 'seq')} + 1] AS buyer_name,
       'ul. ' || ['Jarzebinowa', 'Mlynska', 'Rzeczna', 'Zbozowa', 'Kowalska'][{_draw_sql('street', 0, 4, 'seq')} + 1] || ' ' || {_draw_sql('house', 1, 100, 'seq')} AS buyer_street,
       {_draw_sql('post1', 10, 99, 'seq')} || '-' || {_draw_sql('post2', 100, 999, 'seq')} AS buyer_post_code FROM seeds""")
def generate_buyers(spark, sf):
    return gen.generate_buyers(_seeds(spark, sf), CONFIG).select("seq", "buyer_name", "buyer_street", "buyer_post_code")


def _sum_sql(text: str, weights: list[int], digits: int) -> str:
    terms = " + ".join(f"{weights[i % len(weights)]} * CAST(substr({text}, {i + 1}, 1) AS INTEGER)" for i in range(digits))
    return f"CAST((10 - ({terms}) % 10) % 10 AS VARCHAR)"


def _lpad_draw_sql(slot: str, digits: int) -> str:
    return f"lpad(CAST({_draw_sql(slot, 0, 10**digits - 1, 'seq')} AS VARCHAR), {digits}, '0')"


@query("generate_identifiers", f"""
WITH {GENERATED_SQL},
b AS (SELECT seq, '73' || {_lpad_draw_sql('nip0', 8)} AS nip, 'PPL' || {_lpad_draw_sql('peppol0', 6)} AS peppol_id, {_lpad_draw_sql('serial0', 4)} AS serial,
             DATE '1900-01-01' + CAST({_draw_sql('birth', 0, 146_096, 'seq')} AS INTEGER) AS day, {_lpad_draw_sql('account0', 12)} || {_lpad_draw_sql('account1', 12)} AS body
      FROM seeds),
p AS (SELECT *, lpad(CAST(year(day) % 100 AS VARCHAR), 2, '0') || lpad(CAST(month(day) + (year(day) // 100 - 19) * 20 AS VARCHAR), 2, '0')
             || lpad(CAST(day(day) AS VARCHAR), 2, '0') || serial AS born, '0' || {_sum_sql('body', [3, 9, 7, 1], 24)} || body AS account FROM b)
SELECT seq, nip, peppol_id, born || {_sum_sql('born', [1, 3, 7, 9], 10)} AS pesel, account,
       'PL' || lpad(CAST(98 - CAST(account || '252100' AS HUGEINT) % 97 AS VARCHAR), 2, '0') || account AS iban FROM p""")
def generate_identifiers(spark, sf):
    return gen.generate_identifiers(_seeds(spark, sf)).select("seq", "nip", "peppol_id", "pesel", "account", "iban")


# Forms of VAT numbers: d a digit, a a letter, x a letter or digit, s also + and *, b 0 or 1; capitals are themselves.
VAT_FORMS_SQL = """forms(country, list) AS (VALUES
  ('AT', ['Udddddddd']), ('BE', ['bddddddddd']), ('BG', ['ddddddddd', 'dddddddddd']), ('CY', ['dddddddda']), ('CZ', ['dddddddd', 'ddddddddd', 'dddddddddd']),
  ('DE', ['ddddddddd']), ('DK', ['dddddddd']), ('EE', ['ddddddddd']), ('EL', ['ddddddddd']), ('ES', ['adddddddd', 'dddddddda', 'addddddda']), ('FI', ['dddddddd']),
  ('FR', ['xxddddddddd']), ('HR', ['ddddddddddd']), ('HU', ['dddddddd']), ('IE', ['dddddddaa', 'dsddddda']), ('IT', ['ddddddddddd']),
  ('LT', ['ddddddddd', 'dddddddddddd']), ('LU', ['dddddddd']), ('LV', ['ddddddddddd']), ('MT', ['dddddddd']), ('NL', ['ssssssssssss']), ('PT', ['ddddddddd']),
  ('RO', ['dd', 'ddd', 'dddd', 'ddddd', 'dddddd', 'ddddddd', 'dddddddd', 'ddddddddd', 'dddddddddd']), ('SE', ['dddddddddddd']), ('SI', ['dddddddd']),
  ('SK', ['dddddddddd']), ('XI', ['ddddddddd', 'dddddddddddd', 'GDddd', 'HAddd']))"""
_PLACES_SQL = " || ".join(
    f"""coalesce(CASE substr(form, {i + 1}, 1) WHEN '' THEN '' WHEN 'd' THEN substr('0123456789', 1 + r{i} % 10, 1) WHEN 'b' THEN substr('01', 1 + r{i} % 2, 1)
      WHEN 'a' THEN chr(CAST(65 + r{i} % 26 AS INTEGER)) WHEN 'x' THEN substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 1 + r{i} % 36, 1)
      WHEN 's' THEN substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+*', 1 + r{i} % 38, 1) ELSE substr(form, {i + 1}, 1) END, '')""" for i in range(12)
)


@query("generate_vat_numbers", f"""
WITH {GENERATED_SQL}, {VAT_FORMS_SQL},
n AS (SELECT *, row_number() OVER (ORDER BY country) - 1 AS place FROM forms),
r AS (SELECT seq, {_draw_sql('country', 0, 26, 'seq')} AS place, {_draw_sql('form', 0, 2**30 - 1, 'seq')} AS f,
             {', '.join(f"{_draw_sql(f'vat{i}', 0, 2**30 - 1, 'seq')} AS r{i}" for i in range(12))} FROM seeds),
d AS (SELECT *, list[1 + f % len(list)] AS form FROM r JOIN n USING (place))
SELECT seq, country || {_PLACES_SQL} AS vat_eu, TRUE AS is_vat_eu FROM d""")
def generate_vat_numbers(spark, sf):
    made = gen.generate_identifiers(_seeds(spark, sf))
    return made.select("seq", "vat_eu", ids.check_vat_eu(F.col("vat_eu")).alias("is_vat_eu"))


# --- Streaming ---------------------------------------------------------------------------------------------
def _stream(spark, sf):
    """The events as a stream; the glob lets the table be one file or a folder."""
    schema = t.read_table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf.rstrip('/')}/events.parque[t]")
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("timestamp"), F.col("user_id").cast("string").alias("correlation_id"), "event_type",
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"), F.get_json_object("props", "$.k").alias("k"),
    )


@query("stream_errors", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1""")
def stream_errors(spark, sf):
    rate = jobs.run_upserts(jobs.stream_error_rate(_stream(spark, sf)), "stream-errors", ["window_start", "window_end"])
    return rate.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "errors")


@query("stream_dedupe", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS correlation_id, props->>'k' AS k FROM events")
def stream_dedupe(spark, sf):
    first = jobs.stream_dedupe(_stream(spark, sf), ["correlation_id", "k"])
    return jobs.run_available(first, "stream-dedupe").select("correlation_id", "k")


@query("stream_traces", """
WITH g AS (SELECT CAST(user_id AS VARCHAR) AS correlation_id, ts, event_type,
             CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY correlation_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT correlation_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(max(ts) + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS ended,
       count(*) AS records, bool_or(event_type = 'error') AS has_error FROM s GROUP BY correlation_id, n""")
def stream_traces(spark, sf):
    parts = jobs.run_upserts(jobs.stream_trace_parts(_stream(spark, sf)), "stream-traces", ["window_start", "correlation_id"])
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return jobs.join_traces(parts).select("correlation_id", stamp("started"), stamp("ended"), "records", "has_error")


TRACKER_SECONDS = 6 * 3600


@query("stream_sessions", f"""
WITH e AS (SELECT user_id, event_type, epoch_us(ts) // 1000000 AS s FROM events WHERE event_type IN ('signup', 'purchase')),
o AS (SELECT user_id, min(s) AS opened_s FROM e WHERE event_type = 'signup' GROUP BY 1),
a AS (SELECT o.user_id, opened_s, min(s) AS accepted_s FROM o LEFT JOIN e ON e.user_id = o.user_id AND e.event_type = 'purchase'
        AND s BETWEEN opened_s AND opened_s + {TRACKER_SECONDS} GROUP BY 1, 2)
SELECT user_id AS session_id, opened_s, coalesce(accepted_s, -1) AS accepted_s,
       CASE WHEN accepted_s IS NOT NULL THEN 'done' WHEN opened_s + {TRACKER_SECONDS} < (SELECT max(s) FROM e) THEN 'timed out' ELSE 'waiting' END AS outcome
FROM a""")
def stream_sessions(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "opened").when(F.col("event_type") == "purchase", "accepted")
    status = _stream(spark, sf).select(F.col("correlation_id").cast("long").alias("session_id"), kind.alias("kind"), "timestamp")
    tracker = jobs.stream_session_tracker(status, {"opened": (("accepted", TRACKER_SECONDS),)})
    tracked = jobs.run_upserts(tracker, "stream-sessions", ["session_id"], ["final"])
    events = t.read_table(spark, sf, "events").where("event_type IN ('signup', 'purchase')")
    newest = events.agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp")))).scalar()
    accepted = F.when(F.col("outcome") == "done", F.col("reached_s")).otherwise(F.lit(-1).cast("long"))
    return jobs.sessions_as_of(tracked, newest).select("session_id", "opened_s", accepted.alias("accepted_s"), "outcome")


# Sessions with a planted course, by the remainder of their id: kind of the event, its second after the opening.
COURSES = [
    [("opened", 0), ("accepted", 20), ("receipt", 70)], [("opened", 0)], [("opened", 0), ("accepted", 60)],
    [("opened", 0), ("accepted", 61), ("receipt", 80)], [("opened", 0), ("accepted", 10), ("receipt", 71)],
    [("batch_opened", 0), ("processed", 30)], [("batch_opened", 0), ("processed", 31)], [("accepted", 5)],
]
ARRIVALS = 4


def session_status(spark, sf):
    """``session_id, kind, timestamp, arrival``: one session per signup; those of every other eight ids arrive five minutes late."""
    signups = t.read_table(spark, sf, "events").where("event_type = 'signup'").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    steps = F.array(*[F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("s")) for k, s in course]) for course in COURSES])
    course = F.element_at(steps, (F.col("event_id") % len(COURSES) + 1).cast("int"))
    rows = signups.select("event_id", "ts", F.explode(course).alias("step"))
    at = F.timestamp_seconds(F.unix_seconds("ts") + F.col("step.s"))
    rows = rows.select(F.col("event_id").alias("session_id"), "step.kind", at.alias("timestamp"))
    return rows.withColumn("arrival", F.unix_seconds("timestamp") + F.when(F.col("session_id") % 16 < 8, 300).otherwise(0))


@query("stream_session_stages", f"""
WITH e AS (SELECT event_id, event_id % 8 AS c, epoch_us(ts) // 1000000 AS s FROM events WHERE event_type = 'signup'),
plan(c, opening, reached, after, waits, dead, done) AS (VALUES
  (0, 'opened', 'receipt', 70, NULL, 70, true), (1, 'opened', 'opened', 0, 'accepted', 60, false), (2, 'opened', 'accepted', 60, 'receipt', 120, false),
  (3, 'opened', 'opened', 0, 'accepted', 60, false), (4, 'opened', 'accepted', 10, 'receipt', 70, false),
  (5, 'batch_opened', 'processed', 30, NULL, 30, true), (6, 'batch_opened', 'batch_opened', 0, 'processed', 30, false)),
newest AS (SELECT max(s + CASE c WHEN 0 THEN 70 WHEN 1 THEN 0 WHEN 2 THEN 60 WHEN 3 THEN 80 WHEN 4 THEN 71 WHEN 5 THEN 30 WHEN 6 THEN 31 ELSE 5 END) AS n FROM e)
SELECT event_id AS session_id, opening, s AS opened_s, reached, s + after AS reached_s, waits AS waiting_for, s + dead AS deadline_s,
       CASE WHEN done THEN 'done' WHEN s + dead < n THEN 'timed out' ELSE 'waiting' END AS outcome
FROM e JOIN plan USING (c) CROSS JOIN newest""")
def stream_session_stages(spark, sf):
    """The records arrive in several runs, which go on from one checkpoint, and not in the order of their times."""
    status = session_status(spark, sf)
    first, last, newest = status.agg(F.min("arrival"), F.max("arrival"), F.max(F.unix_seconds("timestamp"))).first()
    inbox, out, checkpoint = (work_path(spark, f"stages-{name}") for name in ("inbox", "out", "checkpoint"))
    schema = status.drop("arrival").schema
    arrival = ((F.col("arrival") - first) * ARRIVALS / (last - first + 1)).cast("int")
    for i in range(ARRIVALS):
        status.where(arrival == i).drop("arrival").write.mode("append").parquet(inbox)
        tracker = jobs.stream_session_tracker(spark.readStream.schema(schema).parquet(inbox))
        tracked = jobs.run_upserts(tracker, "stages", ["session_id"], ["final"], out, checkpoint)
    return jobs.sessions_as_of(tracked, F.lit(newest))


@query("stream_validate", f"""
WITH {t.totals_sql()} SELECT invoice_id, CASE WHEN invoice_id % 3 = 0 THEN 'quarantine' ELSE 'valid' END AS target FROM invoices""")
def stream_validate(spark, sf):
    xml = convert.to_fa_xml(records(spark, sf, False, True), 2, created_at()).select("invoice_id", "xml")
    broken = F.when(F.col("invoice_id") % 3 == 0, F.replace("xml", F.lit("<P_16>2</P_16>"), F.lit(""))).otherwise(F.col("xml"))
    inbox, valid, bad = (work_path(spark, name) for name in ("inbox", "valid", "quarantine"))
    xml.withColumn("xml", broken).write.parquet(inbox)
    arriving = spark.readStream.schema("invoice_id long, xml string").parquet(inbox)
    handle = jobs.stream_validate(arriving, 2, valid, bad)
    writer = arriving.writeStream.foreachBatch(handle).option("checkpointLocation", work_path(spark, "validate-checkpoint"))
    writer.trigger(availableNow=True).start().awaitTermination()
    schema = "invoice_id long, xml string"
    read = lambda path, name: spark.read.schema(schema).parquet(path).select("invoice_id", F.lit(name).alias("target"))
    return read(valid, "valid").unionByName(read(bad, "quarantine"))


# --- A log that grows --------------------------------------------------------------------------------------
def append_lines(spark, lines, folder):
    """Append ``host, at, value`` to one log file per host, in the order ``at``; a host is written by one task.

    A repeated task finds what the lost one has written and goes on behind it.
    """
    log = LogFolder(folder, "*.log")
    log.files.create_dir(log.root, recursive=True)
    sizes = {f.base_name: f.size for f in log.files.get_file_info(pafs.FileSelector(log.root)) if f.base_name.endswith(".log")}

    def write(batches):
        files, root = LogFolder(folder, "*").files, log.root
        name = sink = None
        for batch in batches:
            for host, value in zip(batch.column("host").to_pylist(), batch.column("value").to_pylist()):
                if name != f"host-{host}.log":
                    if sink is not None:
                        sink.close()
                    name = f"host-{host}.log"
                    there = files.get_file_info(f"{root}/{name}")
                    skip = (there.size or 0) - sizes.get(name, 0)
                    sink = files.open_append_stream(f"{root}/{name}", compression=None)
                line = f"{value}\n".encode()
                sink.write(line[min(skip, len(line)):])
                skip -= min(skip, len(line))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])
        if sink is not None:
            sink.close()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.repartition(parts, "host").sortWithinPartitions("host", "at")
    return ordered.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def rotate(folder):
    """Rename every log file: ``x.log`` to ``x.log.1``, an older ``x.log.1`` to ``x.log.2``."""
    log = LogFolder(folder, "*.log*")
    for path in sorted(log.paths(), reverse=True):
        name, _, number = path.partition(".log")
        log.files.move(path, f"{name}.log.{int(number.lstrip('.') or 0) + 1}")


@query("stream_event_log", """
SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level FROM events""")
def stream_event_log(spark, sf):
    """Logs that are written, appended to, rotated, written anew, appended to and rotated again, followed all the while."""
    from faktorium.plans.log_queries import event_log

    folder, out, checkpoint = (work_path(spark, f"followed-{name}") for name in ("logs", "out", "checkpoint"))
    log = event_log(spark, sf)
    lines = log.select(
        F.pmod(F.xxhash64("correlation_id"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))).alias("host"), F.col("event_id").alias("at"),
        F.to_json(F.struct("timestamp", "level", "message", "event_type", "event_id")).alias("value"),
    )
    for step in range(4):
        append_lines(spark, lines.where(F.col("at") % 4 == step), folder)
        if step % 2:
            rotate(folder)
        read = jobs.run_available(stream_log(spark, folder, pattern="host-*.log*"), "followed", path=out, checkpoint=checkpoint)
    return read.select(F.col("extra")["event_id"].cast("long").alias("event_id"), "event_type", "level")
