"""Queries on identifiers and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from faktorium import codes
from faktorium.functions import checks, ids, text, words
from faktorium.functions.money import from_grosze, round_half_up
from faktorium.plans import tables as t
from faktorium.plans.payments import REFS_SQL, _originals
from faktorium.plans.registry import query

M = t.money_sql


def _headers(spark, sf):
    return t.invoice_headers(spark, sf)


@query("normalise_tax_id", f"""
WITH {t.HEADERS_SQL} SELECT invoice_id, buyer_nip AS tax_id FROM headers""")
def normalise_tax_id(spark, sf):
    n = F.col("buyer_nip")
    part = lambda a, b: F.substring(n, a, b)
    raw = (
        F.when(F.col("invoice_id") % 3 == 0, F.concat_ws("-", part(1, 3), part(4, 3), part(7, 2), part(9, 2)))
        .when(F.col("invoice_id") % 3 == 1, F.concat_ws(" ", part(1, 3), part(4, 3), part(7, 2), part(9, 2)))
        .otherwise(n)
    )
    return _headers(spark, sf).select("invoice_id", ids.normalise_tax_id(raw).alias("tax_id"))


NIP_RAW_SQL = t.HEADERS_SQL + """,
raw AS (
  SELECT invoice_id, CASE invoice_id % 6 WHEN 0 THEN '0' || substr(buyer_nip, 2) WHEN 1 THEN substr(buyer_nip, 1, 9)
         WHEN 2 THEN '100' || substr(buyer_nip, 4) WHEN 3 THEN buyer_nip || '-' || lpad(CAST(customer_id % 100000 AS VARCHAR), 5, '0')
         WHEN 4 THEN buyer_nip || '1234' ELSE buyer_nip END AS nip
  FROM headers)
"""


@query("nip_check", f"""
WITH {NIP_RAW_SQL}
SELECT invoice_id, nip, regexp_full_match(nip, '[1-9](([0-9][1-9])|([1-9][0-9]))[0-9]{{7}}') AS is_nip,
       regexp_full_match(nip, '[1-9](([0-9][1-9])|([1-9][0-9]))[0-9]{{7}}-[0-9]{{5}}') AS is_internal_id
FROM raw""")
def nip_check(spark, sf):
    n, k = F.col("buyer_nip"), F.col("invoice_id") % 6
    raw = (
        F.when(k == 0, F.concat(F.lit("0"), F.substring(n, 2, 9)))
        .when(k == 1, F.substring(n, 1, 9))
        .when(k == 2, F.concat(F.lit("100"), F.substring(n, 4, 7)))
        .when(k == 3, F.concat_ws("-", n, F.lpad((F.col("customer_id") % 100000).cast("string"), 5, "0")))
        .when(k == 4, F.concat(n, F.lit("1234")))
        .otherwise(n)
    )
    rows = _headers(spark, sf).select("invoice_id", raw.alias("nip"))
    return rows.select(
        "invoice_id", "nip", ids.check_nip(F.col("nip")).alias("is_nip"), ids.check_internal_id(F.col("nip")).alias("is_internal_id")
    )


PESEL_SQL = t.HEADERS_SQL + """,
d AS (SELECT invoice_id, 1900 + invoice_id % 400 AS y, 1 + customer_id % 12 AS m, 1 + invoice_id % 31 AS dd, customer_id % 10000 AS s
      FROM headers),
b AS (SELECT invoice_id, y, m, dd,
        lpad(CAST(y % 100 AS VARCHAR), 2, '0') || lpad(CAST(m + (y // 100 - 19) * 20 AS VARCHAR), 2, '0')
        || lpad(CAST(dd AS VARCHAR), 2, '0') || lpad(CAST(s AS VARCHAR), 4, '0') AS base
      FROM d),
c AS (SELECT *, (10 - list_sum([CAST(substr(base, i, 1) AS INTEGER)
                  * [1, 3, 7, 9, 1, 3, 7, 9, 1, 3][i] for i in range(1, 11)]) % 10) % 10 AS control FROM b),
p AS (SELECT *, base || CASE WHEN invoice_id % 2 = 0 THEN control ELSE invoice_id % 10 END AS pesel FROM c)
"""


def _pesel(spark, sf):
    y, m = F.col("invoice_id") % 400 + 1900, F.col("customer_id") % 12 + 1
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    base = F.concat(
        pad(y % 100, 2), pad(m + (F.floor(y / 100) - 19) * 20, 2), pad(F.col("invoice_id") % 31 + 1, 2),
        pad(F.col("customer_id") % 10000, 4),
    )
    rows = _headers(spark, sf).select("invoice_id", base.alias("base"))
    last = F.when(F.col("invoice_id") % 2 == 0, ids.pesel_control(F.col("base"))).otherwise(F.col("invoice_id") % 10)
    return rows.select("invoice_id", F.concat("base", last.cast("string")).alias("pesel"))


@query("pesel_control", f"""
WITH {PESEL_SQL}
SELECT invoice_id, pesel, CAST(control AS INTEGER) AS control FROM p""")
def pesel_control(spark, sf):
    return _pesel(spark, sf).withColumn("control", ids.pesel_control(F.col("pesel")))


@query("pesel_check", f"""
WITH {PESEL_SQL},
q AS (SELECT *, TRY_CAST(y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(dd AS VARCHAR), 2, '0') AS DATE) AS born FROM p)
SELECT invoice_id, born, born IS NOT NULL AND CAST(substr(pesel, 11, 1) AS INTEGER) = control AS is_valid FROM q""")
def pesel_check(spark, sf):
    return _pesel(spark, sf).select(
        "invoice_id", ids.pesel_birth_date(F.col("pesel")).alias("born"), ids.check_pesel(F.col("pesel")).alias("is_valid")
    )


ACCOUNT_SQL = t.LINES_SQL + """,
a AS (SELECT invoice_id, raw_line_no, part_id, supplier_id, quantity,
             lpad(CAST(supplier_id * 7919 + 10200000 AS VARCHAR), 8, '0')
             || lpad(CAST(part_id * 104729 + invoice_id AS VARCHAR), 16, '0') AS account FROM lines),
k AS (SELECT *, lpad(CAST((10 - list_sum([CAST(substr(account, i, 1) AS INTEGER)
               * [3, 9, 7, 1][(i - 1) % 4 + 1] for i in range(1, 25)]) % 10) % 10 AS VARCHAR), 2, '0') AS pair FROM a),
i AS (SELECT *, lpad(CAST(98 - CAST(pair || account || '252100' AS HUGEINT) % 97 AS VARCHAR), 2, '0') AS iban_pair FROM k)
"""


def _accounts(spark, sf):
    account = F.concat(
        F.lpad((F.col("supplier_id") * 7919 + 10200000).cast("string"), 8, "0"),
        F.lpad((F.col("part_id") * 104729 + F.col("invoice_id")).cast("string"), 16, "0"),
    )
    rows = t.invoice_lines(spark, sf).select("invoice_id", "raw_line_no", "part_id", "supplier_id", account.alias("account"))
    return rows.withColumn("pair", ids.account_check_digits(F.col("account")))


@query("account_check_digits", f"""
WITH {ACCOUNT_SQL} SELECT invoice_id, part_id, supplier_id, account, pair FROM i""")
def account_check_digits(spark, sf):
    return _accounts(spark, sf).select("invoice_id", "part_id", "supplier_id", "account", "pair")


@query("iban_check_digits", f"""
WITH {ACCOUNT_SQL} SELECT invoice_id, part_id, supplier_id, iban_pair FROM i""")
def iban_check_digits(spark, sf):
    full = F.concat("pair", "account")
    return _accounts(spark, sf).select(
        "invoice_id", "part_id", "supplier_id", ids.iban_check_digits(full).alias("iban_pair")
    )


@query("iban_check", f"""
WITH {ACCOUNT_SQL},
v AS (SELECT *, lpad(CAST(98 - CAST(account || '252100' AS HUGEINT) % 97 AS VARCHAR), 2, '0') AS short_pair,
             lpad(CAST(part_id % 100 AS VARCHAR), 2, '0') AS other FROM i),
g AS (SELECT *, CASE WHEN raw_line_no % 2 = 0 THEN short_pair ELSE other END AS given_short,
             CASE WHEN raw_line_no % 2 = 0 THEN iban_pair ELSE other END AS given_long FROM v)
SELECT invoice_id, part_id, supplier_id, given_short = short_pair AS is_standard, given_long = iban_pair AS is_reference FROM g""")
def iban_check(spark, sf):
    full = F.concat("pair", "account")
    given = lambda pair: F.when(F.col("raw_line_no") % 2 == 0, pair).otherwise(F.lpad((F.col("part_id") % 100).cast("string"), 2, "0"))
    rows = _accounts(spark, sf).select(
        "invoice_id", "part_id", "supplier_id",
        F.concat(F.lit("PL"), given(ids.iban_check_digits(F.col("account"))), "account").alias("short"),
        F.concat(F.lit("PL"), given(ids.iban_check_digits(full)), full).alias("long"),
    )
    return rows.select(
        "invoice_id", "part_id", "supplier_id",
        ids.check_iban_pl(F.col("short")).alias("is_standard"), ids.check_iban_pl(F.col("long"), "reference").alias("is_reference"),
    )


_COUNTRIES = list(codes.VAT_EU_GRAMMAR)
_GRAMMAR_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in codes.VAT_EU_GRAMMAR.items())
VAT_EU_SQL = t.HEADERS_SQL + f""",
grammar(country, pattern) AS (VALUES {_GRAMMAR_VALUES}),
n AS (SELECT invoice_id, buyer_nip, [{', '.join(repr(c) for c in _COUNTRIES)}][1 + customer_id % {len(_COUNTRIES)}] AS country,
        CASE invoice_id % 5 WHEN 0 THEN 'U' ELSE '' END || substr(lpad(CAST(invoice_id * 7919 + 12345678 AS VARCHAR), 12, '1'), 1, CAST(7 + invoice_id % 6 AS INTEGER))
        || CASE invoice_id % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'AB' ELSE '' END AS number FROM headers),
v AS (SELECT n.*, regexp_full_match(number, pattern) AS is_vat_eu, regexp_full_match(number, '([0-9]|[A-Z]|[+]|[*]){{1,12}}') AS is_generic
      FROM n JOIN grammar g ON g.country = n.country)
"""


def _vat_eu(spark, sf):
    i = F.col("invoice_id")
    country = F.element_at(F.array(*[F.lit(c) for c in _COUNTRIES]), (F.col("customer_id") % len(_COUNTRIES) + 1).cast("int"))
    digits = F.substring(F.lpad((i * 7919 + 12345678).cast("string"), 12, "1"), F.lit(1), (i % 6 + 7).cast("int"))
    number = F.concat(
        F.when(i % 5 == 0, "U").otherwise(""), digits, F.when(i % 7 == 0, "A").when(i % 7 == 1, "AB").otherwise("")
    )
    return _headers(spark, sf).select("invoice_id", "buyer_nip", country.alias("country"), number.alias("number"))


@query("vat_eu_check", f"WITH {VAT_EU_SQL} SELECT invoice_id, country, number, is_vat_eu, is_generic FROM v")
def vat_eu_check(spark, sf):
    return _vat_eu(spark, sf).select(
        "invoice_id", "country", "number", ids.check_vat_eu(F.concat("country", "number")).alias("is_vat_eu"),
        checks.check_generic_vat(F.col("number")).alias("is_generic"),
    )


@query("compose_nip_vat_eu", f"""
WITH {VAT_EU_SQL} SELECT invoice_id, buyer_nip || '-' || country || number AS composite, is_vat_eu AS is_valid FROM v""")
def compose_nip_vat_eu(spark, sf):
    composite = ids.compose_nip_vat_eu(F.col("buyer_nip"), F.concat("country", "number"))
    return _vat_eu(spark, sf).select("invoice_id", composite.alias("composite")).withColumn(
        "is_valid", ids.check_nip_vat_eu(F.col("composite"))
    )


@query("parse_clearance_number", f"""
WITH {REFS_SQL}
SELECT invoice_id, CASE WHEN invoice_id % 4 <> 3 THEN seller_nip END AS taxpayer,
       CASE WHEN invoice_id % 4 <> 3 AND NOT (invoice_id % 4 = 2 AND FALSE) THEN
         CASE WHEN invoice_id % 4 = 2 THEN NULL ELSE issue_date + CAST(7305 AS INTEGER) END END AS received_on,
       invoice_id % 4 < 2 AS is_valid
FROM originals""")
def parse_clearance_number(spark, sf):
    number, k = F.col("clearance_number"), F.col("invoice_id") % 4
    later = F.date_format(F.date_add("issue_date", 7305), "yyyyMMdd")
    tail = F.substring(number, 20, 17)
    raw = (
        F.when(k == 3, F.concat(F.lit("0"), number))
        .when(k == 2, F.concat_ws("-", "seller_nip", F.lit("20300230"), F.substring(number, 21, 16)))
        .otherwise(F.concat_ws("-", "seller_nip", later, F.substring(number, 21, 16)))
    )
    parsed = _originals(spark, sf).select("invoice_id", checks.parse_clearance_number(raw).alias("p"))
    return parsed.select("invoice_id", "p.taxpayer", "p.received_on", "p.is_valid")


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _group_sql(n: str) -> str:
    return (
        f"trim(regexp_replace({_sql_list(codes.HUNDREDS)}[{n} // 100 + 1] || ' ' || CASE WHEN ({n} % 100) // 10 = 1 "
        f"THEN {_sql_list(codes.TEENS)}[{n} % 10 + 1] ELSE {_sql_list(codes.TENS)}[({n} % 100) // 10 + 1] || ' ' || "
        f"{_sql_list(codes.ONES)}[{n} % 10 + 1] END, ' +', ' ', 'g'))"
    )


def _plural_sql(n: str, forms) -> str:
    return (
        f"CASE WHEN {n} = 1 THEN '{forms[0]}' WHEN {n} % 10 IN (2, 3, 4) AND ({n} % 100 < 10 OR {n} % 100 >= 20) "
        f"THEN '{forms[1]}' ELSE '{forms[2]}' END"
    )


@query("amount_words", f"""
WITH {t.LINES_SQL}, s AS (
  SELECT invoice_id, part_id, supplier_id, ext_gr * (1 + part_id % 40) AS gr FROM lines),
z AS (SELECT *, gr // 100 AS z, gr % 100 AS g, gr // 100000 AS th, (gr // 100) % 1000 AS u FROM s)
SELECT invoice_id, part_id, supplier_id, gr,
  CASE WHEN gr = 0 THEN 'zero złotych zero groszy' ELSE
    CASE WHEN z = 0 THEN 'zero' WHEN z < 1000 THEN {_group_sql('z')}
         WHEN z < 1000000 THEN trim(CASE WHEN th = 1 THEN 'tysiąc' ELSE {_group_sql('th')} || ' ' || {_plural_sql('th', codes.THOUSAND_FORMS)} END
              || ' ' || {_group_sql('u')})
         ELSE CAST(z AS VARCHAR) END || ' ' || {_plural_sql('z', codes.ZLOTY_FORMS)}
    || CASE WHEN g > 0 THEN ' ' || {_group_sql('g')} || ' ' || {_plural_sql('g', codes.GROSZ_FORMS)} ELSE '' END
  END AS words
FROM z""".replace("z < 1000 THEN", "z < 1000 THEN"))
def amount_words(spark, sf):
    rows = t.invoice_lines(spark, sf).select(
        "invoice_id", "part_id", "supplier_id", (F.col("ext_gr") * (F.col("part_id") % 40 + 1)).alias("gr")
    )
    return rows.withColumn("words", words.amount_in_words_pl(F.col("gr")))


@query("plural_form", f"""
WITH {t.LINES_SQL} SELECT invoice_id, part_id, quantity, {_plural_sql('part_id', codes.GROSZ_FORMS)} AS form FROM lines""")
def plural_form(spark, sf):
    return t.invoice_lines(spark, sf).select(
        "invoice_id", "part_id", "quantity", words.plural_form(F.col("part_id"), codes.GROSZ_FORMS).alias("form")
    )


@query("payment_labels", f"""
WITH {t.HEADERS_SQL},
k AS (SELECT invoice_id, ['cash', 'transfer', 'card', 'barter'][1 + customer_id % 4] AS kind FROM headers)
SELECT invoice_id, CASE kind WHEN 'cash' THEN 'Gotówka' WHEN 'card' THEN 'Karta' ELSE 'Przelew' END AS label,
       CASE kind WHEN 'cash' THEN '1' WHEN 'card' THEN '2' ELSE '6' END AS code FROM k""")
def payment_labels(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ("cash", "transfer", "card", "barter")])
    label = text.payment_label(F.element_at(kinds, (F.col("customer_id") % 4 + 1).cast("int")))
    return _headers(spark, sf).select("invoice_id", label.alias("label")).withColumn("code", text.payment_code(F.col("label")))


AMOUNT_TEXT_SQL = t.HEADERS_SQL + """,
p AS (SELECT invoice_id, declared_gr, CAST(declared_gr // 100 AS VARCHAR) AS w, lpad(CAST(declared_gr % 100 AS VARCHAR), 2, '0') AS c FROM headers)
"""


@query("normalise_amount", f"""
WITH {AMOUNT_TEXT_SQL}
SELECT invoice_id, w || '.' || c AS plain,
       CASE WHEN invoice_id % 4 = 1 THEN w || c || '.00' WHEN invoice_id % 4 = 3 THEN w || '.00' ELSE w || '.' || c END AS as_reference
FROM p""".replace("w || '.' || c AS plain", "CASE WHEN invoice_id % 4 = 3 THEN w || '.00' ELSE w || '.' || c END AS plain"))
def normalise_amount(spark, sf):
    k, whole = F.col("invoice_id") % 4, F.call_function("div", F.col("declared_gr"), F.lit(100))
    grouped = lambda mark: F.regexp_replace(F.format_number(whole, 0), ",", mark)
    cents = F.lpad((F.col("declared_gr") % 100).cast("string"), 2, "0")
    raw = (
        F.when(k == 0, F.concat(grouped(","), F.lit("."), cents))
        .when(k == 1, F.concat(grouped(" "), F.lit(","), cents))
        .when(k == 2, F.concat(whole.cast("string"), F.lit("."), cents))
        .otherwise(grouped(" "))
    )
    rows = _headers(spark, sf).select("invoice_id", raw.alias("raw"))
    return rows.select(
        "invoice_id", text.normalise_amount(F.col("raw")).alias("plain"),
        text.normalise_amount(F.col("raw"), "reference").alias("as_reference"),
    )


@query("normalise_date", f"""
WITH {t.HEADERS_SQL} SELECT invoice_id, strftime(issue_date, '%Y-%m-%d') AS iso, strftime(issue_date, '%m') AS month,
  CASE WHEN invoice_id % 2 = 0 THEN strftime(issue_date, '%m') ELSE '01' END AS month_or_default FROM headers""")
def normalise_date(spark, sf):
    pattern = lambda p: F.date_format("issue_date", p)
    k = F.col("invoice_id") % 4
    raw = (
        F.when(k == 0, pattern("dd.MM.yyyy")).when(k == 1, pattern("dd/MM/yyyy")).when(k == 2, pattern("dd-MM-yyyy"))
        .otherwise(pattern("yyyy-MM-dd"))
    )
    name = F.when(F.col("invoice_id") % 2 == 0, pattern("MMMM")).otherwise("Brumaire")
    return _headers(spark, sf).select(
        "invoice_id", text.normalise_date(raw).alias("iso"),
        text.month_from_name(F.upper(pattern("MMMM")), strict=True).alias("month"),
        text.month_from_name(name).alias("month_or_default"),
    )


@query("round_half_up", f"""
WITH {t.LINES_SQL} SELECT invoice_id, part_id, ext_gr, quantity,
  {M('(2 * ext_gr * 15 + 100) // 200')} AS rounded FROM lines""")
def round_half_up_query(spark, sf):
    value = from_grosze(F.col("ext_gr")).cast("decimal(18,2)") * F.lit("0.15").cast("decimal(3,2)")
    return t.invoice_lines(spark, sf).select(
        "invoice_id", "part_id", "ext_gr", "quantity", round_half_up(value).cast("decimal(18,2)").alias("rounded")
    )


@query("collapse_whitespace", """
SELECT doc_id, md5(c) AS digest, length(c) AS chars
FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS c FROM documents)""")
def collapse_whitespace(spark, sf):
    docs = t.read_table(spark, sf, "documents").select("doc_id", text.collapse_whitespace(F.col("text")).alias("c"))
    return docs.select("doc_id", F.md5("c").alias("digest"), F.length("c").cast("long").alias("chars"))


@query("content_hash", """
SELECT doc_id, base64(unhex(sha256(text))) AS sha256_b64, CAST(strlen(text) AS BIGINT) AS size_bytes,
       length(base64(encode(text))) AS base64_chars FROM documents""")
def content_hash(spark, sf):
    body = F.encode("text", "UTF-8")
    return t.read_table(spark, sf, "documents").select(
        "doc_id", text.content_hash(F.col("text")).alias("sha256_b64"), text.byte_size(F.col("text")).alias("size_bytes"),
        F.length(text.to_base64(body)).cast("long").alias("base64_chars"),
    )


@query("document_file_name", f"""
WITH {t.HEADERS_SQL} SELECT invoice_id,
  'faktura-' || invoice_id || '-' || month(issue_date) || '-' || year(issue_date) || '.json' AS file_name FROM headers""")
def document_file_name(spark, sf):
    number = F.concat_ws("/", "invoice_id", F.month("issue_date"), F.year("issue_date"))
    return _headers(spark, sf).select("invoice_id", text.document_file_name(number).alias("file_name"))


@query("label_quantity", f"""
WITH {t.LINES_SQL} SELECT invoice_id, part_id, supplier_id, quantity || ' szt' AS label FROM lines""")
def label_quantity(spark, sf):
    return t.invoice_lines(spark, sf).select(
        "invoice_id", "part_id", "supplier_id", text.label_quantity(F.col("quantity"), F.lit("szt")).alias("label")
    )


@query("json_extra_fields", """
SELECT event_id, 2 AS extras, props->>'k' AS k, event_type AS kind FROM events""")
def json_extra_fields(spark, sf):
    line = F.concat(
        F.lit('{"level":"INFO","message":"m","event_type":"'), F.col("event_type"), F.lit('",'),
        F.substring("props", F.lit(2), F.length("props") - 1),
    )
    rows = t.read_table(spark, sf, "events").select("event_id", text.json_extra_fields(line, ["level", "message"]).alias("x"))
    return rows.select("event_id", F.size("x").alias("extras"), F.col("x")["k"].alias("k"), F.col("x")["event_type"].alias("kind"))


@query("attachment_metadata", f"""
WITH {t.NUMBERED_SQL},
last AS (SELECT invoice_id, raw_line_no, max(line_no) AS line_no FROM numbered GROUP BY 1, 2),
v AS (SELECT l.invoice_id, l.raw_line_no, n.part_id FROM last l JOIN numbered n ON n.invoice_id = l.invoice_id AND n.line_no = l.line_no)
SELECT invoice_id, count(*) AS keys, CAST(max(CASE WHEN raw_line_no = 1 THEN part_id END) AS VARCHAR) AS first_value
FROM v GROUP BY 1""")
def attachment_metadata(spark, sf):
    from faktorium.operators import lines as ops
    from faktorium.plans.payments import numbered_lines

    nested = ops.nest_lines(numbered_lines(spark, sf), ["raw_line_no", "part_id"])
    pairs = F.transform(
        "positions",
        lambda p: F.struct(
            F.concat(F.lit("K"), p["raw_line_no"].cast("string")).alias("ZKlucz"), p["part_id"].cast("string").alias("ZWartosc")
        ),
    )
    mapped = nested.select("invoice_id", text.attachment_metadata(pairs).alias("m"))
    return mapped.select("invoice_id", F.size("m").cast("long").alias("keys"), F.col("m")["K1"].alias("first_value"))
