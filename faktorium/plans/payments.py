"""Queries on payments, settlements, corrections and numbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from faktorium.functions import text
from faktorium.functions.money import from_grosze
from faktorium.operators import corrections as corr
from faktorium.operators import lines as ops
from faktorium.operators import numbering
from faktorium.operators import payments as pay
from faktorium.operators import skew
from faktorium.plans import tables as t
from faktorium.plans.registry import query

M = t.money_sql


def _gross(spark, sf):
    return t.invoice_headers(spark, sf).select("invoice_id", F.col("declared_gr").alias("gross_gr"))


@query("payment_state", f"""
WITH {t.HEADERS_SQL},
p AS (SELECT invoice_id, declared_gr, CASE status WHEN 'P' THEN declared_gr // 2 WHEN 'O' THEN 0 ELSE declared_gr END AS paid_gr
      FROM headers)
SELECT invoice_id, {M('declared_gr')} AS gross, {M('paid_gr')} AS paid,
       {M('greatest(0, declared_gr - paid_gr)')} AS still_due FROM p""")
def payment_state(spark, sf):
    paid = F.when(F.col("status") == "P", F.call_function("div", F.col("declared_gr"), F.lit(2))).when(
        F.col("status") == "O", F.lit(0)
    )
    headers = t.invoice_headers(spark, sf).select(
        "invoice_id", from_grosze(F.col("declared_gr")).alias("gross"), from_grosze(paid).alias("paid")
    )
    return pay.payment_state(headers)


@query("due_date", f"""
WITH {t.HEADERS_SQL}
SELECT invoice_id, issue_date, CAST(issue_date + INTERVAL 7 DAY AS DATE) AS payment_to FROM headers""")
def due_date(spark, sf):
    return t.invoice_headers(spark, sf).select(
        "invoice_id", "issue_date", text.due_date(F.col("issue_date"), 7).alias("payment_to")
    )


@query("settlement", f"""
WITH {t.AMOUNTS_SQL}, {t.HEADERS_SQL},
adj AS (SELECT invoice_id, sum(CASE WHEN return_flag = 'A' THEN gross_gr ELSE 0 END) AS c,
               sum(CASE WHEN return_flag = 'R' THEN gross_gr ELSE 0 END) AS d
        FROM amounts GROUP BY 1),
j AS (SELECT h.invoice_id, declared_gr AS g, coalesce(c, 0) AS c, coalesce(d, 0) AS d
      FROM headers h LEFT JOIN adj ON adj.invoice_id = h.invoice_id)
SELECT invoice_id, {M('g')} AS gross, {M('c')} AS charges, {M('d')} AS deductions,
       {M('greatest(g + c - d, 0)')} AS to_pay, {M('greatest(d - g - c, 0)')} AS to_settle FROM j""")
def settlement(spark, sf):
    lines = ops.line_amounts(t.invoice_lines(spark, sf))
    kind = F.when(F.col("return_flag") == "A", "charge").when(F.col("return_flag") == "R", "deduction")
    adjustments = lines.select("invoice_id", kind.alias("kind"), F.col("gross_gr").alias("amount_gr"))
    return pay.settlement(_gross(spark, sf), adjustments)


@query("partial_payments", f"""
WITH {t.AMOUNTS_SQL}, {t.HEADERS_SQL},
p AS (SELECT invoice_id, count(*) AS n, sum(net_gr) AS paid_gr, max(ship_date) AS last_paid_on
      FROM amounts WHERE line_status = 'F' GROUP BY 1)
SELECT h.invoice_id, coalesce(n, 0) AS payment_count, {M('coalesce(paid_gr, 0)')} AS paid, last_paid_on,
       CASE WHEN coalesce(paid_gr, 0) = 0 THEN 'unpaid' WHEN paid_gr >= declared_gr THEN 'paid' ELSE 'partly' END AS state
FROM headers h LEFT JOIN p ON p.invoice_id = h.invoice_id""")
def partial_payments(spark, sf):
    paid = ops.line_amounts(t.invoice_lines(spark, sf)).where("line_status = 'F'")
    payments = paid.select("invoice_id", F.col("net_gr").alias("amount_gr"), F.col("ship_date").alias("paid_on"))
    return pay.partial_payments(_gross(spark, sf), payments)


@query("advance_balance", f"""
WITH {t.AMOUNTS_SQL}, {t.HEADERS_SQL},
a AS (SELECT invoice_id, sum(gross_gr) AS a FROM amounts WHERE return_flag = 'R' GROUP BY 1)
SELECT h.invoice_id, {M('coalesce(a, 0)')} AS advances, {M('declared_gr - coalesce(a, 0)')} AS balance
FROM headers h LEFT JOIN a ON a.invoice_id = h.invoice_id""")
def advance_balance(spark, sf):
    lines = ops.line_amounts(t.invoice_lines(spark, sf)).where("return_flag = 'R'")
    return pay.advance_balance(_gross(spark, sf), lines.select("invoice_id", F.col("gross_gr").alias("amount_gr")))


@query("buyer_shares", f"""
WITH {t.LINES_SQL}, {t.HEADERS_SQL},
s AS (SELECT invoice_id, count(*) AS buyers, count(CASE WHEN return_flag = 'R' THEN 1 END) AS given,
             coalesce(sum(CASE WHEN return_flag = 'R' THEN discount_pct END), 0) AS pct
      FROM lines GROUP BY 1),
m AS (SELECT h.invoice_id, coalesce(buyers, 0) AS buyers,
             CASE WHEN coalesce(given, 0) > 0 THEN (100 - pct) * 1000000
                  ELSE (200000000 + coalesce(buyers, 0) + 1) // (2 * (coalesce(buyers, 0) + 1)) END AS micro
      FROM headers h LEFT JOIN s ON s.invoice_id = h.invoice_id)
SELECT invoice_id, buyers,
       CAST(CAST(micro AS DECIMAL(18,0)) * CAST(0.000001 AS DECIMAL(6,6)) AS DECIMAL(18,6)) AS main_share,
       micro >= 0 AS is_consistent FROM m""")
def buyer_shares(spark, sf):
    share = F.when(F.col("return_flag") == "R", F.col("discount_pct").cast("decimal(9,6)"))
    others = t.invoice_lines(spark, sf).select("invoice_id", share.alias("share"))
    return pay.buyer_shares(t.invoice_headers(spark, sf).select("invoice_id"), others)


@query("foreign_vat_in_pln", f"""
WITH {t.AMOUNTS_SQL}, {t.HEADERS_SQL},
b AS (SELECT invoice_id, vat_code, CAST(sum(tax_gr) AS BIGINT) AS tax_gr FROM amounts GROUP BY 1, 2),
j AS (SELECT b.*, 4000000 + (customer_id % 1000) * 137 AS micro
      FROM b JOIN headers h ON h.invoice_id = b.invoice_id WHERE currency = 'EUR')
SELECT invoice_id, vat_code, {M('tax_gr')} AS tax,
       {M('(2 * tax_gr * micro + 1000000) // 2000000')} AS tax_pln FROM j""")
def foreign_vat_in_pln(spark, sf):
    per_code = ops.vat_summary(ops.line_amounts(t.invoice_lines(spark, sf))).select("invoice_id", "vat_code", "tax")
    headers = t.invoice_headers(spark, sf).where("currency = 'EUR'")
    micro = (4_000_000 + (F.col("customer_id") % 1000) * 137).cast("decimal(13,0)")
    rate = (micro * F.lit("0.000001").cast("decimal(6,6)")).cast("decimal(19,6)")
    joined = per_code.join(headers.select("invoice_id", rate.alias("rate")), "invoice_id")
    return joined.select(
        "invoice_id", "vat_code", "tax", pay.foreign_vat_in_pln(F.col("tax"), F.col("rate")).alias("tax_pln")
    )


@query("payment_deadlines", f"""
WITH {t.HEADERS_SQL},
d AS (
  SELECT invoice_id, 1 AS deadline_no, CAST(issue_date + INTERVAL 7 DAY AS DATE) AS due_on FROM headers
  UNION ALL
  SELECT invoice_id, 2, CASE WHEN status = 'O' THEN NULL
    ELSE CASE customer_id % 3 WHEN 0 THEN CAST(issue_date + CAST(customer_id % 12 AS INTEGER) * INTERVAL 1 DAY AS DATE)
         WHEN 1 THEN CAST(issue_date + 7 * CAST(customer_id % 12 AS INTEGER) * INTERVAL 1 DAY AS DATE)
         ELSE CAST(issue_date + CAST(customer_id % 12 AS INTEGER) * INTERVAL 1 MONTH AS DATE) END END
  FROM headers)
SELECT invoice_id, deadline_no, due_on FROM d""")
def payment_deadlines(spark, sf):
    unit = F.element_at(F.array(F.lit("dni"), F.lit("tygodni"), F.lit("miesięcy")), (F.col("customer_id") % 3 + 1).cast("int"))
    event = F.when(F.col("status") == "O", "dostawa towaru").otherwise("data wystawienia")
    none = F.lit(None)
    fixed = F.struct(
        F.date_add("issue_date", 7).alias("date"), none.cast("int").alias("count"),
        none.cast("string").alias("unit"), none.cast("string").alias("event"),
    )
    relative = F.struct(
        none.cast("date").alias("date"), (F.col("customer_id") % 12).cast("int").alias("count"),
        unit.alias("unit"), event.alias("event"),
    )
    return pay.payment_deadlines(t.invoice_headers(spark, sf).withColumn("deadlines", F.array(fixed, relative)))


@query("correction_delta", f"""
WITH {t.AMOUNTS_SQL}
SELECT invoice_id, raw_line_no AS line_no,
       {M("sum(CASE WHEN return_flag = 'A' THEN -net_gr ELSE net_gr END)")} AS net_delta,
       {M("sum(CASE WHEN return_flag = 'A' THEN -tax_gr ELSE tax_gr END)")} AS tax_delta,
       {M("sum(CASE WHEN return_flag = 'A' THEN -gross_gr ELSE gross_gr END)")} AS gross_delta
FROM amounts GROUP BY invoice_id, raw_line_no""")
def correction_delta(spark, sf):
    lines = ops.line_amounts(t.invoice_lines(spark, sf)).withColumn("before_correction", F.col("return_flag") == "A")
    return corr.correction_delta(lines.withColumn("line_no", F.col("raw_line_no")))


@query("correction_balance", f"""
WITH {t.HEADERS_SQL}
SELECT customer_id AS original_id, invoice_id AS document_id, issue_date,
       {M('sum(declared_gr) OVER (PARTITION BY customer_id ORDER BY issue_date, invoice_id ROWS UNBOUNDED PRECEDING)')} AS balance
FROM headers""")
def correction_balance(spark, sf):
    documents = t.invoice_headers(spark, sf).select(
        F.col("customer_id").alias("original_id"), F.col("invoice_id").alias("document_id"), "issue_date",
        F.col("declared_gr").alias("gross_gr"),
    )
    return corr.correction_running_balance(documents).drop("gross_gr")


REFS_SQL = t.HEADERS_SQL + """,
issued AS (
  SELECT invoice_id, issue_date, CAST(1230000000 + customer_id % 100 AS VARCHAR) AS seller_nip,
         invoice_id || '/' || month(issue_date) || '/' || year(issue_date) AS number, customer_id
  FROM headers),
originals AS (
  SELECT *, seller_nip || '-' || strftime(issue_date, '%Y%m%d') || '-' || printf('%06X', CAST(invoice_id % 16777216 AS INTEGER))
         || '-' || printf('%06X', CAST(customer_id % 16777216 AS INTEGER)) || '-00' AS clearance_number FROM issued),
corrections AS (
  SELECT o.invoice_id AS correction_id, o.issue_date AS correction_date, CAST(1 + o.invoice_id % 3 AS VARCHAR) AS kind,
         p.invoice_id AS ref_id, p.seller_nip, p.number AS ref_number, p.issue_date AS ref_date,
         CASE WHEN o.invoice_id % 2 = 0 THEN p.clearance_number END AS ref_clearance
  FROM originals o LEFT JOIN originals p ON p.invoice_id = o.invoice_id - 1)
"""


def _originals(spark, sf):
    issued = t.invoice_headers(spark, sf).select(
        "invoice_id", "issue_date", "customer_id", t.seller_nip(F.col("customer_id") % 100).alias("seller_nip"),
        F.concat_ws("/", "invoice_id", F.month("issue_date"), F.year("issue_date")).alias("number"),
    )
    block = lambda c: F.lpad(F.hex(F.col(c) % 16777216), 6, "0")
    return issued.withColumn(
        "clearance_number",
        F.concat_ws("-", "seller_nip", F.date_format("issue_date", "yyyyMMdd"), block("invoice_id"), block("customer_id"), F.lit("00")),
    )


def _corrections(spark, sf):
    originals = _originals(spark, sf)
    target = originals.select(
        (F.col("invoice_id") + 1).alias("correction_id"), "seller_nip", F.col("number").alias("ref_number"),
        F.col("issue_date").alias("ref_date"), F.col("clearance_number").alias("_clearance"),
    )
    own = originals.select(
        F.col("invoice_id").alias("correction_id"), F.col("issue_date").alias("correction_date"),
        (F.col("invoice_id") % 3 + 1).cast("string").alias("kind"),
    )
    even = F.col("correction_id") % 2 == 0
    return own.join(target, "correction_id", "left").withColumn("ref_clearance", F.when(even, F.col("_clearance"))).drop("_clearance")


@query("link_corrections", f"""
WITH {REFS_SQL}
SELECT correction_id, coalesce(ref_id, -1) AS original_id,
       CASE WHEN ref_id IS NULL THEN 'none' WHEN correction_id % 2 = 0 THEN 'clearance' ELSE 'number' END AS linked_by
FROM corrections""")
def link_corrections(spark, sf):
    linked = corr.link_corrections(_corrections(spark, sf), _originals(spark, sf))
    return linked.select("correction_id", F.coalesce("original_id", F.lit(-1)).alias("original_id"), "linked_by")


# Orders of a customer as chains of corrections: each corrects the one before, up to 20 in a row; the first order of a
# chain is the invoice, but for every seventh customer, where it points to the end of its chain.
CHAINS_SQL = f"""
WITH RECURSIVE {t.HEADERS_SQL},
o AS (SELECT invoice_id, customer_id, row_number() OVER (PARTITION BY customer_id ORDER BY invoice_id) - 1 AS k,
             2 + customer_id % 20 AS length FROM headers),
c AS (SELECT invoice_id, customer_id, k // length AS chain, k % length AS place FROM o),
ends AS (SELECT customer_id, chain, max_by(invoice_id, place) AS last_id, count(*) AS members FROM c GROUP BY 1, 2),
links AS (SELECT c.invoice_id AS correction_id, CASE WHEN place > 0 THEN p.invoice_id ELSE last_id END AS original_id
  FROM c JOIN ends USING (customer_id, chain) LEFT JOIN (SELECT invoice_id, customer_id, chain, place + 1 AS place FROM c) p USING (customer_id, chain, place)
  WHERE place > 0 OR (customer_id % 7 = 0 AND members > 1)),
walk AS (
  SELECT correction_id, original_id AS at, 1 AS depth FROM links
  UNION ALL
  SELECT w.correction_id, l.original_id, depth + 1 FROM walk w JOIN links l ON l.correction_id = w.at WHERE depth < 25),
found AS (SELECT w.correction_id, w.at AS root_id, depth FROM walk w ANTI JOIN links l ON l.correction_id = w.at)
SELECT l.correction_id, l.original_id, root_id, CAST(depth AS BIGINT) AS depth, root_id IS NULL AS is_cycle
FROM links l LEFT JOIN found USING (correction_id)"""


@query("correction_chains", CHAINS_SQL)
def correction_chains(spark, sf):
    headers = t.invoice_headers(spark, sf).select("invoice_id", "customer_id")
    numbered = skew.number_rows(headers, ["customer_id"], [F.col("invoice_id")], [F.floor(F.col("invoice_id") / 1_000_000)], "n")
    length, k = F.col("customer_id") % 20 + 2, F.col("n") - 1
    members = numbered.select("invoice_id", "customer_id", F.floor(k / length).alias("chain"), (k % length).alias("place"))
    before = members.select(F.col("invoice_id").alias("_before"), "customer_id", "chain", (F.col("place") + 1).alias("place"))
    ends = members.groupBy("customer_id", "chain").agg(F.max_by("invoice_id", "place").alias("_last"), F.count(F.lit(1)).alias("_members"))
    joined = members.join(before, ["customer_id", "chain", "place"], "left").join(ends, ["customer_id", "chain"])
    circle = F.when((F.col("customer_id") % 7 == 0) & (F.col("_members") > 1), F.col("_last"))
    linked = joined.select(F.col("invoice_id").alias("correction_id"), F.coalesce("_before", circle).alias("original_id"))
    return corr.correction_chains(spark, linked.where("original_id IS NOT NULL"))


@query("correction_effect_date", f"""
WITH {REFS_SQL}
SELECT correction_id, kind, CASE kind WHEN '1' THEN ref_date WHEN '2' THEN correction_date END AS effect_date
FROM corrections""")
def correction_effect_date(spark, sf):
    linked = corr.link_corrections(_corrections(spark, sf), _originals(spark, sf))
    effect = corr.correction_effect_date(F.col("kind"), F.col("original_date"), F.col("correction_date"))
    return linked.select("correction_id", "kind", effect.alias("effect_date"))


@query("link_advances", f"""
WITH {t.HEADERS_SQL},
refs AS (SELECT invoice_id, invoice_id - 1 AS reference FROM headers UNION ALL SELECT invoice_id, invoice_id - 2 FROM headers)
SELECT r.invoice_id, r.reference, {M('h.declared_gr')} AS advance
FROM refs r LEFT JOIN headers h ON h.invoice_id = r.reference""")
def link_advances(spark, sf):
    headers = t.invoice_headers(spark, sf)
    refs = F.array(F.col("invoice_id") - 1, F.col("invoice_id") - 2)
    final = headers.select("invoice_id", refs.alias("advance_refs"))
    advances = headers.select(F.col("invoice_id").alias("reference"), from_grosze(F.col("declared_gr")).alias("advance"))
    return corr.link_advances(final, advances)


@query("link_changed_buyers", f"""
WITH {t.LINES_SQL},
b AS (SELECT invoice_id, raw_line_no AS link_id, min(supplier_id) AS buyer_before FROM lines WHERE return_flag = 'A' GROUP BY 1, 2),
a AS (SELECT invoice_id, raw_line_no AS link_id, min(supplier_id) AS buyer_after FROM lines WHERE return_flag <> 'A' GROUP BY 1, 2)
SELECT b.invoice_id, b.link_id, buyer_before, buyer_after, buyer_before <> buyer_after AS is_changed
FROM b JOIN a ON a.invoice_id = b.invoice_id AND a.link_id = b.link_id""")
def link_changed_buyers(spark, sf):
    parties = t.invoice_lines(spark, sf).select(
        "invoice_id", F.col("raw_line_no").alias("link_id"), F.col("supplier_id").alias("buyer"), "return_flag"
    )
    keys = ["invoice_id", "link_id"]
    before = skew.first_per_key(parties.where("return_flag = 'A'"), keys, ["buyer"])
    after = skew.first_per_key(parties.where("return_flag <> 'A'"), keys, ["buyer"])
    return corr.link_changed_buyers(before, after, keys)


def numbered_lines(spark, sf, lines=None):
    lines = t.invoice_lines(spark, sf) if lines is None else lines
    return ops.number_lines(lines, t.LINE_ORDER, [F.col("raw_line_no"), F.floor(F.col("supplier_id") / 64)])


@query("number_lines", f"""
WITH {t.NUMBERED_SQL} SELECT invoice_id, line_no, part_id, supplier_id, quantity FROM numbered""")
def number_lines(spark, sf):
    return numbered_lines(spark, sf).select("invoice_id", "line_no", "part_id", "supplier_id", "quantity")


@query("nest_explode_roundtrip", f"""
WITH {t.NUMBERED_SQL} SELECT invoice_id, line_no, part_id, quantity, unit_net_gr, vat_code FROM numbered""")
def nest_explode_roundtrip(spark, sf):
    fields = ["part_id", "quantity", "unit_net_gr", "vat_code"]
    return ops.explode_lines(ops.nest_lines(numbered_lines(spark, sf), fields), ["invoice_id"])


@query("nest_lines", f"""
WITH {t.NUMBERED_SQL}
SELECT invoice_id, count(*) AS line_count,
       string_agg(line_no || ':' || part_id, ',' ORDER BY line_no) AS content
FROM numbered GROUP BY 1""")
def nest_lines(spark, sf):
    nested = ops.nest_lines(numbered_lines(spark, sf), ["part_id"])
    content = F.array_join(F.transform("positions", lambda p: F.concat_ws(":", p["line_no"], p["part_id"])), ",")
    return nested.select("invoice_id", F.size("positions").cast("long").alias("line_count"), content.alias("content"))


@query("invoice_numbering", f"""
WITH {t.totals_sql()}
SELECT invoice_id, seller_nip, row_number() OVER (PARTITION BY seller_nip, year(issue_date), month(issue_date)
         ORDER BY issue_date, invoice_id) || '/' || month(issue_date) || '/' || year(issue_date) AS number
FROM invoices""")
def invoice_numbering(spark, sf):
    numbered = numbering.number_invoices(t.invoices(spark, sf).select("invoice_id", "issue_date", "seller_nip"))
    return numbered.select("invoice_id", "seller_nip", "number")


@query("batch_numbering", f"""
WITH {t.HEADERS_SQL}
SELECT invoice_id, row_number() OVER (ORDER BY invoice_id) || '/' || month(issue_date) || '/' || year(issue_date) AS number
FROM headers""")
def batch_numbering(spark, sf):
    headers = t.invoice_headers(spark, sf).withColumn("batch_id", F.lit(1))
    return numbering.number_invoices(headers, "batch").select("invoice_id", "number")


@query("page_of_invoices", f"""
WITH {t.HEADERS_SQL} SELECT invoice_id, customer_id FROM headers WHERE invoice_id > 100 ORDER BY invoice_id LIMIT 100""")
def page_of_invoices(spark, sf):
    return numbering.page_of_invoices(t.invoice_headers(spark, sf).select("invoice_id", "customer_id"), "invoice_id", 100, 100)


@query("sort_documents", f"""
WITH {t.HEADERS_SQL} SELECT 'faktura-' || invoice_id || '-' || month(issue_date) || '.xml' AS file_name, invoice_id
FROM headers ORDER BY file_name""")
def sort_documents(spark, sf):
    named = t.invoice_headers(spark, sf).select(
        text.document_file_name(F.concat_ws("/", "invoice_id", F.month("issue_date")), "xml").alias("file_name"), "invoice_id"
    )
    return numbering.sort_documents(named)
