"""Queries on formats, conversion, text and extraction; documents are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from faktorium import schemas
from faktorium.functions import text as text_functions
from faktorium.functions.money import from_grosze
from faktorium.operators import canonical, convert, extract
from faktorium.operators import lines as ops
from faktorium.operators import reconcile as rec
from faktorium.plans import tables as t
from faktorium.plans.registry import query
from faktorium.session import work_path
from faktorium.sources import invoices as source

M = t.money_sql
CITIES = ["Warszawa", "Krakow", "Wroclaw", "Poznan", "Gdansk"]
CREATED = "2025-12-17 19:20:03"


def records(spark, sf, with_lines=True, with_buckets=False):
    """Invoice records with positions, and with the sums of the VAT buckets that have lines."""
    lines = ops.line_amounts(t.invoice_lines(spark, sf, by_invoice=with_lines))
    buckets = ops.bucket_sums(ops.bucket_of(F.col("vat_code"))) if with_buckets else []
    text = lambda column: column.cast("string")
    totals = [*[F.sum(f"{c}_gr").alias(f"{c}_gr") for c in ("net", "tax", "gross")], t.first_supplier().alias("_first"), *buckets]
    if with_lines:
        shown = lambda name: text(from_grosze(F.col(f"{name}_gr")))
        position = {
            "name": F.concat(F.lit("Towar "), text(F.col("part_id"))), "quantity_unit": F.lit("szt"), "quantity": text(F.col("quantity")),
            "price_net": shown("unit_net"), "tax": F.col("vat_code"), "total_price_net": shown("net"), "total_price_tax": shown("tax"),
            "total_price_gross": shown("gross"),
        }
        sums = ops.nest_in_order(lines, t.POSITION_ORDER, position, totals)
    else:
        sums = lines.groupBy("invoice_id").agg(*totals)
    sums = sums.withColumn("supplier_id", t.supplier_of(F.col("_first")))
    # The narrow headers are the hashed side: rows with all their positions are not sorted for the join.
    header = t.invoice_headers(spark, sf).hint("shuffle_hash").join(sums, "invoice_id")
    c, i = F.col("customer_id"), F.col("invoice_id")
    amount = lambda name: text(from_grosze(F.col(f"{name}_gr")))
    return header.select(
        "invoice_id",
        F.concat_ws("/", i, F.month("issue_date"), F.year("issue_date")).alias("number"),
        text(F.col("issue_date")).alias("issue_date"), text(F.col("issue_date")).alias("sell_date"),
        text(F.date_add("issue_date", 7)).alias("payment_to"),
        F.element_at(F.array(F.lit("cash"), F.lit("transfer"), F.lit("card")), (c % 3 + 1).cast("int")).alias("payment_type"),
        amount("net").alias("price_net"), amount("tax").alias("price_tax"), amount("gross").alias("price_gross"),
        amount("gross").alias("paid"), F.lit("PLN").alias("currency"), F.lit("vat").alias("kind"),
        F.concat(F.lit("Dostawca "), text(F.col("supplier_id"))).alias("seller_name"),
        t.seller_nip(F.col("supplier_id")).alias("seller_tax_no"),
        F.concat(F.lit("ul. Polna "), text(F.col("supplier_id"))).alias("seller_street"),
        F.lit("00-950").alias("seller_post_code"), F.lit("Warszawa").alias("seller_city"), F.lit("PL").alias("seller_country"),
        F.lit("PKO BP").alias("seller_bank"), F.lit("12345678901234567890123456").alias("seller_bank_account"),
        F.lit("Jan Kowalski").alias("seller_person"),
        F.concat(F.lit("Odbiorca & Syn "), text(c)).alias("buyer_name"), F.col("buyer_nip").alias("buyer_tax_no"),
        F.concat(F.lit("ul. Kwiatowa "), text(c % 100)).alias("buyer_street"),
        F.concat_ws("-", F.lpad(text(c % 100), 2, "0"), F.lpad(text(i % 1000), 3, "0")).alias("buyer_post_code"),
        F.element_at(F.array(*[F.lit(x) for x in CITIES]), (c % 5 + 1).cast("int")).alias("buyer_city"),
        F.lit("PL").alias("buyer_country"),
        *[amount(c.removesuffix("_gr")).alias(c.removesuffix("_gr")) for c in sums.columns if c.startswith(("p_13_", "p_14_"))],
        *(["positions"] if with_lines else []),
    )


RECORDS_SQL = t.totals_sql() + f""",
records AS (
  SELECT invoice_id, invoice_id || '/' || month(issue_date) || '/' || year(issue_date) AS number,
         strftime(issue_date, '%Y-%m-%d') AS issue_date,
         ['cash', 'transfer', 'card'][1 + customer_id % 3] AS payment_type,
         {M('net_gr')} AS net, {M('tax_gr')} AS tax, {M('gross_gr')} AS gross,
         'Dostawca ' || (CAST(seller_nip AS BIGINT) - 1230000000) AS seller_name, seller_nip,
         'ul. Polna ' || (CAST(seller_nip AS BIGINT) - 1230000000) AS seller_street,
         'Odbiorca & Syn ' || customer_id AS buyer_name, buyer_nip, 'ul. Kwiatowa ' || (customer_id % 100) AS buyer_street,
         lpad(CAST(customer_id % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(invoice_id % 1000 AS VARCHAR), 3, '0') AS buyer_post_code,
         ['Warszawa', 'Krakow', 'Wroclaw', 'Poznan', 'Gdansk'][1 + customer_id % 5] AS buyer_city,
         line_count, customer_id
  FROM invoices)
"""

# Header fields of the canonical invoice that every format carries.
HEADER_SQL = "number, CAST(issue_date AS DATE) AS issue_date, seller_name, seller_nip, buyer_name, buyer_nip, net, tax, gross"
HEADER = ["number", "issue_date", "seller_name", "seller_nip", "buyer_name", "buyer_nip", "net", "tax", "gross"]
LINES_OUT_SQL = f"""
SELECT n.invoice_id || '' AS id, line_no, 'Towar ' || part_id AS name, CAST(quantity AS DECIMAL(22,6)) AS quantity,
       vat_code, {M('net_gr')} AS net FROM numbered n"""


# The summary elements of the buckets that have lines, in the order of the schema.
BUCKET_CODES = {"1": "'23','22'", "2": "'8','7'", "3": "'5'", "4": "'4','3'", "6_1": "'0'", "7": "'zw'"}
_SUMMARY_PARTS = " || ".join(
    f"coalesce('<P_{kind}_{b}>' || {M(f'sum(CASE WHEN vat_code IN ({c}) THEN {amount} END)')} || '</P_{kind}_{b}>' || chr(10) || '        ', '')"
    for b, c in BUCKET_CODES.items() for kind, amount in ((13, "net_gr"), (14, "tax_gr")) if kind == 13 or b in "1234"
)
SUMMARY_SQL = f"summaries AS (SELECT invoice_id, {_SUMMARY_PARTS} AS summary FROM numbered GROUP BY invoice_id)"


def _fa_xml_sql(variant: int) -> str:
    namespace = {2: "http://crd.gov.pl/wzor/2023/06/29/12648/", 3: "http://crd.gov.pl/wzor/2025/06/25/13775/"}[variant]
    zone = "Z" if variant == 3 else ""
    flags = "<JST>2</JST>|        <GV>2</GV>|    " if variant == 3 else ""
    esc = lambda c: f"' || replace({c}, '&', '&amp;') || '"
    text = f"""<Faktura xmlns="{namespace}">
    <Naglowek>
        <KodFormularza kodSystemowy="FA ({variant})" wersjaSchemy="1-0E">FA</KodFormularza>
        <WariantFormularza>{variant}</WariantFormularza>
        <DataWytworzeniaFa>2025-12-17T19:20:03{zone}</DataWytworzeniaFa>
    </Naglowek>
    <Podmiot1>
        <DaneIdentyfikacyjne>
            <NIP>{esc('seller_nip')}</NIP>
            <Nazwa>{esc('seller_name')}</Nazwa>
        </DaneIdentyfikacyjne>
        <Adres>
            <KodKraju>PL</KodKraju>
            <AdresL1>{esc('seller_street')}</AdresL1>
        </Adres>
    </Podmiot1>
    <Podmiot2>
        <DaneIdentyfikacyjne>
            <NIP>{esc('buyer_nip')}</NIP>
            <Nazwa>{esc('buyer_name')}</Nazwa>
        </DaneIdentyfikacyjne>
        <Adres>
            <KodKraju>PL</KodKraju>
            <AdresL1>{esc("buyer_street || ', ' || buyer_post_code || ' ' || buyer_city")}</AdresL1>
        </Adres>
{'        <JST>2</JST>' + chr(10) + '        <GV>2</GV>' + chr(10) if flags else ''}    </Podmiot2>
    <Fa>
        <KodWaluty>PLN</KodWaluty>
        <P_1>{esc('issue_date')}</P_1>
        <P_2>{esc('number')}</P_2>
        ' || summary || '<P_15>' || gross || '</P_15>
        <Adnotacje>
            <P_16>2</P_16>
            <P_17>2</P_17>
            <P_18>2</P_18>
            <P_18A>2</P_18A>
            <Zwolnienie>
                <P_19N>1</P_19N>
            </Zwolnienie>
            <NoweSrodkiTransportu>
                <P_22N>1</P_22N>
            </NoweSrodkiTransportu>
            <P_23>2</P_23>
            <PMarzy>
                <P_PMarzyN>1</P_PMarzyN>
            </PMarzy>
        </Adnotacje>
        <RodzajFaktury>VAT</RodzajFaktury>
    </Fa>
</Faktura>"""
    return f"WITH {RECORDS_SQL}, {SUMMARY_SQL} SELECT invoice_id, '{text}' AS xml FROM records JOIN summaries USING (invoice_id)"


def created_at():
    return F.lit(CREATED).cast("timestamp")


@query("to_fa_xml", _fa_xml_sql(2))
def to_fa_xml(spark, sf):
    return convert.to_fa_xml(records(spark, sf, False, True), 2, created_at()).select("invoice_id", "xml")


@query("to_fa_xml_variant_3", _fa_xml_sql(3))
def to_fa_xml_variant_3(spark, sf):
    return convert.to_fa_xml(records(spark, sf, False, True), 3, created_at()).select("invoice_id", "xml")


@query("fa_header", f"""
WITH {RECORDS_SQL} SELECT invoice_id, 'FA (3)' AS system_code, '1-0E' AS schema_version, 'FA' AS form, '3' AS variant,
  '2025-12-17T19:20:03Z' AS created FROM records""")
def fa_header(spark, sf):
    header = records(spark, sf, False).select("invoice_id", convert.fa_header(3, created_at()).alias("h"))
    return header.select(
        "invoice_id", F.col("h.KodFormularza._kodSystemowy").alias("system_code"), F.col("h.KodFormularza._wersjaSchemy").alias("schema_version"),
        F.col("h.KodFormularza._VALUE").alias("form"), F.col("h.WariantFormularza").alias("variant"), F.col("h.DataWytworzeniaFa").alias("created"),
    )


@query("fa_parties", f"""
WITH {RECORDS_SQL} SELECT invoice_id, seller_street AS seller_address, buyer_street || ', ' || buyer_post_code || ' ' || buyer_city AS buyer_address
FROM records""")
def fa_parties(spark, sf):
    seller, buyer = convert.fa_parties(2)
    rows = records(spark, sf, False).select("invoice_id", seller.alias("s"), buyer.alias("b"))
    return rows.select("invoice_id", F.col("s.Adres.AdresL1").alias("seller_address"), F.col("b.Adres.AdresL1").alias("buyer_address"))


@query("fa_body", f"""
WITH {RECORDS_SQL},
b AS (SELECT invoice_id, CAST({M("sum(CASE WHEN vat_code IN ('23', '22') THEN net_gr END)")} AS VARCHAR) AS net,
             CAST({M("sum(CASE WHEN vat_code = 'zw' THEN net_gr END)")} AS VARCHAR) AS exempt FROM numbered GROUP BY 1)
SELECT invoice_id, number, b.net, exempt, CAST(gross AS VARCHAR) AS gross, 'VAT' AS kind,
  '2' AS p_16, '1' AS p_19n, '1' AS p_22n FROM records JOIN b USING (invoice_id)""")
def fa_body(spark, sf):
    base = records(spark, sf, False, True)
    rows = base.select("invoice_id", convert.fa_body(base).alias("f"))
    return rows.select(
        "invoice_id", F.col("f.P_2").alias("number"), F.col("f.P_13_1").alias("net"), F.col("f.P_13_7").alias("exempt"), F.col("f.P_15").alias("gross"),
        F.col("f.RodzajFaktury").alias("kind"), F.col("f.Adnotacje.P_16").alias("p_16"),
        F.col("f.Adnotacje.Zwolnienie.P_19N").alias("p_19n"), F.col("f.Adnotacje.NoweSrodkiTransportu.P_22N").alias("p_22n"),
    )


@query("fill_defaults", f"""
WITH {RECORDS_SQL}
SELECT invoice_id, 'PL' AS seller_country, CASE WHEN customer_id % 3 = 0 THEN 'transfer' ELSE payment_type END AS payment_type,
       CASE WHEN customer_id % 2 = 0 THEN 'Warszawa' ELSE buyer_city END AS buyer_city FROM records""")
def fill_defaults(spark, sf):
    n = F.regexp_extract("buyer_name", r"(\d+)$", 1).cast("long")
    holes = (
        records(spark, sf, False)
        .withColumn("seller_country", F.when(n % 3 == 0, "").when(n % 3 == 1, F.lit(None)).otherwise("PL"))
        .withColumn("payment_type", F.when(n % 3 != 0, F.col("payment_type")))
        .withColumn("buyer_city", F.when(n % 2 == 0, "  ").otherwise(F.col("buyer_city")))
    )
    return convert.fill_defaults(holes).select("invoice_id", "seller_country", "payment_type", "buyer_city")


def _lines_out(invoices):
    lines = canonical.canonical_lines(invoices.withColumn("invoice_id", F.substring_index("number", "/", 1)))
    return lines.select(F.col("invoice_id").alias("id"), "line_no", "name", "quantity", "vat_code", "net")


@query("xml_roundtrip", f"WITH {t.NUMBERED_SQL} {LINES_OUT_SQL}")
def xml_roundtrip(spark, sf):
    xml = convert.to_fa_xml(records(spark, sf, True, True), 2, created_at(), indent="").select("xml")
    return _lines_out(canonical.to_canonical(source.parse_fa_xml(xml, 2, paths=canonical.canonical_paths("fa2")).select("document.*"), "fa2"))


@query("read_fa_xml", f"WITH {RECORDS_SQL} SELECT {HEADER_SQL}, line_count, FALSE AS is_broken FROM records")
def read_fa_xml(spark, sf):
    path = work_path(spark, "fa-xml")
    source.write_fa_xml(records(spark, sf, True, True), path, 2, created_at())
    read = source.read_fa_xml(spark, path, 2)
    invoices = canonical.to_canonical(read.where(F.col(source.CORRUPT).isNull()), "fa2")
    return invoices.select(*HEADER, F.size("lines").cast("long").alias("line_count"), F.lit(False).alias("is_broken"))


def _full_record(spark, sf):
    base = records(spark, sf)
    positions = F.transform("positions", lambda p: F.struct(
        *[(p[f] if f in ("name", "price_net", "quantity", "total_price_gross", "total_price_net", "quantity_unit", "tax", "total_price_tax")
           else F.lit(None).cast("string")).alias(f) for f in schemas.POSITION_FIELDS.split()]))
    columns = []
    for f in schemas.INVOICE_JSON.fields:
        if f.name == "positions":
            columns.append(positions.alias("positions"))
        elif f.name in base.columns:
            columns.append(F.col(f.name))
        elif f.name in schemas.BOOLEAN_FIELDS:
            columns.append(F.lit(f.name != "show_discount").alias(f.name))
        else:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
    return base.select(*columns)


@query("read_invoice_json", f"WITH {RECORDS_SQL} SELECT {HEADER_SQL}, line_count, payment_type FROM records")
def read_invoice_json(spark, sf):
    path = work_path(spark, "invoice-json")
    source.write_invoice_json(_full_record(spark, sf), path)
    invoices = canonical.to_canonical(source.read_invoice_json(spark, path, multi_line=False), "json")
    return invoices.select(*HEADER, F.size("lines").cast("long").alias("line_count"), "payment_type")


@query("json_lines_roundtrip", f"WITH {t.NUMBERED_SQL} {LINES_OUT_SQL}")
def json_lines_roundtrip(spark, sf):
    document = _full_record(spark, sf).select(F.to_json(F.struct("*")).alias("j"))
    parsed = document.select(F.from_json("j", schemas.INVOICE_JSON).alias("d")).select("d.*")
    return _lines_out(canonical.to_canonical(parsed, "json"))


def _accounting_documents(spark, sf):
    full = _full_record(spark, sf)
    kinds = {"price_net": "decimal", "price_tax": "decimal", "price_gross": "decimal", "issue_date": "date", "paid": "decimal"}

    def element(column, name):
        nil = F.when(column.isNull(), "true").alias("_nil")
        kind = [F.lit(kinds[name]).alias("_type")] if name in kinds else []
        return F.struct(*kind, nil, column.cast("string").alias("_VALUE")).alias(name.replace("_", "-"))

    header = [element(F.col(f.name), f.name) for f in full.schema.fields if f.name != "positions"]
    position = F.transform("positions", lambda p: F.struct(
        F.lit("InvoicePosition").alias("_type"), *[element(p[f], f) for f in schemas.POSITION_FIELDS.split()]))
    body = F.struct(*header, F.struct(F.lit("array").alias("_type"), position.alias("position")).alias("positions"))
    return full.select(body.alias("document"))


@query("read_accounting_xml", f"WITH {RECORDS_SQL} SELECT {HEADER_SQL}, line_count, payment_type FROM records")
def read_accounting_xml(spark, sf):
    path = work_path(spark, "accounting-xml")
    source.write_xml(_accounting_documents(spark, sf), F.col("document"), path, "invoice", "invoices")
    invoices = canonical.to_canonical(source.read_accounting_xml(spark, path, canonical.canonical_paths("accounting")), "accounting")
    return invoices.select(*HEADER, F.size("lines").cast("long").alias("line_count"), "payment_type")


def _ubl_documents(spark, sf):
    base = records(spark, sf)
    money = lambda value: F.struct(F.lit("PLN").alias("_currencyID"), value.alias("_VALUE"))

    def party(side):
        return F.struct(F.struct(
            F.struct(F.col(f"{side}_name").alias("Name")).alias("PartyName"),
            F.struct(
                F.col(f"{side}_street").alias("StreetName"), F.col(f"{side}_city").alias("CityName"),
                F.col(f"{side}_post_code").alias("PostalZone"),
                F.struct(F.col(f"{side}_country").alias("IdentificationCode")).alias("Country"),
            ).alias("PostalAddress"),
            F.struct(F.col(f"{side}_tax_no").alias("CompanyID")).alias("PartyTaxScheme"),
        ).alias("Party"))

    line = F.transform("positions", lambda p, i: F.struct(
        (i + 1).cast("string").alias("ID"),
        F.struct(F.lit("C62").alias("_unitCode"), p["quantity"].alias("_VALUE")).alias("InvoicedQuantity"),
        money(p["total_price_net"]).alias("LineExtensionAmount"),
        F.struct(p["name"].alias("Name"), F.struct(
            F.when(p["tax"] == "zw", "E").when(p["tax"] == "0", "Z").otherwise("S").alias("ID"),
            F.when(p["tax"] == "zw", "0").otherwise(p["tax"]).alias("Percent"),
        ).alias("ClassifiedTaxCategory")).alias("Item"),
        F.struct(p["price_net"].alias("PriceAmount")).alias("Price"),
    ))
    body = F.struct(
        F.col("number").alias("ID"), F.col("issue_date").alias("IssueDate"), F.col("payment_to").alias("DueDate"),
        F.lit("380").alias("InvoiceTypeCode"), F.col("currency").alias("DocumentCurrencyCode"),
        party("seller").alias("AccountingSupplierParty"), party("buyer").alias("AccountingCustomerParty"),
        F.struct(money(F.col("price_tax")).alias("TaxAmount")).alias("TaxTotal"),
        F.struct(
            money(F.col("price_net")).alias("TaxExclusiveAmount"), money(F.col("price_gross")).alias("TaxInclusiveAmount"),
            money(F.col("paid")).alias("PrepaidAmount"), money(F.lit("0.00")).alias("PayableAmount"),
        ).alias("LegalMonetaryTotal"),
        line.alias("InvoiceLine"),
    )
    return base.select(body.alias("document"))


@query("read_ubl_xml", f"WITH {RECORDS_SQL} SELECT {HEADER_SQL}, line_count FROM records")
def read_ubl_xml(spark, sf):
    path = work_path(spark, "ubl-xml")
    source.write_xml(_ubl_documents(spark, sf), F.col("document"), path, "Invoice", "Invoices")
    invoices = canonical.to_canonical(source.read_ubl_xml(spark, path), "ubl")
    return invoices.select(*HEADER, F.size("lines").cast("long").alias("line_count"))


@query("source_union", f"""
WITH {RECORDS_SQL} SELECT source_format, seller_nip || '|' || number || '|' || issue_date AS invoice_id, gross
FROM records, (VALUES ('json'), ('accounting'), ('ubl'), ('fa2')) AS f(source_format)""")
def source_union(spark, sf):
    options = {"ignoreNamespace": "true"}
    json = canonical.to_canonical(_full_record(spark, sf), "json")
    kept = schemas.narrow(schemas.ACCOUNTING_XML, canonical.canonical_paths("accounting"))
    accounting = _accounting_documents(spark, sf).select(F.to_xml("document", {"rowTag": "invoice", "indent": ""}).alias("xml")).select(F.from_xml("xml", kept, options).alias("d")).select("d.*")
    ubl = _ubl_documents(spark, sf).select(F.to_xml("document", {"rowTag": "Invoice", "indent": ""}).alias("xml")).select(F.from_xml("xml", schemas.narrow(schemas.UBL_XML, canonical.canonical_paths("ubl")), options).alias("d")).select("d.*")
    fa = source.parse_fa_xml(convert.to_fa_xml(records(spark, sf, False, True), 2, created_at(), indent="").select("xml"), 2, paths=canonical.canonical_paths("fa2")).select("document.*")
    union = rec.union_sources(
        json, canonical.to_canonical(accounting, "accounting"), canonical.to_canonical(ubl, "ubl"), canonical.to_canonical(fa, "fa2")
    )
    return union.select("source_format", "invoice_id", "gross")


@query("check_wellformed", f"WITH {RECORDS_SQL} SELECT invoice_id, invoice_id % 3 <> 0 AS is_wellformed FROM records")
def check_wellformed(spark, sf):
    xml = convert.to_fa_xml(records(spark, sf, False, True), 2, created_at()).select("invoice_id", "xml")
    broken = xml.withColumn("xml", F.when(F.col("invoice_id") % 3 == 0, F.replace("xml", F.lit("</Naglowek>"), F.lit(""))).otherwise(F.col("xml")))
    return source.parse_fa_xml(broken, 2, paths=["Fa.P_2"]).select("invoice_id", "is_wellformed")


# --- Text and extraction ----------------------------------------------------------------------
def _with_vat_rows(spark, sf):
    summary = ops.vat_summary(ops.line_amounts(t.invoice_lines(spark, sf)))
    # at most one row per VAT code of the schema
    rows = summary.groupBy("invoice_id").agg(F.sort_array(F.collect_list(F.struct("vat_code", "net", "tax", "gross"))).alias("vat_rows"))
    return records(spark, sf).join(rows, "invoice_id")


EXTRACTED = ["number", "issue_date", "seller_name", "seller_tax_no", "seller_street", "buyer_name", "buyer_tax_no", "buyer_street",
             "buyer_post_code", "buyer_city", "price_net", "price_tax", "price_gross", "amount_due", "success"]


@query("text_roundtrip", f"""
WITH {RECORDS_SQL}
SELECT invoice_id, number, issue_date, seller_name, seller_nip AS seller_tax_no, substr(seller_street, 5) AS seller_street, buyer_name,
       buyer_nip AS buyer_tax_no, substr(buyer_street, 5) AS buyer_street, buyer_post_code, buyer_city, CAST(net AS VARCHAR) AS price_net,
       CAST(tax AS VARCHAR) AS price_tax, CAST(gross AS VARCHAR) AS price_gross, '0.00' AS amount_due,
       tax > 0 AS success FROM records""")
def text_roundtrip(spark, sf):
    documents = convert.render_invoice_text(_with_vat_rows(spark, sf)).select("invoice_id", "text")
    return extract.extract_invoice(documents).select("invoice_id", *EXTRACTED)


@query("render_invoice_text", f"""
WITH {RECORDS_SQL} SELECT invoice_id, 'Faktura numer ' || number AS title, 'Wartość brutto ' || gross || ' PLN' AS total,
  'Do zapłaty 0.00 PLN' AS due, line_count FROM records""")
def render_invoice_text(spark, sf):
    rendered = convert.render_invoice_text(_with_vat_rows(spark, sf)).select("invoice_id", F.split("text", "\n").alias("l"))
    line = lambda start: F.element_at(F.filter("l", lambda x: x.startswith(start)), 1)
    return rendered.select(
        "invoice_id", line("Faktura").alias("title"), line("Wartość brutto ").alias("total"), line("Do zap").alias("due"),
        F.size(F.filter("l", lambda x: x.rlike(r"^\d+ \| Towar"))).cast("long").alias("line_count"),
    )


def _english_documents(spark, sf):
    base = records(spark, sf, False)
    grouped = lambda c: F.format_number(F.col(c).cast("decimal(18,2)"), 2)
    day = F.col("issue_date").cast("date")
    text = F.concat_ws(
        "\n",
        F.lit("INVOICE"), F.col("seller_name"), F.concat(F.regexp_extract("seller_street", r"(\d+)$", 1), F.lit(" Main street")),
        F.concat(F.lit("NIP: "), F.col("seller_tax_no")),
        F.concat(F.lit("INVOICE # "), F.col("invoice_id").cast("string")),
        F.concat(F.lit("DATE: "), F.date_format(day, "dd MMMM, yyyy")),
        F.concat(F.lit("Bill To: "), F.col("buyer_name")),
        F.concat(F.lit("NIP "), F.concat_ws("-", F.substring("buyer_tax_no", 1, 3), F.substring("buyer_tax_no", 4, 3), F.substring("buyer_tax_no", 7, 2), F.substring("buyer_tax_no", 9, 2))),
        F.concat(F.lit("Aleja "), F.regexp_extract("buyer_street", r"(\d+)$", 1)),
        F.concat_ws(" ", "buyer_post_code", "buyer_city"),
        F.concat(F.lit("SUBTOTAL "), grouped("price_net"), F.lit(" zł")),
        F.concat(F.lit("VAT 23% EUR "), grouped("price_tax"), F.lit(" zł")),
        F.concat(F.lit("TOTAL "), grouped("price_gross"), F.lit(" zł")),
    )
    return base.select("invoice_id", text.alias("text"))


ENGLISH_SQL = f"""
WITH {RECORDS_SQL}
SELECT invoice_id, CAST(invoice_id AS VARCHAR) AS number, issue_date, seller_name, seller_nip AS seller_tax_no,
       substr(seller_street, 11) || ' Main street' AS seller_street, buyer_name, buyer_nip AS buyer_tax_no,
       'Aleja ' || substr(buyer_street, 14) AS buyer_street, buyer_post_code, buyer_city, CAST(net AS VARCHAR) AS price_net,
       CAST(tax AS VARCHAR) AS price_tax, CAST(gross AS VARCHAR) AS price_gross, tax > 0 AS success FROM records"""


@query("extract_english", ENGLISH_SQL)
def extract_english(spark, sf):
    found = extract.extract_invoice(_english_documents(spark, sf))
    return found.select("invoice_id", *[c for c in EXTRACTED if c != "amount_due"])


@query("extract_amounts_reference", ENGLISH_SQL.split("SELECT invoice_id, CAST(invoice_id")[0] + """
SELECT invoice_id, CAST(net AS VARCHAR) AS price_net, '23.00' AS price_tax, CAST(gross AS VARCHAR) AS price_gross FROM records""")
def extract_amounts_reference(spark, sf):
    """In reference mode a later rule reads the rate of ``VAT 23%`` as the VAT amount."""
    found = extract.extract_invoice(_english_documents(spark, sf), mode="reference")
    return found.select("invoice_id", "price_net", "price_tax", "price_gross")


def _damaged_documents(spark, sf):
    """Every fifth document loses the buyer id line, every seventh its date."""
    docs = convert.render_invoice_text(_with_vat_rows(spark, sf)).select("invoice_id", "text")
    cut = F.when(F.col("invoice_id") % 5 == 0, F.regexp_replace("text", r"(?s)NIP \d+\nLP", "LP")).otherwise(F.col("text"))
    cut = F.when(F.col("invoice_id") % 7 == 0, F.regexp_replace(cut, r"Data [^\n]*\n", "")).otherwise(cut)
    return docs.withColumn("text", cut)


@query("route_extractions", f"""
WITH {RECORDS_SQL},
m AS (SELECT invoice_id, concat_ws(',', CASE WHEN invoice_id % 5 = 0 THEN 'buyer_tax_no' END, CASE WHEN invoice_id % 7 = 0 THEN 'issue_date' END,
             CASE WHEN tax = 0 THEN 'price_tax' END) AS missing FROM records)
SELECT invoice_id, missing, CASE WHEN missing = '' THEN 'convert' ELSE 'review' END AS route FROM m""")
def route_extractions(spark, sf):
    routed = extract.route_extractions(extract.extract_invoice(_damaged_documents(spark, sf)))
    return routed.select("invoice_id", F.array_join("missing", ",").alias("missing"), "route")


@query("extraction_quality", f"""
WITH {RECORDS_SQL},
m AS (SELECT invoice_id, list_filter([CASE WHEN invoice_id % 5 = 0 THEN 'buyer_tax_no' END, CASE WHEN invoice_id % 7 = 0 THEN 'issue_date' END,
             CASE WHEN tax = 0 THEN 'price_tax' END], lambda x: x IS NOT NULL) AS missing FROM records),
e AS (SELECT CASE WHEN len(missing) = 0 THEN 'convert' ELSE 'review' END AS route,
             unnest(CASE WHEN len(missing) = 0 THEN ['(complete)'] ELSE missing END) AS field FROM m)
SELECT route, field, count(*) AS documents FROM e GROUP BY 1, 2""")
def extraction_quality(spark, sf):
    return extract.extraction_quality(extract.route_extractions(extract.extract_invoice(_damaged_documents(spark, sf))))


def _planted_documents(spark, sf):
    """The given documents, with an invoice behind the text of every third one: all number patterns and numeric dates."""
    n, d = F.col("doc_id").cast("string"), F.col("doc_id")
    numbers = ["INVOICE # {}", "Invoice Number: {}", "Faktura numer {}/07/2025", "FV/{}/07/2025", "Numer faktury: {}/A"]
    number = F.replace(F.element_at(F.array(*[F.lit(x) for x in numbers]), (d % 5 + 1).cast("int")), F.lit("{}"), n)
    issued = F.when(d % 2 == 0, "14.07.2025").otherwise("2025-07-14")
    invoice = F.concat_ws(
        "\n", number, F.concat(F.lit("Data wystawienia: "), issued), F.lit("Sprzedawca"), F.concat(F.lit("Alfa "), n), F.lit("ul. Polna 1"),
        F.lit("00-950 Warszawa"), F.lit("NIP 123-000-00-05"), F.lit("Nabywca"), F.concat(F.lit("Beta "), n), F.lit("ul. Cicha 2"),
        F.lit("35-001 Rzeszów"), F.lit("NIP 7310000012"), F.concat(F.lit("Wartość netto "), ((d + 1) * 100).cast("string"), F.lit(",00 PLN")),
        F.concat(F.lit("Wartość VAT "), ((d + 1) * 23).cast("string"), F.lit(",00 PLN")),
        F.concat(F.lit("Wartość brutto "), ((d + 1) * 123).cast("string"), F.lit(",00 PLN")),
    )
    planted = F.when(d % 3 == 0, F.concat_ws("\n", "text", invoice)).otherwise(F.col("text"))
    return t.read_table(spark, sf, "documents").select("doc_id", planted.alias("text"))


@query("extract_planted", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CASE doc_id % 5 WHEN 0 THEN doc_id || '' WHEN 1 THEN doc_id || '' WHEN 4 THEN doc_id || '/A' ELSE doc_id || '/07/2025' END END AS number,
  CASE WHEN doc_id % 3 = 0 THEN '2025-07-14' END AS issue_date, CASE WHEN doc_id % 3 = 0 THEN (doc_id + 1) * 100 ELSE 0 END || '.00' AS price_net,
  CASE WHEN doc_id % 3 = 0 THEN (doc_id + 1) * 23 ELSE 0 END || '.00' AS price_tax, CASE WHEN doc_id % 3 = 0 THEN (doc_id + 1) * 123 ELSE 0 END || '.00' AS price_gross,
  CASE WHEN doc_id % 3 = 0 THEN 'Alfa ' || doc_id END AS seller_name, CASE WHEN doc_id % 3 = 0 THEN '1230000005' END AS seller_tax_no,
  CASE WHEN doc_id % 3 = 0 THEN 'Beta ' || doc_id END AS buyer_name, CASE WHEN doc_id % 3 = 0 THEN '7310000012' END AS buyer_tax_no FROM documents""")
def extract_planted(spark, sf):
    fields = ["number", "issue_date", "price_net", "price_tax", "price_gross", "seller_name", "seller_tax_no", "buyer_name", "buyer_tax_no"]
    found = extract.extract_invoice(_planted_documents(spark, sf))
    return found.select("doc_id", *[text_functions.empty_as_null(F.col(c)).alias(c) for c in fields])


@query("document_extraction_quality", """
SELECT 'review' AS route, unnest(['seller_name', 'seller_tax_no', 'buyer_name', 'buyer_tax_no', 'number', 'issue_date', 'price_net', 'price_tax', 'price_gross']) AS field,
       (SELECT count(*) FROM documents WHERE doc_id % 3 <> 0) AS documents
UNION ALL SELECT 'convert', '(complete)', count(*) FROM documents WHERE doc_id % 3 = 0""")
def document_extraction_quality(spark, sf):
    """A third of the given documents end with an invoice; the prose of the others has no field at all."""
    return extract.extraction_quality(extract.route_extractions(extract.extract_invoice(_planted_documents(spark, sf))))


@query("parse_extraction_response", f"""
WITH {RECORDS_SQL} SELECT invoice_id, CASE WHEN invoice_id % 4 <> 3 THEN number END AS number,
  CASE WHEN invoice_id % 4 <> 3 THEN CAST(gross AS VARCHAR) END AS price_gross, invoice_id % 4 = 3 AS is_corrupt FROM records""")
def parse_extraction_response(spark, sf):
    base = records(spark, sf, False)
    answer = F.to_json(F.struct(*[F.col(c) for c in schemas.EXTRACTION_FIELDS]))
    k = F.col("invoice_id") % 4
    response = (
        F.when(k == 0, answer).when(k == 1, F.concat(F.lit("```json\n"), answer, F.lit("\n```")))
        .when(k == 2, F.concat(F.lit(" \n```\n"), answer, F.lit("\n```\n"))).otherwise(F.concat(F.lit("Sorry: "), answer))
    )
    parsed = extract.parse_extraction_response(base.select("invoice_id", response.alias("response")))
    return parsed.select("invoice_id", "number", "price_gross", "is_corrupt")


def _label_free_extractor(batch):
    """Stand-in for a user's extractor: takes the last line as the issuer."""
    out = batch[["invoice_id"]].copy()
    for name in schemas.EXTRACTION_FIELDS:
        out[name] = ""
    out["seller_name"] = batch["text"].str.rsplit("\n", n=1).str[-1]
    return out


@query("apply_extractor", f"WITH {RECORDS_SQL} SELECT invoice_id, 'Jan Kowalski' AS seller_name FROM records WHERE invoice_id % 5 = 0 OR invoice_id % 7 = 0 OR tax = 0")
def apply_extractor(spark, sf):
    found = extract.extract_invoice(_damaged_documents(spark, sf), keep_text=True)
    review = extract.write_routes(extract.route_extractions(found), work_path(spark, "routes")).where("route = 'review'")
    return extract.apply_extractor(review, _label_free_extractor, ["invoice_id"]).select("invoice_id", "seller_name")


@query("assemble_pages", """
WITH p AS (SELECT doc_id, [x for x in string_split(text, chr(10)) if x <> ''] AS pages FROM documents)
SELECT doc_id, md5(array_to_string(pages, chr(10) || chr(10))) AS digest FROM p WHERE len(pages) > 0""")
def assemble_pages(spark, sf):
    docs = t.read_table(spark, sf, "documents")
    pages = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page_no", "text"))
    return source.assemble_pages(pages).select("doc_id", F.md5("text").alias("digest"))


# --- Templates -----------------------------------------------------------------------------------
TEMPLATE = "<Faktura><NIP>#seller_nip#</NIP><NIP>#buyer_nip#</NIP><P_1>#invoicing_date#</P_1><P_2>#invoice_number#</P_2><P_13_1>#net#</P_13_1><P_14_1>#vat#</P_14_1><P_15>#gross#</P_15></Faktura>"


def _cases(spark, sf):
    return records(spark, sf, False).select(
        F.col("invoice_id").cast("string").alias("case_id"), F.col("seller_tax_no").alias("seller_nip"), F.col("buyer_tax_no").alias("buyer_nip"),
        F.col("issue_date").alias("invoicing_date"), F.col("price_net").alias("net"), F.col("price_tax").alias("vat"),
        F.col("price_gross").alias("gross"), F.col("number").alias("invoice_number"),
    )


def _template_sql(number: str) -> str:
    return ("'<Faktura><NIP>' || seller_nip || '</NIP><NIP>' || buyer_nip || '</NIP><P_1>' || issue_date || '</P_1><P_2>' || "
            f"{number} || '</P_2><P_13_1>' || net || '</P_13_1><P_14_1>' || tax || '</P_14_1><P_15>' || gross || '</P_15></Faktura>'")


@query("render_template", f"WITH {RECORDS_SQL} SELECT CAST(invoice_id AS VARCHAR) AS case_id, {_template_sql('number')} AS xml FROM records")
def render_template(spark, sf):
    return convert.render_template(_cases(spark, sf), F.lit(TEMPLATE)).select("case_id", "xml")


@query("replicate_template", f"""
WITH {RECORDS_SQL} SELECT CAST(invoice_id AS VARCHAR) AS case_id, CAST(n AS INTEGER) AS copy_no,
  {_template_sql("invoice_id || '-' || lpad(CAST(n AS VARCHAR), 6, '0')")} AS xml FROM records, range(1, 4) AS r(n)""")
def replicate_template(spark, sf):
    cases = _cases(spark, sf).drop("invoice_number")
    return convert.replicate_template(cases, F.lit(TEMPLATE), 3).select("case_id", "copy_no", "xml")


@query("write_invoice_documents", """
WITH r AS (SELECT c_custkey AS id, (c_custkey % 700) || '/' || (c_custkey % 12 + 1) || CASE WHEN c_custkey % 5 = 0 THEN '~2' ELSE '' END AS number, c_name AS name,
             c_custkey % 90 AS payment_days, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS note FROM customer),
n AS (SELECT *, 'faktura-' || replace(number, '/', '-') AS stem, row_number() OVER (PARTITION BY number ORDER BY id) AS k FROM r)
SELECT CASE WHEN k = 1 AND NOT regexp_matches(stem, '~[0-9]+$') THEN stem ELSE stem || '~' || k END || '.json' AS file_name,
       '{"number":"' || number || '","name":"' || name || '","payment_days":' || payment_days || ',"note":' || coalesce('"' || note || '"', 'null') || '}' AS content FROM n""")
def write_invoice_documents(spark, sf):
    """One named file per record, with clashing names, read back by name and content."""
    i, path = F.col("c_custkey"), work_path(spark, "named")
    number = F.concat((i % 700).cast("string"), F.lit("/"), (i % 12 + 1).cast("string"), F.when(i % 5 == 0, "~2").otherwise(""))
    rows = t.read_table(spark, sf, "customer").select(
        i.alias("id"), number.alias("number"), F.col("c_name").alias("name"), (i % 90).alias("payment_days"),
        F.when(i % 4 != 0, F.col("c_mktsegment")).alias("note"),
    )
    source.write_invoice_documents(rows, path, "id")
    read = spark.read.option("wholetext", True).text(path)
    return read.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("content"))
