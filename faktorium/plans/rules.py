"""Queries on validation rules, over raw strings and documents derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from faktorium import codes
from faktorium.functions import checks
from faktorium.functions.money import from_grosze
from faktorium.operators import convert
from faktorium.operators import lines as ops
from faktorium.operators import validation as val
from faktorium.plans import tables as t
from faktorium.plans.documents import RECORDS_SQL, created_at, records
from faktorium.plans.registry import query
from faktorium.session import work_path
from faktorium.sources import invoices as source

M = t.money_sql
KEYS = ["invoice_id", "part_id", "supplier_id"]
KEYS_SQL = "invoice_id, part_id, supplier_id"


def _re(pattern: str) -> str:
    """A column pattern as SQL text for a full match."""
    return pattern.removeprefix("^").removesuffix("$").replace(r"\d", "[0-9]").replace("'", "''")


def _raw_lines(spark, sf, base, variants):
    """Raw strings of every line: variant i applies where part_id leaves remainder i."""
    rows = t.invoice_lines(spark, sf).withColumn("base", base)
    raw = F.col("base")
    for i, change in enumerate(variants):
        raw = F.when(F.col("part_id") % (len(variants) + 1) == i, change(F.col("base"))).otherwise(raw)
    return rows.select(*KEYS, raw.alias("raw"))


def _raw_sql(base: str, variants: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(variants))
    return f"""WITH {t.LINES_SQL}, b AS (SELECT *, {base} AS base FROM lines),
raw AS (SELECT {KEYS_SQL}, CASE part_id % {len(variants) + 1} {cases} ELSE base END AS raw FROM b)"""


AMOUNT_BASE = M("ext_gr") + "::VARCHAR"
AMOUNT_SQL = ["'0' || base", "base || '9'", "'-' || base", "'+' || base", "replace(base, '.', ',')", "substr(base, 1, length(base) - 3)", "'99999999999' || base", "NULL"]


def _amount_variants():
    text = F.lit
    return [
        lambda b: F.concat(text("0"), b), lambda b: F.concat(b, text("9")), lambda b: F.concat(text("-"), b), lambda b: F.concat(text("+"), b),
        lambda b: F.replace(b, text("."), text(",")), lambda b: F.substring(b, F.lit(1), F.length(b) - 3),
        lambda b: F.concat(text("99999999999"), b), lambda b: F.lit(None).cast("string"),
    ]


def _check(spark, sf, base, variants, check):
    return _raw_lines(spark, sf, base, variants).withColumn("is_ok", check(F.col("raw")))


def _amount_base():
    return from_grosze(F.col("ext_gr")).cast("string")


def _digits_sql(most: int) -> str:
    return f"length(regexp_replace(regexp_replace(raw, '^-?0*', ''), '[^0-9]', '', 'g')) <= {most}"


def _pattern_sql(base: str, variants: list[str], pattern: str, digits: int) -> str:
    return f"""{_raw_sql(base, variants)}
SELECT {KEYS_SQL}, raw, raw IS NULL OR (regexp_full_match(raw, '{_re(pattern)}') AND {_digits_sql(digits)}) AS is_ok FROM raw"""


@query("check_amount", _pattern_sql(AMOUNT_BASE, AMOUNT_SQL, codes.PATTERN_AMOUNT, 18))
def check_amount(spark, sf):
    return _check(spark, sf, _amount_base(), _amount_variants(), checks.check_amount)


@query("check_unit_price", _pattern_sql(AMOUNT_BASE, AMOUNT_SQL, codes.PATTERN_UNIT_PRICE, 22))
def check_unit_price(spark, sf):
    return _check(spark, sf, _amount_base(), _amount_variants(), checks.check_unit_price)


QUANTITY_SQL = ["base || '.123456'", "base || '.1234567'", "'0' || base", "'-' || base", "base || ' '", "base || '.'", "'12345678901234' || base"]


@query("check_quantity", _pattern_sql("CAST(quantity AS VARCHAR)", QUANTITY_SQL, codes.PATTERN_QUANTITY, 22))
def check_quantity(spark, sf):
    lit = F.lit
    variants = [
        lambda b: F.concat(b, lit(".123456")), lambda b: F.concat(b, lit(".1234567")), lambda b: F.concat(lit("0"), b),
        lambda b: F.concat(lit("-"), b), lambda b: F.concat(b, lit(" ")), lambda b: F.concat(b, lit(".")), lambda b: F.concat(lit("12345678901234"), b),
    ]
    return _check(spark, sf, F.col("quantity").cast("string"), variants, checks.check_quantity)


PERCENT_SQL = [
    "base || '.5'", "base || '.1234567'", "'-' || base", "' ' || base || ' '", "base || '%'", "'.5'", "base || '.'", "'000' || base",
    "base || '.1000000'", "'-0.0'", "'+' || base", "'.'", "'100.000001'",
]


@query("check_percent", f"""{_raw_sql("CAST(quantity * 3 AS VARCHAR)", PERCENT_SQL)},
n AS (SELECT *, trim(raw) AS v FROM raw),
d AS (SELECT *, TRY_CAST('0' || ltrim(rtrim(v, '.'), '+-') AS DECIMAL(30,12)) AS size FROM n)
SELECT {KEYS_SQL}, raw, regexp_full_match(v, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)') AND size = round(size, 6)
  AND (CASE WHEN v LIKE '-%' THEN size = 0 ELSE size <= 100 END) AS is_ok FROM d""")
def check_percent(spark, sf):
    lit = F.lit
    variants = [
        lambda b: F.concat(b, lit(".5")), lambda b: F.concat(b, lit(".1234567")), lambda b: F.concat(lit("-"), b),
        lambda b: F.concat(lit(" "), b, lit(" ")), lambda b: F.concat(b, lit("%")), lambda b: lit(".5"), lambda b: F.concat(b, lit(".")),
        lambda b: F.concat(lit("000"), b), lambda b: F.concat(b, lit(".1000000")), lambda b: lit("-0.0"), lambda b: F.concat(lit("+"), b),
        lambda b: lit("."), lambda b: lit("100.000001"),
    ]
    return _check(spark, sf, (F.col("quantity") * 3).cast("string"), variants, checks.check_percent)


@query("check_text_length", """
WITH c AS (SELECT doc_id, length(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))) AS n FROM documents)
SELECT doc_id, n BETWEEN 1 AND 20 AS fits_20, n BETWEEN 1 AND 50 AS fits_50, n BETWEEN 1 AND 256 AS fits_256, n BETWEEN 1 AND 512 AS fits_512 FROM c""")
def check_text_length(spark, sf):
    docs = t.read_table(spark, sf, "documents")
    return docs.select("doc_id", *[checks.check_text_length(F.col("text"), n).alias(f"fits_{n}") for n in (20, 50, 256, 512)])


DATE_SQL = ["'19' || substr(base, 3)", "substr(base, 1, 8) || '31'", "replace(base, '-', '/')", "'2050-01-01'", "'2050-01-02'", "base || 'Z'"]


def _range_sql(kind: str) -> str:
    low, high = codes.DATE_RANGES[kind]
    return f"(regexp_full_match(raw, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND coalesce(TRY_CAST(raw AS DATE) BETWEEN DATE '{low}' AND DATE '{high}', FALSE))"


@query("check_date_range", f"""{_raw_sql("strftime(ship_date, '%Y-%m-%d')", DATE_SQL)}
SELECT {KEYS_SQL}, raw, {_range_sql('TData')} AS is_tdata, {_range_sql('TDataT')} AS is_tdatat, {_range_sql('TDataU')} AS is_tdatau FROM raw""")
def check_date_range(spark, sf):
    lit = F.lit
    variants = [
        lambda b: F.concat(lit("19"), F.substring(b, 3, 8)), lambda b: F.concat(F.substring(b, 1, 8), lit("31")),
        lambda b: F.replace(b, lit("-"), lit("/")), lambda b: lit("2050-01-01"), lambda b: lit("2050-01-02"), lambda b: F.concat(b, lit("Z")),
    ]
    raw = _raw_lines(spark, sf, F.date_format("ship_date", "yyyy-MM-dd"), variants)
    return raw.select(*KEYS, "raw", *[checks.check_date_range(F.col("raw"), k).alias(f"is_{k.lower()}") for k in codes.DATE_RANGES])


@query("check_header_time", """
WITH m AS (SELECT event_id, ts + CAST(event_id % 5 AS INTEGER) * INTERVAL 6 MONTH - CAST(event_id % 3 AS INTEGER) * INTERVAL 1 YEAR AS m FROM events)
SELECT event_id, strftime(m, '%Y-%m-%dT%H:%M:%SZ') AS raw, date_trunc('second', m) >= TIMESTAMP '2022-01-01' AS ok_variant_2,
       date_trunc('second', m) >= TIMESTAMP '2025-09-01' AS ok_variant_3 FROM m""")
def check_header_time(spark, sf):
    moved = F.expr("ts + make_ym_interval(0, cast(event_id % 5 as int) * 6) - make_ym_interval(cast(event_id % 3 as int), 0)")
    rows = t.read_table(spark, sf, "events").select(
        "event_id", F.date_format(moved.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("raw")
    )
    return rows.select("event_id", "raw", *[checks.check_header_time(F.col("raw"), v).alias(f"ok_variant_{v}") for v in (2, 3)])


def _listed_sql(name: str, expression: str) -> str:
    return f"{expression} IN ({', '.join(repr(v) for v in codes.CODE_LISTS[name])}) AS in_{name}"


@query("check_code_list", f"""
WITH {t.LINES_SQL}
SELECT {KEYS_SQL}, {_listed_sql('vat_code', 'vat_code')}, {_listed_sql('vat_code_3', 'vat_code')},
  {_listed_sql('payment_form', 'CAST(quantity AS VARCHAR)')}, {_listed_sql('cargo', 'CAST(quantity AS VARCHAR)')},
  {_listed_sql('transport', 'CAST(raw_line_no AS VARCHAR)')}, {_listed_sql('gtu', "'GTU_' || lpad(CAST(quantity AS VARCHAR), 2, '0')")}
FROM lines""")
def check_code_list(spark, sf):
    quantity = F.col("quantity").cast("string")
    values = {
        "vat_code": F.col("vat_code"), "vat_code_3": F.col("vat_code"), "payment_form": quantity, "cargo": quantity,
        "transport": F.col("raw_line_no").cast("string"), "gtu": F.concat(F.lit("GTU_"), F.lpad(quantity, 2, "0")),
    }
    return t.invoice_lines(spark, sf).select(*KEYS, *[checks.check_listed(v, n).alias(f"in_{n}") for n, v in values.items()])


@query("check_bank_fields", f"""{_raw_sql("lpad(CAST(part_id * 104729 + invoice_id AS VARCHAR), 26, '1')", ["substr(base, 1, 9)", "base || '12345678'", "base || '123456789'", "'PL ' || base", "lower('AB' || base)"])}
SELECT {KEYS_SQL}, raw, regexp_full_match(raw, '[0-9A-Z]{{10,32}}') AS ok_variant_2, length(raw) BETWEEN 10 AND 34 AS ok_variant_3,
       regexp_full_match(chr(65 + CAST(supplier_id % 26 AS INTEGER)) || 'BCDPL' || substr(raw, 1, 5), '[A-Z]{{6}}[A-Z0-9]{{2}}([A-Z0-9]{{3}})?') AS ok_swift FROM raw""")
def check_bank_fields(spark, sf):
    lit = F.lit
    variants = [
        lambda b: F.substring(b, 1, 9), lambda b: F.concat(b, lit("12345678")), lambda b: F.concat(b, lit("123456789")),
        lambda b: F.concat(lit("PL "), b), lambda b: F.lower(F.concat(lit("AB"), b)),
    ]
    base = F.lpad((F.col("part_id") * 104729 + F.col("invoice_id")).cast("string"), 26, "1")
    raw = _raw_lines(spark, sf, base, variants)
    swift = F.concat(F.char(F.lit(65) + F.col("supplier_id") % 26), lit("BCDPL"), F.substring("raw", 1, 5))
    return raw.select(
        *KEYS, "raw", checks.check_bank_account(F.col("raw"), 2).alias("ok_variant_2"), checks.check_bank_account(F.col("raw"), 3).alias("ok_variant_3"),
        checks.check_swift(swift).alias("ok_swift"),
    )


# --- Whole documents ------------------------------------------------------------------------------
def _third(party_id: str, rest: str) -> str:
    """A third party with an address."""
    return (f"<Podmiot3><DaneIdentyfikacyjne>{party_id}<Nazwa>A</Nazwa></DaneIdentyfikacyjne><Adres><KodKraju>PL</KodKraju><AdresL1>A 1</AdresL1></Adres>"
            f"{rest}</Podmiot3>")


def _vehicle(*elements: str) -> str:
    return "<NowySrodekTransportu>" + "".join(elements) + "</NowySrodekTransportu>"


def _conditions(content: str) -> tuple[str, str]:
    """Old and new text that adds terms of the transaction."""
    return "</RodzajFaktury>", f"</RodzajFaktury><WarunkiTransakcji>{content}</WarunkiTransakcji>"


def _table(columns: int, *untyped: int) -> str:
    """An attachment table; the columns named have no known type."""
    cells = "".join(f'<Kol><NKom Typ="{"x" if i in untyped else "txt"}">K{i}</NKom></Kol>' for i in range(1, columns + 1))
    return f"<Tabela><TNaglowek>{cells}</TNaglowek><Wiersz><WKom>1</WKom></Wiersz></Tabela>"


_KIND, _CARGO, _MADE = "<RodzajTransportu>3</RodzajTransportu>", "<OpisLadunku>1</OpisLadunku>", "<P_22A>2024-01-01</P_22A>"
_ROW, _CAR = "<P_NrWierszaNST>1</P_NrWierszaNST>", "<P_22B>1000</P_22B>"
# Damage done to the documents: remainder, text, replacement, expected rule and path.
DAMAGE_2 = [
    (0, 'kodSystemowy="FA (2)"', 'kodSystemowy="FA (9)"', "VAL-14", "Naglowek/KodFormularza/_kodSystemowy"),
    (1, "<P_16>2</P_16>", "", "VAL-17", "Fa/Adnotacje/P_16"),
    (2, "<P_19N>1</P_19N>", "<P_19N>1</P_19N><P_19>1</P_19><P_19A>art. 43</P_19A>", "VAL-15", "Fa/Adnotacje/Zwolnienie"),
    (3, "<RodzajFaktury>VAT", "<RodzajFaktury>KOR", "VAL-18", "Fa/DaneFaKorygowanej"),
    (4, "<KodWaluty>PLN", "<KodWaluty>PLZ", "VAL-07", "Fa/KodWaluty"),
    (5, "<NrWierszaFa>1<", "<NrWierszaFa>0<", "VAL-26", "Fa/FaWiersz[1]/NrWierszaFa"),
    (6, "2025-12-17T19", "2021-12-17T19", "VAL-06", "Naglowek/DataWytworzeniaFa"),
    (7, "<P_18A>2</P_18A>", "<P_18A>3</P_18A>", "VAL-07", "Fa/Adnotacje/P_18A"),
    (8, "</Podmiot2>", "</Podmiot2>" + _third("<BrakID>1</BrakID>", "<Rola>1</Rola>" + 4 * "<DaneKontaktowe><Email>a@b.pl</Email></DaneKontaktowe>"), "VAL-16",
     "Podmiot3/DaneKontaktowe"),
    (9, "</RodzajFaktury>", "</RodzajFaktury><Platnosc><ZnacznikZaplatyCzesciowej>1</ZnacznikZaplatyCzesciowej><ZaplataCzesciowa>"
     "<KwotaZaplatyCzesciowej>1.00</KwotaZaplatyCzesciowej></ZaplataCzesciowa></Platnosc>", "VAL-17",
     "Fa/Platnosc/ZaplataCzesciowa[1]/DataZaplatyCzesciowej"),
    (10, "</Podmiot2>", "</Podmiot2>" + _third("<BrakID>1</BrakID>", "") + _third("<BrakID>1</BrakID>", "<RolaInna>1</RolaInna><OpisRoli>x</OpisRoli>")
     + _third("<BrakID>1</BrakID>", "<Rola>1</Rola><RolaInna>1</RolaInna>"), "VAL-15", "Podmiot3[1]"),
    (11, "</Podmiot2>", "</Podmiot2>" + _third("<NIP>7310000012</NIP><BrakID>1</BrakID>", "<Rola>2</Rola>"), "VAL-15", "Podmiot3[1]"),
    (12, *_conditions(f"<Transport>{_KIND}{_CARGO}</Transport><Transport>{_CARGO}</Transport><Transport>{_KIND}<TransportInny>1</TransportInny>{_CARGO}</Transport>"
                      f"<Transport>{_KIND}<LadunekInny>1</LadunekInny></Transport>"), "VAL-15", "Fa/WarunkiTransakcji/Transport[2]"),
    (13, "<P_22N>1</P_22N>", "<P_22>1</P_22><P_42_5>2</P_42_5>" + _vehicle(_MADE, _ROW, _CAR) + _vehicle(_MADE, _CAR) + _vehicle(_ROW, _CAR), "VAL-17",
     "Fa/Adnotacje/NoweSrodkiTransportu/NowySrodekTransportu[2]/P_NrWierszaNST"),
    (14, "<P_22N>1</P_22N>", "<P_22>1</P_22>" + _vehicle(_MADE, _ROW, _CAR) + _vehicle(_MADE, _ROW, _CAR, "<P_22C>5</P_22C>"), "VAL-15",
     "Fa/Adnotacje/NoweSrodkiTransportu"),
    (15, "</Podmiot1>", "<DaneKontaktowe><Telefon>600700800</Telefon></DaneKontaktowe><DaneKontaktowe><Telefon>12345678901234567</Telefon></DaneKontaktowe></Podmiot1>",
     "VAL-05", "Podmiot1/DaneKontaktowe[2]/Telefon"),
    (16, "</Podmiot1>", "<StatusInfoPodatnika>5</StatusInfoPodatnika></Podmiot1>", "VAL-07", "Podmiot1/StatusInfoPodatnika"),
    (17, "</Fa>", "</Fa><Stopka><Rejestry><KRS>0000123456</KRS><REGON>123456789</REGON><BDO>1234567890</BDO></Rejestry><Rejestry><KRS>123</KRS><REGON>1</REGON>"
     "</Rejestry></Stopka>", "VAL-05", "Stopka/Rejestry[1]/BDO"),
    (18, "</RodzajFaktury>", "</RodzajFaktury><Platnosc><RachunekBankowyFaktora><NrRB>PL61109010140000071219812874</NrRB></RachunekBankowyFaktora>"
     "<RachunekBankowyFaktora><NrRB>12 34</NrRB><SWIFT>abc</SWIFT></RachunekBankowyFaktora></Platnosc>", "VAL-11",
     "Fa/Platnosc/RachunekBankowyFaktora[2]/NrRB"),
    (19, *_conditions(f"<Transport>{_KIND}{_CARGO}<DataGodzRozpTransportu>2021-09-30T10:00:00Z</DataGodzRozpTransportu></Transport>"), "VAL-06",
     "Fa/WarunkiTransakcji/Transport[1]/DataGodzRozpTransportu"),
    (20, "</Podmiot2>", "</Podmiot2><PodmiotUpowazniony><DaneIdentyfikacyjne><NIP>7310000012</NIP><Nazwa>A</Nazwa></DaneIdentyfikacyjne><Adres><KodKraju>PL</KodKraju>"
     "<AdresL1>A 1</AdresL1></Adres><DaneKontaktowe><TelefonPU>12345678901234567</TelefonPU></DaneKontaktowe><RolaPU>4</RolaPU></PodmiotUpowazniony>", "VAL-07",
     "PodmiotUpowazniony/RolaPU"),
    (21, *_conditions("<Umowy><DataUmowy>2016-06-30</DataUmowy></Umowy>"), "VAL-06", "Fa/WarunkiTransakcji/Umowy[1]/DataUmowy"),
    (22, "</Podmiot2>", "</Podmiot2>" + _third("<NIP>7310000012</NIP>", "<Rola>2</Rola><DaneKontaktowe><Telefon>1</Telefon></DaneKontaktowe>"
                                               "<DaneKontaktowe><Telefon>12345678901234567</Telefon></DaneKontaktowe>"), "VAL-05",
     "Podmiot3[1]/DaneKontaktowe[2]/Telefon"),
]
# Documents with more than one bad place: the others.
MORE_2 = [
    (10, "VAL-15", "Podmiot3[3]"), (12, "VAL-15", "Fa/WarunkiTransakcji/Transport[3]"), (12, "VAL-15", "Fa/WarunkiTransakcji/Transport[4]"),
    (13, "VAL-17", "Fa/Adnotacje/NoweSrodkiTransportu/NowySrodekTransportu[3]/P_22A"),
    (14, "VAL-15", "Fa/Adnotacje/NoweSrodkiTransportu/NowySrodekTransportu[2]"),
    (17, "VAL-05", "Stopka/Rejestry[2]/KRS"), (17, "VAL-05", "Stopka/Rejestry[2]/REGON"),
    (18, "VAL-11", "Fa/Platnosc/RachunekBankowyFaktora[2]/SWIFT"), (20, "VAL-05", "PodmiotUpowazniony/DaneKontaktowe[1]/TelefonPU"),
]
DAMAGE_3 = [
    (0, "<JST>2</JST>", "", "VAL-19", "Podmiot2/JST"),
    (1, "<GV>2</GV>", "<GV>3</GV>", "VAL-19", "Podmiot2/GV"),
    (2, "wzor/2025/06/25/13775/", "wzor/2023/06/29/12648/", "VAL-14", "_xmlns"),
    (3, "<RodzajFaktury>VAT</RodzajFaktury>", "<RodzajFaktury>VAT</RodzajFaktury><Platnosc><IPKSeF>12AB</IPKSeF></Platnosc>", "VAL-19", "Fa/Platnosc/IPKSeF"),
    (4, "2025-12-17T19", "2025-08-31T19", "VAL-06", "Naglowek/DataWytworzeniaFa"),
    (5, "</Fa>", "</Fa><Stopka><Informacje/><Informacje/><Informacje/><Informacje/></Stopka>", "VAL-16", "Stopka/Informacje"),
    (6, "</RodzajFaktury>", "</RodzajFaktury><WarunkiTransakcji>" + 101 * "<Umowy><NrUmowy>1</NrUmowy></Umowy>" + "</WarunkiTransakcji>", "VAL-16",
     "Fa/WarunkiTransakcji/Umowy"),
    (7, "</RodzajFaktury>", f"</RodzajFaktury><WarunkiTransakcji><Transport>{_KIND}{_CARGO}"
     + 21 * "<WysylkaPrzez><KodKraju>PL</KodKraju><AdresL1>A 1</AdresL1></WysylkaPrzez>" + "</Transport></WarunkiTransakcji>", "VAL-16",
     "Fa/WarunkiTransakcji/Transport/WysylkaPrzez"),
    (8, "</Podmiot2>", "</Podmiot2><PodmiotUpowazniony><DaneIdentyfikacyjne><NIP>7310000012</NIP><Nazwa>A</Nazwa></DaneIdentyfikacyjne>"
     "<Adres><KodKraju>PL</KodKraju><AdresL1>A 1</AdresL1></Adres></PodmiotUpowazniony>", "VAL-17", "PodmiotUpowazniony/RolaPU"),
    (9, *_conditions("<Umowy><DataUmowy>1990-01-01</DataUmowy></Umowy><Zamowienia><DataZamowienia>1989-12-31</DataZamowienia></Zamowienia>"), "VAL-06",
     "Fa/WarunkiTransakcji/Zamowienia[1]/DataZamowienia"),
    (10, "</RodzajFaktury>", "</RodzajFaktury><Platnosc><LinkDoPlatnosci>https://pay.example.pl/x?IPKSeF=123abcdefghiJ</LinkDoPlatnosci>"
     "<IPKSeF>123abcdefghij</IPKSeF></Platnosc>", "VAL-19", "Fa/Platnosc/LinkDoPlatnosci"),
    (11, "</Faktura>", "<Zalacznik><BlokDanych>" + _table(3) + "</BlokDanych><BlokDanych>" + _table(20) + _table(21) + "</BlokDanych></Zalacznik></Faktura>", "VAL-19",
     "Zalacznik/BlokDanych[2]/Tabela[2]"),
    (12, "</Faktura>", "<Zalacznik><BlokDanych>" + _table(5, 2, 4) + "</BlokDanych></Zalacznik></Faktura>", "VAL-19",
     "Zalacznik/BlokDanych[1]/Tabela[1]/TNaglowek/Kol[2]"),
    (13, "</Podmiot2>", "</Podmiot2><Podmiot3><DaneIdentyfikacyjne><KodUE>DE</KodUE></DaneIdentyfikacyjne><Rola>11</Rola></Podmiot3>", "VAL-15", "Podmiot3[1]"),
    (14, "</RodzajFaktury>", "</RodzajFaktury><Platnosc><ZnacznikZaplatyCzesciowej>1</ZnacznikZaplatyCzesciowej>" + 2 * (
        "<ZaplataCzesciowa><KwotaZaplatyCzesciowej>1.00</KwotaZaplatyCzesciowej><DataZaplatyCzesciowej>2025-01-01</DataZaplatyCzesciowej>"
        "<FormaPlatnosci>1</FormaPlatnosci><PlatnoscInna>1</PlatnoscInna></ZaplataCzesciowa>") + "</Platnosc>", "VAL-15", "Fa/Platnosc/ZaplataCzesciowa[1]"),
]
MORE_3 = [
    (12, "VAL-19", "Zalacznik/BlokDanych[1]/Tabela[1]/TNaglowek/Kol[4]"), (14, "VAL-15", "Fa/Platnosc/ZaplataCzesciowa[2]"),
]
DAMAGE_EVERY = 32


def _damaged(spark, sf, variant, damage):
    xml = convert.to_fa_xml(records(spark, sf, variant == 2, True), variant, created_at(), indent="").select("invoice_id", "xml")
    text = F.col("xml")
    for remainder, old, new, _, _ in damage:
        text = F.when(F.col("invoice_id") % DAMAGE_EVERY == remainder, F.replace("xml", F.lit(old), F.lit(new))).otherwise(text)
    parsed = source.parse_fa_xml(xml.withColumn("xml", text), variant, plain="plain").select("invoice_id", "plain", "document.*")
    return val.validate_fa(parsed, variant, plain="plain")


def _expected_sql(damage, more, columns: str) -> str:
    found = [(r, rule, path) for r, _, _, rule, path in damage] + more
    rows = ", ".join(f"({r}, '{rule}', '{path}')" for r, rule, path in found)
    return f"""WITH {RECORDS_SQL}, d(remainder, rule_id, path) AS (VALUES {rows}),
found AS (SELECT invoice_id, rule_id, path FROM records JOIN d ON invoice_id % {DAMAGE_EVERY} = remainder)
{columns}"""


@query("validate_fa", _expected_sql(DAMAGE_2, MORE_2, "SELECT * FROM found"))
def validate_fa(spark, sf):
    return val.explode_violations(_damaged(spark, sf, 2, DAMAGE_2), ["invoice_id"]).select("invoice_id", "rule_id", "path")


@query("validate_fa_variant_3", _expected_sql(DAMAGE_3, MORE_3, "SELECT * FROM found"))
def validate_fa_variant_3(spark, sf):
    return val.explode_violations(_damaged(spark, sf, 3, DAMAGE_3), ["invoice_id"]).select("invoice_id", "rule_id", "path")


@query("validation_summary", _expected_sql(DAMAGE_2, MORE_2, """
SELECT r.invoice_id, coalesce(min(f.rule_id), 'VAL-18') = 'VAL-18' AS is_valid, count(f.path) AS findings
FROM records r LEFT JOIN found f ON f.invoice_id = r.invoice_id GROUP BY 1"""))
def validation_summary(spark, sf):
    summary = val.summarise_validation(_damaged(spark, sf, 2, DAMAGE_2))
    lines = F.size(F.filter(F.split("messages", "\n"), lambda line: line != "")).cast("long")
    return summary.select("invoice_id", "is_valid", lines.alias("findings"))


@query("lowered_line_limit", f"WITH {RECORDS_SQL} SELECT invoice_id, 'Fa/FaWiersz' AS path, CAST(line_count AS VARCHAR) AS raw_value FROM records WHERE line_count > 3")
def lowered_line_limit(spark, sf):
    """The cardinality rule with a limit of three lines: a long invoice is one document with one finding."""
    xml = convert.to_fa_xml(records(spark, sf, True, True), 2, created_at()).select("invoice_id", "xml")
    parsed = source.parse_fa_xml(xml, 2, paths=["Fa.FaWiersz.NrWierszaFa"]).select("invoice_id", "document.*")
    found = val.gather(*val.check_cardinality(2, {"Fa.FaWiersz": (3, 3)}))
    return val.explode_violations(parsed.withColumn("violations", found), ["invoice_id"]).select("invoice_id", "path", "raw_value")


@query("attach_error_code", _expected_sql(DAMAGE_2, MORE_2, """
SELECT rule_id, 21401 AS error_code, 'Dokument nie jest zgodny ze schemą (xsd).' AS error_text, count(*) AS documents
FROM found GROUP BY 1"""))
def attach_error_code(spark, sf):
    found = val.explode_violations(_damaged(spark, sf, 2, DAMAGE_2), ["invoice_id"])
    return val.attach_error_code(found).groupBy("rule_id", "error_code", "error_text").agg(F.count("*").alias("documents"))


@query("split_valid_invalid", _expected_sql(DAMAGE_2, MORE_2, """
SELECT r.invoice_id, CASE WHEN coalesce(min(f.rule_id), 'VAL-18') = 'VAL-18' THEN 'valid' ELSE 'invalid' END AS target
FROM records r LEFT JOIN found f ON f.invoice_id = r.invoice_id GROUP BY 1"""))
def split_valid_invalid(spark, sf):
    valid, invalid = source.split_valid_invalid(
        _damaged(spark, sf, 2, DAMAGE_2).select("invoice_id", "violations"), work_path(spark, "outcomes")
    )
    mark = lambda df, name: df.select("invoice_id", F.lit(name).alias("target"))
    return mark(valid, "valid").unionByName(mark(invalid, "invalid"))


# --- Amount rules -----------------------------------------------------------------------------------
CASES_SQL = f"""
WITH {t.totals_sql()},
c AS (SELECT invoice_id, CASE invoice_id % 6 WHEN 0 THEN 0 WHEN 1 THEN -net_gr ELSE net_gr END AS n,
             CASE invoice_id % 6 WHEN 0 THEN 0 WHEN 2 THEN -tax_gr - 1 ELSE tax_gr END AS t,
             CASE invoice_id % 6 WHEN 0 THEN 0 WHEN 3 THEN -gross_gr WHEN 4 THEN gross_gr + 1 ELSE gross_gr END AS g FROM invoices)"""


def _amount_cases(spark, sf):
    k = F.col("invoice_id") % 6
    cases = t.invoices(spark, sf).select(
        "invoice_id", F.when(k == 0, 0).when(k == 1, -F.col("net_gr")).otherwise(F.col("net_gr")).alias("n"),
        F.when(k == 0, 0).when(k == 2, -F.col("tax_gr") - 1).otherwise(F.col("tax_gr")).alias("t"),
        F.when(k == 0, 0).when(k == 3, -F.col("gross_gr")).when(k == 4, F.col("gross_gr") + 1).otherwise(F.col("gross_gr")).alias("g"),
    )
    return cases.select("invoice_id", *[from_grosze(F.col(c)).alias(c) for c in "ntg"])


@query("check_amount_signs", CASES_SQL + """
SELECT invoice_id, concat_ws(',', CASE WHEN n <= 0 THEN 'net' END, CASE WHEN t < 0 THEN 'tax' END, CASE WHEN g <= 0 THEN 'gross' END,
  CASE WHEN n = 0 AND t = 0 AND g = 0 THEN 'amounts' END) AS paths FROM c""")
def check_amount_signs(spark, sf):
    found = val.gather(*val.check_amount_signs(F.col("n"), F.col("t"), F.col("g")))
    return _amount_cases(spark, sf).select("invoice_id", F.array_join(F.transform(found, lambda v: v["path"]), ",").alias("paths"))


@query("check_amount_sum", CASES_SQL + "SELECT invoice_id, n + t = g AS is_valid FROM c")
def check_amount_sum(spark, sf):
    broken = val.check_amount_sum(F.col("n"), F.col("t"), F.col("g"))
    return _amount_cases(spark, sf).select("invoice_id", broken.isNull().alias("is_valid"))


@query("check_line_amount", f"""
WITH {t.LINES_SQL},
d AS (SELECT *, quantity * (unit_net_gr - unit_discount_gr) AS e, quantity * (unit_net_gr - unit_discount_gr) + CASE WHEN part_id % 9 = 0 THEN 1 ELSE 0 END AS d FROM lines)
SELECT {KEYS_SQL}, {M('d')} AS declared, {M('e')} AS expected, d = e AS is_valid FROM d""")
def check_line_amount(spark, sf):
    lines = ops.line_amounts(t.invoice_lines(spark, sf), "per_line")
    declared = lines.withColumn("declared_net_gr", F.col("net_gr") + F.when(F.col("part_id") % 9 == 0, 1).otherwise(0))
    checked = val.check_line_amount(declared)
    return checked.select(*KEYS, from_grosze(F.col("declared_net_gr")).alias("declared"), from_grosze(F.col("expected_gr")).alias("expected"), "is_valid")


def _bucket_case() -> str:
    return "CASE vat_code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in codes.VAT_BUCKETS.items()) + " END"


@query("check_header_vs_lines", f"""
WITH {t.AMOUNTS_SQL},
r AS (SELECT invoice_id, {_bucket_case()} AS bucket, rate, CAST(sum(net_gr) AS BIGINT) AS n, CAST(sum(tax_gr) AS BIGINT) AS t FROM amounts GROUP BY 1, 2, 3),
b AS (SELECT invoice_id, bucket, sum(t) - sum((2 * n * rate + 100) // 200) AS d FROM r GROUP BY 1, 2)
SELECT invoice_id, bucket, {M('CASE WHEN invoice_id % 7 = 0 THEN 1 ELSE 0 END')} AS net_diff, {M('d')} AS tax_diff,
       d = 0 AND invoice_id % 7 <> 0 AS is_valid FROM b""")
def check_header_vs_lines(spark, sf):
    """Headers sum up the VAT of the lines, one in seven is a grosz too high; the check computes VAT on the bucket."""
    lines = ops.line_amounts(t.invoice_lines(spark, sf))
    headers = lines.groupBy("invoice_id", ops.bucket_of(F.col("vat_code")).alias("bucket")).agg(
        (F.sum("net_gr") + F.when(F.col("invoice_id") % 7 == 0, 1).otherwise(0)).alias("net_gr"), F.sum("tax_gr").alias("tax_gr")
    )
    return val.check_header_vs_lines(headers, lines)


@query("line_numbering_check", f"""
WITH {t.LINES_SQL}
SELECT invoice_id, count(*) AS line_count, min(raw_line_no) AS lowest, max(raw_line_no) AS highest, count(DISTINCT raw_line_no) AS distinct_numbers,
       min(raw_line_no) = 1 AND max(raw_line_no) = count(*) AND count(DISTINCT raw_line_no) = count(*) AS is_valid
FROM lines GROUP BY 1""")
def line_numbering_check(spark, sf):
    return val.check_line_numbers(t.invoice_lines(spark, sf), "raw_line_no")


@query("split_payment", f"""
WITH {t.LINES_SQL}, {t.HEADERS_SQL},
a AS (SELECT invoice_id, bool_or(annex15) AS has_annex15 FROM lines GROUP BY 1),
j AS (SELECT h.invoice_id, CASE WHEN customer_id % 2 = 0 THEN '1' ELSE '2' END AS split_flag, coalesce(has_annex15, FALSE) AS has_annex15,
             coalesce(has_annex15, FALSE) AND declared_gr > 1500000 AS is_needed FROM headers h LEFT JOIN a ON a.invoice_id = h.invoice_id)
SELECT invoice_id, split_flag, has_annex15, is_needed, NOT is_needed OR split_flag = '1' AS is_valid FROM j""")
def split_payment(spark, sf):
    headers = t.invoice_headers(spark, sf).select(
        "invoice_id", F.col("declared_gr").alias("gross_pln_gr"), F.when(F.col("customer_id") % 2 == 0, "1").otherwise("2").alias("split_flag")
    )
    return val.check_split_payment(headers, t.invoice_lines(spark, sf)).drop("gross_pln_gr")


@query("check_order_value", f"""
WITH {t.AMOUNTS_SQL}, {t.HEADERS_SQL},
s AS (SELECT invoice_id, CAST(sum(net_gr + tax_gr) AS BIGINT) AS e FROM amounts GROUP BY 1),
j AS (SELECT h.invoice_id, coalesce(e, 0) AS e, coalesce(e, 0) + CASE WHEN customer_id % 3 = 0 THEN 1 ELSE 0 END AS v
      FROM headers h LEFT JOIN s ON s.invoice_id = h.invoice_id)
SELECT invoice_id, {M('v')} AS declared, {M('e')} AS expected, v = e AS is_valid FROM j""")
def check_order_value(spark, sf):
    lines = ops.line_amounts(t.invoice_lines(spark, sf))
    totals = lines.groupBy("invoice_id").agg(F.sum("gross_gr").alias("_g"))
    shift = F.when(F.col("customer_id") % 3 == 0, 1).otherwise(0)
    orders = t.invoice_headers(spark, sf).join(totals, "invoice_id", "left").select("invoice_id", (F.coalesce("_g", F.lit(0)) + shift).alias("value_gr"))
    checked = val.check_order_value(orders, lines)
    return checked.select("invoice_id", from_grosze(F.col("value_gr")).alias("declared"), from_grosze(F.col("expected_gr")).alias("expected"), "is_valid")


@query("check_transport_times", """
SELECT event_id, ts >= TIMESTAMP '2021-10-01' AND event_id % 4 <> 1 AND event_id % 4 <> 3 AS is_valid FROM events""")
def check_transport_times(spark, sf):
    start = F.col("ts").cast("timestamp")
    k = F.col("event_id") % 4
    end = (
        F.when(k == 0, start + F.expr("INTERVAL 3 HOURS")).when(k == 1, start - F.expr("INTERVAL 1 SECOND"))
        .when(k == 2, F.lit(None).cast("timestamp")).otherwise(F.lit("2050-01-02 00:00:00").cast("timestamp"))
    )
    return t.read_table(spark, sf, "events").select("event_id", val.check_transport_times(start, end).alias("is_valid"))


# --- Nested parts -----------------------------------------------------------------------------------
def nested_documents(spark, sf):
    """Structured documents with order lines, transport, vehicles and attachments made from the lines."""
    lines = ops.line_amounts(t.invoice_lines(spark, sf))
    text = lambda c: c.cast("string")
    nested = ops.nest_in_order(lines, t.LINE_ORDER, {
        "name": F.concat(F.lit("Towar "), text(F.col("part_id"))), "quantity": text(F.col("quantity")),
        "net": text(from_grosze(F.col("net_gr"))), "tax": text(from_grosze(F.col("tax_gr"))), "vat_code": F.col("vat_code"),
        "supplier": text(F.col("supplier_id")), "shipped": text(F.col("ship_date")), "count": F.col("quantity"),
    })
    pos = F.col("positions")
    number = lambda i: text(i + 1)
    order = F.transform(pos, lambda p, i: F.struct(
        number(i).alias("NrWierszaZam"), p["name"].alias("P_7Z"), p["quantity"].alias("P_8BZ"), F.lit(None).cast("string").alias("P_9AZ"),
        p["net"].alias("P_11NettoZ"), p["tax"].alias("P_11VatZ"), p["vat_code"].alias("P_12Z")))
    address = lambda value: F.struct(F.lit("PL").alias("KodKraju"), value.alias("AdresL1"), F.lit(None).cast("string").alias("AdresL2"), F.lit(None).cast("string").alias("GLN"))
    depot = lambda p: F.concat(F.lit("Magazyn "), p["supplier"])
    transport = F.array(F.struct(
        F.lit("3").alias("RodzajTransportu"), F.concat(F.element_at(pos, 1)["shipped"], F.lit("T08:00:00Z")).alias("DataGodzRozpTransportu"),
        F.concat(F.element_at(pos, -1)["shipped"], F.lit("T18:00:00Z")).alias("DataGodzZakTransportu"),
        address(F.lit("Start")).alias("WysylkaZ"), F.transform(pos, lambda p: address(depot(p))).alias("WysylkaPrzez"), address(F.lit("Cel")).alias("WysylkaDo")))
    cell = lambda name, kind: F.struct(F.struct(F.lit(name).alias("_VALUE"), F.lit(kind).alias("_Typ")).alias("NKom"))
    table = F.struct(
        F.struct(F.array(cell("towar", "txt"), cell("ilosc", "int")).alias("Kol")).alias("TNaglowek"),
        F.transform(pos, lambda p: F.struct(F.array(p["name"], p["quantity"]).alias("WKom"))).alias("Wiersz"),
        F.struct(F.array(F.lit("razem"), text(F.aggregate(pos, F.lit(0).cast("long"), lambda a, p: a + p["count"]))).alias("SKom")).alias("Suma"))
    vehicles = F.transform(pos, lambda p, i: F.struct(
        p["shipped"].alias("P_22A"), number(i).alias("P_NrWierszaNST"), p["quantity"].alias("P_22B"),
        F.lit(None).cast("string").alias("P_22C"), F.lit(None).cast("string").alias("P_22D")))
    rows = F.transform(pos, lambda p, i: F.struct(number(i).alias("NrWierszaFa"), p["name"].alias("P_7")))
    return nested.select(
        "invoice_id",
        F.struct(
            F.struct(order.alias("ZamowienieWiersz")).alias("Zamowienie"), F.struct(transport.alias("Transport")).alias("WarunkiTransakcji"),
            F.struct(F.struct(vehicles.alias("NowySrodekTransportu")).alias("NoweSrodkiTransportu")).alias("Adnotacje"), rows.alias("FaWiersz"),
        ).alias("Fa"),
        F.struct(F.array(F.struct(F.array(table).alias("Tabela"))).alias("BlokDanych")).alias("Zalacznik"),
    )


@query("explode_order_lines", f"""
WITH {t.NUMBERED_SQL} SELECT invoice_id, line_no, 'Towar ' || part_id AS name, CAST(quantity AS DECIMAL(22,6)) AS quantity, {M('net_gr')} AS net,
  {M('tax_gr')} AS tax, vat_code FROM numbered""")
def explode_order_lines(spark, sf):
    from faktorium.operators.canonical import explode_order_lines as explode

    return explode(nested_documents(spark, sf), ["invoice_id"]).drop("unit_net")


@query("explode_transport", f"""
WITH {t.NUMBERED_SQL},
s AS (SELECT invoice_id, 0 AS stop, 'Start' AS place FROM numbered WHERE line_no = 1 UNION ALL SELECT invoice_id, line_no, 'Magazyn ' || supplier_id FROM numbered
      UNION ALL SELECT invoice_id, max(line_no) + 1, 'Cel' FROM numbered GROUP BY 1),
l AS (SELECT invoice_id, stop, place AS from_address, lead(place) OVER (PARTITION BY invoice_id ORDER BY stop) AS to_address FROM s)
SELECT invoice_id, 1 AS transport_no, CAST(stop + 1 AS INTEGER) AS leg_no, from_address, to_address FROM l WHERE to_address IS NOT NULL""")
def explode_transport(spark, sf):
    from faktorium.operators.canonical import explode_transport as explode

    return explode(nested_documents(spark, sf), ["invoice_id"]).drop("starts_at", "ends_at")


@query("explode_attachments", f"""
WITH {t.NUMBERED_SQL},
b AS (SELECT invoice_id, line_no AS row_no, 'Towar ' || part_id AS a, CAST(quantity AS VARCHAR) AS q, FALSE AS is_summary FROM numbered
      UNION ALL SELECT invoice_id, max(line_no) + 1, 'razem', CAST(CAST(sum(quantity) AS BIGINT) AS VARCHAR), TRUE FROM numbered GROUP BY 1)
SELECT invoice_id, CAST(row_no AS INTEGER) AS row_no, 1 AS column_no, 'towar' AS column_name, 'txt' AS column_type, a AS value, is_summary FROM b
UNION ALL SELECT invoice_id, CAST(row_no AS INTEGER), 2, 'ilosc', 'int', q, is_summary FROM b""")
def explode_attachments(spark, sf):
    from faktorium.operators.canonical import explode_attachments as explode

    return explode(nested_documents(spark, sf), ["invoice_id"]).drop("block_no", "table_no")


@query("link_new_vehicles", f"""
WITH {t.NUMBERED_SQL} SELECT invoice_id, line_no, ship_date AS admitted_on, CAST(quantity AS VARCHAR) AS usage, 'Towar ' || part_id AS name FROM numbered""")
def link_new_vehicles(spark, sf):
    from faktorium.operators.canonical import link_new_vehicles as link

    return link(nested_documents(spark, sf), ["invoice_id"])
