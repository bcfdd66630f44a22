"""Plain documents are parsed and checked with less work and the same findings; rules on lines are compiled."""

from pyspark.sql import functions as F

from faktorium import schemas
from faktorium.operators import canonical, validation
from faktorium.plans import documents as plans
from faktorium.sources import invoices as source

LINE = "<FaWiersz><NrWierszaFa>{n}</NrWierszaFa><P_7>{name}</P_7><P_8A>szt</P_8A><P_8B>{quantity}</P_8B><P_9A>{price}</P_9A><P_11>{net}</P_11><P_12>{code}</P_12></FaWiersz>"
GOOD = {"n": "1", "name": "Lampa", "quantity": "2", "price": "100.00", "net": "200", "code": "23"}
BASE = (
    '<Faktura xmlns="http://crd.gov.pl/wzor/2023/06/29/12648/"><Naglowek><KodFormularza kodSystemowy="FA (2)" wersjaSchemy="1-0E">FA</KodFormularza>'
    "<WariantFormularza>2</WariantFormularza><DataWytworzeniaFa>2025-05-20T00:02:31Z</DataWytworzeniaFa></Naglowek>"
    "<Podmiot1><DaneIdentyfikacyjne><NIP>1230000005</NIP><Nazwa>Alfa</Nazwa></DaneIdentyfikacyjne><Adres><KodKraju>PL</KodKraju><AdresL1>A 1</AdresL1></Adres></Podmiot1>"
    "<Podmiot2><DaneIdentyfikacyjne><NIP>7310000012</NIP><Nazwa>Beta</Nazwa></DaneIdentyfikacyjne><Adres><KodKraju>PL</KodKraju><AdresL1>B 2</AdresL1></Adres></Podmiot2>"
    "<Fa><KodWaluty>PLN</KodWaluty><P_1>2025-05-18</P_1><P_2>7/5/2025</P_2><P_13_1>200.00</P_13_1><P_14_1>46.00</P_14_1><P_15>246</P_15>"
    "<Adnotacje><P_16>2</P_16><P_17>2</P_17><P_18>2</P_18><P_18A>2</P_18A><Zwolnienie><P_19N>1</P_19N></Zwolnienie>"
    "<NoweSrodkiTransportu><P_22N>1</P_22N></NoweSrodkiTransportu><P_23>2</P_23><PMarzy><P_PMarzyN>1</P_PMarzyN></PMarzy></Adnotacje>"
    "<RodzajFaktury>VAT</RodzajFaktury>" + LINE.format(**GOOD) + LINE.format(**GOOD | {"n": "2"}) + "</Fa></Faktura>"
)
VALUES = [
    "", " ", "x", " x", "x ", "a\tb", "x" * 50, "x" * 51, "x" * 256, "x" * 257, "x" * 512, "x" * 513, " " + "x" * 512, "\U0001f600" * 20, "\U0001f600" * 21, "0", "1", "2", "3",
    "01", "-1", "1.5", "1.55", "1.555", "1.12345678", "1.123456789", "1,5", "9" * 14, "9" * 15, "9" * 16, "9" * 17, "9" * 18, "9" * 39, "1.", ".5", "+1", "100", "100.0", "101", "1e2",
    "12\n", "2025-05-18", "2025-02-29", "2024-02-29", "2025-02-30", "2005-12-31", "2006-01-01", "2016-06-30", "2016-07-01", "2050-01-01", "2050-01-02", "1989-12-31", "1990-01-01",
    "2025-04-31", "2025-13-01", "2025-00-10", "2025-5-18", "23", "zw", "ZW", "np I", "0 KR", "GTU_01", "GTU_14", "WSTO_EE", "WSTO.EE", "PL", "PLN", "VAT", "1234567890", "123456789",
    "12345678901234", "ABCDEFGH", "ABCDEFGHIJK", "PL61109010140000071219812874", "12 34", "\x00", "1\x002", "\x1f", "٣", None,
]
DOCUMENTS = [
    BASE, None, "", "<Faktura/>", BASE[:-3], BASE.replace("</Naglowek>", ""), BASE.replace("<P_7>Lampa", "<P_7>La<b>mp</b>a"), BASE.replace("<P_12>23</P_12>", "<P_12/>"),
    BASE.replace("</Fa>", "<FaWiersz/></Fa>"), BASE.replace("</Fa>", '<FaWiersz typ="G"><P_7>x</P_7></FaWiersz></Fa>'), BASE.replace("</Fa>", "<FaWiersz>x</FaWiersz></Fa>"),
    BASE.replace("</Podmiot2>", "</Podmiot2><Podmiot3/>"), BASE.replace("</Podmiot2>", "</Podmiot2><podmiot3><Rola>99</Rola></podmiot3>"), BASE.replace("P_16>", "p_16>"),
    BASE.replace("<P_1>", "<!-- <P_6>1</P_6> --><P_1>"), BASE.replace("Alfa", "<![CDATA[<NIP>&]]>"), BASE.replace("</Fa>", "<Nowe><P_7>x</P_7></Nowe></Fa>"),
    BASE.replace("<P_8B>2<", "<P_8B>2,5<").replace("<P_9A>100.00<", "<P_9A>1.123456789<"), BASE.replace("Lampa", " "), BASE.replace("Lampa", "\n Lampa \n"), BASE.replace("Lampa", "x" * 257),
    BASE.replace("<P_11>200</P_11>", "<P_11>200</P_11><GTU>GTU_99</GTU><P_6A>2005-01-01</P_6A>"), BASE.replace("<NrWierszaFa>2</NrWierszaFa>", ""), BASE.replace("<NrWierszaFa>2<", "<NrWierszaFa>0<"),
    BASE.replace("<RodzajFaktury>VAT", "<RodzajFaktury>KOR"), BASE.replace("<NIP>7310000012</NIP>", "<KodKraju>DE</KodKraju>"), BASE.replace("<P_14_1>46.00</P_14_1>", ""),
    BASE.replace("<P_1>2025-05-18</P_1>", "<P_1>2025-05-18</P_1><P_1>x</P_1>"), BASE.replace("<Adres><KodKraju>PL</KodKraju><AdresL1>A 1</AdresL1></Adres>", "<Adres>A 1</Adres>"),
    BASE.replace("<P_19N>1</P_19N>", "<P_19>1</P_19><P_19N>1</P_19N>"), BASE.replace("<P_22N>1</P_22N>", ""), BASE.replace("<P_PMarzyN>1<", "<P_PMarzyN>2<"),
    BASE.replace("</Fa>", 2000 * LINE.format(**GOOD) + LINE.format(**GOOD | {"net": "1.001"}) + "</Fa>"), BASE.replace("</Faktura>", "<Stopka/></Faktura>"),
    BASE.replace("<Podmiot1>", '<Podmiot1 other="x" _other="y">'), BASE.replace("<Fa>", "<x:Fa>").replace("</Fa>", "</x:Fa>"), BASE.replace("<Fa>", "<Fa>text"),
    BASE.replace("</Podmiot2>", "<JST>2</JST><GV>2</GV></Podmiot2>").replace("FA (2)", "FA (3)"),
]


def test_plain_documents_have_the_same_findings(spark):
    texts = spark.createDataFrame(list(enumerate(DOCUMENTS)), "i int, xml string")
    for variant in (2, 3):
        whole = source.parse_fa_xml(texts, variant)
        split = source.parse_fa_xml(texts, variant, plain="plain").cache()
        assert {r["i"] for r in split.where("plain IS NOT NULL AND document IS NULL").collect()} >= {0, 7, 17, 18, 20, 22, 32}
        assert split.where("plain IS NOT NULL AND document IS NOT NULL").count() == 0
        flags = lambda df: sorted(map(tuple, df.select("i", F.coalesce("is_wellformed", F.lit(False))).collect()))
        assert flags(split) == flags(whole)
        first = validation.validate_fa(whole.select("i", "document.*"), variant).select("i", "violations").collect()
        second = validation.validate_fa(split.select("i", "plain", "document.*"), variant, plain="plain").select("i", "violations").collect()
        assert sorted(map(repr, second)) == sorted(map(repr, first)) and any(len(r["violations"]) > 3 for r in first)


def test_others_are_seen_at_every_depth(spark):
    texts = [BASE.replace(f"</{e}>", f"<Inne/></{e}>", 1) for e in ("Faktura", "Naglowek", "DaneIdentyfikacyjne", "Adres", "Podmiot1", "Podmiot2", "Fa", "FaWiersz", "Adnotacje", "PMarzy")]
    split = source.parse_fa_xml(spark.createDataFrame([(t,) for t in texts], "xml string"), 2, plain="plain")
    assert split.where("plain IS NULL AND document IS NOT NULL").count() == len(texts)
    assert all(name in schemas.PLAIN_ELEMENTS for name in ("FaWiersz", "P_15"))


def test_quick_patterns_match_allowed_values_only(spark):
    values = spark.createDataFrame([(v,) for v in VALUES], "v string")
    for facet, pattern in validation.SURELY.items():
        surely = F.coalesce(F.col("v").rlike(f"^{pattern}\\z"), F.lit(False))
        found = values.select("v", surely.alias("surely"), validation.FACETS[facet][2](F.col("v")).alias("ok")).collect()
        assert [r for r in found if r["surely"] and not r["ok"]] == [], facet
        assert any(r["surely"] for r in found) or facet in ("krs", "clearance_number", "currency", "eu_country") or found, facet


def test_lines_that_surely_pass_are_not_looked_at(spark):
    """One doubtful value makes all lines be looked at; missing ones and an array without items leave no doubt or no finding."""
    fields = "struct<NrWierszaFa:string,P_7:string,P_11:string>"
    rows = [([("1", "a", "1.00"), ("2", None, None)],), ([("1", "", None)],), ([("1", None, None), (None, None, "1.001")],), ([],), (None,), ([None, ("1", "b", "2")],)]
    df = spark.createDataFrame(rows, f"lines array<{fields}>")
    facets = {"NrWierszaFa": "TNaturalny", "P_7": "TZnakowy", "P_11": "TKwotowy"}
    doubt = F.col("lines").isNotNull() & validation.doubtful("lines", facets, 2)
    assert [r[0] for r in df.select(doubt).collect()] == [False, True, True, False, False, False]
    found = df.select(validation._in_array("lines", facets, 2).alias("f")).collect()
    assert [[v["path"] for v in r["f"] if v] for r in found] == [[], ["lines[1]/P_7"], ["lines[2]/P_11"], [], [], []]


def test_ubl_documents_are_read_for_the_wanted_elements(spark):
    documents = plans._ubl_documents(spark, "/root/testdata/sf0.001").limit(50).select(F.to_xml("document", {"rowTag": "Invoice", "indent": ""}).alias("xml")).cache()
    few = schemas.narrow(schemas.UBL_XML, canonical.canonical_paths("ubl"))
    odd = [
        "<Invoice><ID>1</ID><AccountingSupplierParty><Party><PartyLegalEntity><RegistrationName>A</RegistrationName></PartyLegalEntity></Party></AccountingSupplierParty>"
        "<InvoiceLine/><InvoiceLine><Item><Name>x</Name></Item><LineExtensionAmount currencyID=\"EUR\">1.5</LineExtensionAmount><InvoicedQuantity unitCode=\"C62\"/></InvoiceLine></Invoice>",
        "<Invoice><TaxTotal><TaxAmount currencyID=\"PLN\">2</TaxAmount><TaxSubtotal><TaxAmount>3</TaxAmount></TaxSubtotal></TaxTotal></Invoice>", "<Invoice/>", "<Invoice><ID>", None,
    ]
    texts = documents.unionByName(spark.createDataFrame([(x,) for x in odd], "xml string"))
    as_rows = lambda schema: sorted(map(repr, canonical.to_canonical(
        texts.select(F.from_xml("xml", schema, {"ignoreNamespace": "true"}).alias("d")).select("d.*"), "ubl").collect()))
    assert as_rows(few) == as_rows(schemas.UBL_XML) and len(as_rows(few)) == 55
    assert "TaxSubtotal" not in few["TaxTotal"].dataType.names


def test_united_sources_are_not_indented(spark):
    plan = plans.source_union(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(indent,)") == plan.count("to_xml(") > 1 and "TaxSubtotal" not in plan
