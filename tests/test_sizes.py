"""What is written grows little with the documents, and steps do no work that their result does not need."""

import gzip

from pyspark.sql import functions as F

from faktorium import session
from faktorium.operators import canonical, extract, generate, validation
from faktorium.operators import lines as ops
from faktorium.plans import documents as plans
from faktorium.plans import rules
from faktorium.sources import invoices as source

DATA = "/root/testdata/sf0.001"


def written(path):
    """Bytes on disk and bytes of text of the files of a folder, which are all compressed."""
    files = [p for p in path.iterdir() if p.name.startswith("part-")]
    assert files and all(p.name.endswith(".gz") for p in files)
    return sum(p.stat().st_size for p in files), sum(len(gzip.decompress(p.read_bytes())) for p in files)


def test_fa_xml_files_are_compressed(spark, tmp_path):
    records = plans.records(spark, DATA, True, True)
    source.write_fa_xml(records, str(tmp_path / "fa"), 2, plans.created_at())
    on_disk, text = written(tmp_path / "fa")
    assert 5 * on_disk < text
    read = source.read_fa_xml(spark, str(tmp_path / "fa"), 2).cache()
    assert read.where(F.col(source.CORRUPT).isNull()).count() == read.count() == records.count()


def test_invoice_json_files_are_compressed(spark, tmp_path):
    records = plans._full_record(spark, DATA)
    source.write_invoice_json(records, str(tmp_path / "json"))
    on_disk, text = written(tmp_path / "json")
    assert 5 * on_disk < text
    assert source.read_invoice_json(spark, str(tmp_path / "json"), multi_line=False).count() == records.count()


def test_ubl_files_are_compressed(spark, tmp_path):
    documents = plans._ubl_documents(spark, DATA)
    source.write_xml(documents, F.col("document"), str(tmp_path / "ubl"), "Invoice", "Invoices")
    on_disk, text = written(tmp_path / "ubl")
    assert 5 * on_disk < text
    assert source.read_ubl_xml(spark, str(tmp_path / "ubl")).count() == documents.count()


def test_accounting_files_are_compressed(spark, tmp_path):
    documents = plans._accounting_documents(spark, DATA)
    source.write_xml(documents, F.col("document"), str(tmp_path / "accounting"), "invoice", "invoices")
    on_disk, text = written(tmp_path / "accounting")
    assert 5 * on_disk < text
    assert source.read_accounting_xml(spark, str(tmp_path / "accounting")).count() == documents.count()


def test_narrow_parsing_gives_the_same_invoices(spark):
    records = plans.records(spark, DATA, True, True)
    xml = plans.convert.to_fa_xml(records, 2, plans.created_at()).select("xml")
    paths = canonical.canonical_paths("fa2")
    narrow, whole = (source.parse_fa_xml(xml, 2, paths=p).select("document.*") for p in (paths, None))
    assert len(narrow.schema["Fa"].dataType.names) < len(whole.schema["Fa"].dataType.names)
    as_rows = lambda df: sorted(map(repr, canonical.to_canonical(df, "fa2").collect()))
    assert as_rows(narrow) == as_rows(whole)


def test_narrow_parsing_finds_broken_documents(spark):
    texts = ["<Faktura><Fa><P_2>1</P_2></Fa></Faktura>", "<Faktura><Fa><P_2>1</P_2></Fa><Stopka><Rejestry></Stopka></Faktura>", "<Faktura><Naglowek></Faktura>"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, xml string")
    found = source.parse_fa_xml(df, 2, paths=["Fa.P_2"]).select("i", "is_wellformed").collect()
    assert sorted(map(tuple, found)) == [(0, True), (1, False), (2, False)]


def test_lines_are_counted_by_narrow_parsing(spark):
    df = spark.createDataFrame([("<Faktura><Fa>" + 4 * "<FaWiersz><P_7>a</P_7></FaWiersz>" + "</Fa></Faktura>",)], "xml string")
    parsed = source.parse_fa_xml(df, 2, paths=["Fa.FaWiersz.NrWierszaFa"])
    assert parsed.select(F.size("document.Fa.FaWiersz")).first()[0] == 4


def test_street_pattern_starts_without_alternatives(spark):
    assert not extract.STREET.startswith("(?:")
    texts = ["ul. Polna 1, x", "AL.\tLipowa 2", "Pl. Nowy 3", "ol. Nic 4", "ul Polna 5", "ulX Polna 6", "al.Lipowa 7", "paul. Inna 8"]
    old = r"(?iU)(?:ul\.|al\.|pl\.)\s+([^\n,]+)"
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(
        F.regexp_extract("t", old, 1).alias("old"), F.regexp_extract("t", extract.FLAGS + extract.STREET, 1).alias("new"))
    assert all(r["old"] == r["new"] for r in found.collect())


def exchanges(df):
    """Exchanges of the plan, those with a broadcast apart."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return plan.count("Exchange hashpartitioning")


def test_lines_are_exchanged_once(spark):
    """Lines for their array and sums, and headers for the join: two exchanges."""
    join = "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(join)
    spark.conf.set(join, "-1")
    try:
        assert exchanges(plans.records(spark, DATA)) == 2
        assert exchanges(rules.link_new_vehicles(spark, DATA)) == 1
    finally:
        spark.conf.set(join, kept)


def test_positions_come_in_the_given_order(spark):
    rows = [(1, 2, "b"), (1, 1, "z"), (1, None, "n"), (1, 2, "a"), (None, 1, "x"), (None, 1, "x")]
    lines = spark.createDataFrame(rows, "invoice_id long, k long, v string")
    nested = ops.nest_in_order(lines, ["k"], {"v": F.col("v"), "long": F.concat("v", "v")}, [F.count("*").alias("n")])
    found = {r["invoice_id"]: (r["n"], [(p["v"], p["long"]) for p in r["positions"]]) for r in nested.collect()}
    assert found == {1: (4, [("n", "nn"), ("z", "zz"), ("a", "aa"), ("b", "bb")]), None: (2, [("x", "xx"), ("x", "xx")])}


def test_vehicles_without_or_with_several_lines(spark):
    vehicle = "struct<P_22A:string,P_NrWierszaNST:string,P_22B:string,P_22C:string,P_22D:string>"
    schema = (f"id int, Fa struct<Adnotacje:struct<NoweSrodkiTransportu:struct<NowySrodekTransportu:array<{vehicle}>>>,"
              "FaWiersz:array<struct<NrWierszaFa:string,P_7:string>>>")
    car = lambda n, use: ("2024-01-01", n, use, None, None)
    documents = spark.createDataFrame([
        (1, (((([car("1", "a"), car("2", "b"), car(None, "c"), car("9", "d")],),)), [("1", "x"), ("2", "y"), ("2", None), (None, "z")])),
        (2, (((None,),), [("1", "x")])), (3, (((([car("1", "e")],),)), None)),
    ], schema)
    found = canonical.link_new_vehicles(documents, ["id"]).select("id", "line_no", "usage", "name").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, [
        (1, 1, "a", "x"), (1, 2, "b", "y"), (1, 2, "b", None), (1, None, "c", None), (1, 9, "d", None), (3, 1, "e", None)]))


def test_accounting_files_are_read_for_the_wanted_elements(spark, tmp_path):
    documents = plans._accounting_documents(spark, DATA).limit(50)
    source.write_xml(documents, F.col("document"), str(tmp_path / "accounting"), "invoice", "invoices")
    narrow, whole = (source.read_accounting_xml(spark, str(tmp_path / "accounting"), p) for p in (canonical.canonical_paths("accounting"), None))
    assert len(narrow.columns) < len(whole.columns) / 2
    as_rows = lambda df: sorted(map(repr, canonical.to_canonical(df, "accounting").collect()))
    assert len(as_rows(whole)) == 50 and as_rows(narrow) == as_rows(whole)


def test_rules_of_a_document_are_compiled_apart(spark):
    """No function on items has the rules of a document below it, as Spark would interpret them."""
    document = spark.createDataFrame([], source.schemas.fa_xml(2))
    plan = validation.validate_fa(document, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") == 2 and "filter(_found" in plan


# The forms of the patterns before they were made cheap; both must find the same.
OLD_STREET_ENGLISH = r"(?iU)([A-ZĄĆĘŁŃÓŚŹŻa-ząćęłńóśźż]+\s+street[^,\n]+)"
OLD_PATTERNS = [
    (r"(?:wartość\s+)?netto[:\s]*" + extract.AMOUNT, 3), (r"(?:wartość\s+)?vat[:\s]*" + extract.AMOUNT + r"(?![\d%])", 4),
    (r"(?:wartość\s+)?brutto[:\s]*" + extract.AMOUNT, 5),
]


def test_english_street_is_found_from_its_blanks(spark):
    texts = ["12 Main street, x", "a\nOak\n\tSTREET 5\nElm street 6", " street 1", "9 street a Elm street b", "x Elm street", "Elm street\nOak street 2",
             "Elm street,Oak street 3", "12street 4", "Wide ſtreet 5", "Łąka street 6", "a-b street 7", "street street street 8", "", "\U0001f600Elm street 9"]
    texts += [f"1{chr(c)}b street {c}" for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8)
    both = df.select("t", F.regexp_extract("t", OLD_STREET_ENGLISH, 1).alias("old"), extract._Scan(F.col("t")).street_english("street", "ſtreet").alias("new"))
    assert [r for r in both.collect() if (r["new"] or "") != r["old"]] == []
    assert extract.SELLER_STREET_ENGLISH.startswith(r"(?=\s+")


def test_amount_patterns_start_with_their_labels(spark):
    texts = ["wartość netto 1,00\nnetto: 2,50 netto\n3 wartość vat 23% vat: 5,00", "wartość  vat\t12,3%", "vat 23 wartość vat 24 wartość brutto 7 brutto x",
             "wartość brutto wartość brutto 8.00", "netto", "vat 1 % vat 2%"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for old, i in OLD_PATTERNS:
        new = extract.DECIMAL_AMOUNTS[i][0]
        assert not new.startswith("(?:")
        found = df.select(F.regexp_extract_all("t", F.lit("(?U)" + old), F.lit(1)).alias("old"), F.regexp_extract_all("t", F.lit("(?U)" + new.lower()), F.lit(1)).alias("new"))
        assert all(r["old"] == r["new"] for r in found.collect())
    numbers = ["fa/1/2/3", "FV-4-5-6", "Fa/7/8/9", "fw/1/2/3", "f/1/2/3"]
    found = spark.createDataFrame([(t,) for t in numbers], "t string").select(
        F.regexp_extract("t", r"(?iU)(?:FA|FV)[/\-](\d+[/\-]\d+[/\-]\d+)", 1).alias("old"), F.regexp_extract("t", extract.FLAGS + extract.NUMBERS[3], 1).alias("new"))
    assert all(r["old"] == r["new"] for r in found.collect()) and not extract.NUMBERS[3].startswith("(?:")


def test_large_generated_methods_are_split(spark):
    """The patterns of a document are one method of generated code otherwise, which the JVM does not compile."""
    assert int(session.RUNTIME_SETTINGS["spark.sql.codegen.hugeMethodLimit"]) <= 8000


def test_lines_travel_as_they_are_given(spark):
    """Only given columns are exchanged, texts are made behind it; rows with positions are not sorted for the join."""
    join = "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(join)
    spark.conf.set(join, "-1")
    try:
        plan = plans.records(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        physical = plans.records(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(join, kept)
    assert "Towar" in plan.split("RepartitionByExpression")[0] and "Towar" not in plan.split("RepartitionByExpression")[1]
    assert "unit_net_gr" not in plan.split("RepartitionByExpression")[1]
    assert "ShuffledHashJoin" in physical and "SortMergeJoin" not in physical


def test_written_documents_are_not_indented(spark, tmp_path):
    documents = plans._ubl_documents(spark, DATA).limit(20)
    source.write_xml(documents, F.col("document"), str(tmp_path / "ubl"), "Invoice", "Invoices")
    texts = [gzip.decompress(p.read_bytes()).decode() for p in (tmp_path / "ubl").iterdir() if p.name.startswith("part-")]
    assert texts and not any("\n  <" in t or "\n        " in t for t in texts)
    assert source.read_ubl_xml(spark, str(tmp_path / "ubl")).count() == 20


def test_documents_without_indentation_are_the_same(spark):
    records = plans.records(spark, DATA, True, True).limit(20).cache()
    as_rows = lambda indent: sorted(map(repr, canonical.to_canonical(
        source.parse_fa_xml(plans.convert.to_fa_xml(records, 2, plans.created_at(), indent=indent).select("xml"), 2).select("document.*"), "fa2").collect()))
    assert as_rows("") == as_rows("    ")
    assert "\n" not in plans.convert.to_fa_xml(records, 2, plans.created_at(), indent="").first()["xml"].strip()


def test_generated_totals_need_no_group(spark):
    """The totals of an invoice come from its seed row and are the sums of its generated lines."""
    config = source.GenerationConfig(min_positions=1, max_positions=7, tax_rate=8)
    seeds = spark.createDataFrame([(i,) for i in [*range(1, 400), None, -5, 2**40]], "seq long")
    made = generate.generate_invoices(seeds, config, F.lit("2025-12-17").cast("date"), seed=7)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan and "Join" not in plan
    sums = generate.generate_lines(seeds.where("seq IS NOT NULL"), config, 7).groupBy("seq").agg(F.sum("net_gr"), F.sum("tax_gr"), F.sum("gross_gr"), F.count("*"))
    found = made.select("seq", "net_gr", "tax_gr", "gross_gr", "line_count").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, sums.collect())) and len(found) == 401
