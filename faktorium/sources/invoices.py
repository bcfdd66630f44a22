"""Readers and writers of invoice documents, page texts and reference data."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faktorium import schemas
from faktorium.functions import text
from faktorium.operators.convert import fa_document, to_fa_xml
from faktorium.sources.named import write_named

CORRUPT = "_corrupt_record"


def _with_file(df: DataFrame) -> DataFrame:
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def _xml(spark: SparkSession, path: str, tag: str, schema) -> DataFrame:
    reader = (
        spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT).option("pathGlobFilter", "*")
    )
    return reader.schema(schema.add(CORRUPT, "string") if CORRUPT not in schema.names else schema).load(path)


def read_invoice_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Invoice records: one object per file, or one per line when ``multi_line`` is off."""
    return _with_file(spark.read.schema(schemas.INVOICE_JSON).option("multiLine", multi_line).json(path))


def read_accounting_xml(spark: SparkSession, path: str, paths: list[str] | None = None) -> DataFrame:
    """Accounting exports; ``paths`` names the elements that are wanted, all when missing."""
    whole = schemas.struct(*[(f.name, f.dataType) for f in schemas.ACCOUNTING_XML])
    return _with_file(_xml(spark, path, "invoice", whole if paths is None else schemas.narrow(whole, paths)))


def read_ubl_xml(spark: SparkSession, path: str) -> DataFrame:
    return _with_file(_xml(spark, path, "Invoice", schemas.struct(*[(f.name, f.dataType) for f in schemas.UBL_XML])))


def read_fa_xml(spark: SparkSession, path: str, variant: int = 2, pattern: str = "*{.xml,.xml.gz}") -> DataFrame:
    """Structured invoices of a folder; a broken document keeps its text in the corrupt column."""
    schema = schemas.fa_xml(variant).add(CORRUPT, "string")
    reader = spark.read.format("xml").option("rowTag", "Faktura").option("ignoreNamespace", True)
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return _with_file(reader.option("pathGlobFilter", pattern).schema(schema).load(path))


def parse_fa_xml(df: DataFrame, variant: int, xml: str = "xml", paths: list[str] | None = None, plain: str | None = None) -> DataFrame:
    """Parse a column of documents; ``document`` is the nested invoice, ``is_wellformed`` tells broken XML.

    ``paths`` names the elements that are wanted, all when missing; the whole text is read in any case.

    With ``plain``, a document that is well-formed and has plain elements only comes in a column of that name, a struct
    with the fields of those, and its ``document`` is null.  The parser does work for every field of the schema.
    """
    whole = schemas.fa_xml(variant)
    wanted = whole if paths is None else schemas.narrow(whole, paths)
    # The field of other elements is only filled in front of that of broken text.
    few = schemas.with_others(wanted, schemas.PLAIN_ELEMENTS).add(CORRUPT, "string")
    schema = wanted.add(CORRUPT, "string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "ignoreNamespace": "true"}
    if plain is not None:
        held = [(F.size(F.array_compact(F.col(p))) > 0) if in_items else F.col(p).isNotNull() for p, in_items in schemas.others_within(few, plain)]
        other = reduce(lambda a, b: a | b, held, F.col(f"{plain}.{CORRUPT}").isNotNull())
        read = df.withColumn(plain, F.from_xml(xml, few, {**options, "wildcardColName": schemas.OTHERS}))
        parsed = read.withColumn("document", F.when(other | F.col(plain).isNull(), F.from_xml(xml, schema, options)))
        parsed = parsed.withColumn(plain, F.when(F.col("document").isNull(), F.col(plain)))
        good = F.col(plain).isNotNull() | (F.col("document").isNotNull() & F.col(f"document.{CORRUPT}").isNull())
        return parsed.withColumn("is_wellformed", good)
    parsed = df.withColumn("document", F.from_xml(xml, schema, options))
    good = F.col("document").isNotNull() & F.col(f"document.{CORRUPT}").isNull()
    return parsed.withColumn("is_wellformed", good)


def assemble_pages(pages: DataFrame, document: str = "doc_id") -> DataFrame:
    """Page texts in page order, joined by a blank line; pages without text are skipped.

    A document becomes one text value, so its pages fit one row by definition.
    """
    filled = pages.where(F.col("text").isNotNull() & (F.col("text") != ""))
    ordered = F.sort_array(F.collect_list(F.struct("page_no", "text")))
    joined = filled.groupBy(document).agg(ordered.alias("_pages"))
    return joined.select(document, F.array_join(F.transform("_pages", lambda p: p["text"]), "\n\n").alias("text"))


def read_error_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """``code : text`` lines."""
    pattern = r"^\s*(\d+)\s*:\s*(.*?)\s*$"
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(
        F.regexp_extract("value", pattern, 1).cast("int").alias("code"), F.regexp_extract("value", pattern, 2).alias("text")
    )


def read_schema_facets(spark: SparkSession, path: str, row_tag: str = "simpleType") -> DataFrame:
    """Named simple types of an XML schema as rows of (type, base, facet, value)."""
    value = schemas.many(schemas.struct("_value"))
    facets = ["pattern", "enumeration", "length", "minLength", "maxLength", "totalDigits", "fractionDigits",
              "minInclusive", "maxInclusive", "minExclusive", "maxExclusive", "whiteSpace"]
    restriction = schemas.struct("_base", *[(f, value) for f in facets])
    types = _xml(spark, path, row_tag, schemas.struct("_name", ("restriction", restriction)))

    def rows_of(facet: str) -> Column:
        return F.transform(f"restriction.{facet}", lambda v: F.struct(F.lit(facet).alias("facet"), v["_value"].alias("value")))

    empty = F.array().cast("array<struct<facet:string,value:string>>")
    rows = types.where(F.col("_name").isNotNull()).select(
        F.col("_name").alias("type"), F.col("restriction._base").alias("base"),
        F.explode(F.flatten(F.array(*[F.coalesce(rows_of(f), empty) for f in facets]))).alias("_f"),
    )
    return rows.select("type", "base", "_f.facet", "_f.value")


def read_schema_types(spark: SparkSession, path: str, row_tag: str = "simpleType") -> DataFrame:
    """Named simple types of an XML schema and their bases: ``type, base``."""
    types = _xml(spark, path, row_tag, schemas.struct("_name", ("restriction", schemas.struct("_base"))))
    return types.select(F.col("_name").alias("type"), F.col("restriction._base").alias("base")).where("type IS NOT NULL AND base IS NOT NULL")


def read_schema_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of an XML schema that name their type, at any depth: ``element, type``, each pair once.

    Elements hold elements, so the opening tags are taken from the text; a tag
    stands on one line.
    """
    tag = F.regexp_extract_all("value", F.lit(r"<(?:\w+:)?element\s[^>]*>"), F.lit(0))
    tags = spark.read.text(path).select(F.explode(tag).alias("tag"))
    attribute = lambda name: F.nullif(F.regexp_extract("tag", rf'\s{name}\s*=\s*"([^"]*)"', 1), F.lit(""))
    return tags.select(attribute("name").alias("element"), attribute("type").alias("type")).where("element IS NOT NULL AND type IS NOT NULL").distinct()


# --- Generator settings ------------------------------------------------------------------------
@dataclass
class GenerationConfig:
    """Product pool and ranges of the invoice generator."""

    seller: dict = field(default_factory=lambda: {
        "name": "Stolarnia Dabrowa", "tax_no": "5213017228", "street": "ul. Bukowa 7", "post_code": "62-800",
        "city": "Kalisz", "country": "PL", "person": "Ola Zielinska", "bank": "Bank Rzeczny",
        "bank_account": "55102010260000042270201111",
    })
    buyer: dict = field(default_factory=dict)
    currency: str = "PLN"
    payment_type: str = "transfer"
    payment_days: int = 7
    tax_rate: int = 23
    quantity_unit: str = "szt"
    products: list = field(default_factory=lambda: [
        {"name": "Stol debowy", "price_net_min": 640, "price_net_max": 1900},
        {"name": "Krzeslo", "price_net_min": 85, "price_net_max": 260},
        {"name": "Polka scienna", "price_net_min": 30, "price_net_max": 145},
        {"name": "Komoda", "price_net_min": 410, "price_net_max": 980},
    ])
    min_positions: int = 1
    max_positions: int = 5
    min_quantity: int = 1
    max_quantity: int = 10


def load_generation_config(path: str | None, spark: SparkSession | None = None) -> GenerationConfig:
    """Settings from a YAML file; defaults when there is none.

    With a session the file is read by Spark, from whatever store the path names.
    """
    if path is None or (spark is None and not Path(path).exists()):
        return GenerationConfig()
    import yaml

    content = Path(path).read_text(encoding="utf-8") if spark is None else "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    data = yaml.safe_load(content) or {}
    defaults = GenerationConfig()
    invoice, generation = data.get("invoice", {}), data.get("generation", {})
    pick = lambda section, name: section.get(name, getattr(defaults, name))
    return GenerationConfig(
        seller={**defaults.seller, **(data.get("seller") or {})},
        buyer={k: v for k, v in (data.get("buyer") or {}).items() if v},
        products=data.get("products", defaults.products),
        **{n: pick(invoice, n) for n in ("currency", "payment_type", "payment_days", "tax_rate", "quantity_unit")},
        **{n: pick(generation, n) for n in ("min_positions", "max_positions", "min_quantity", "max_quantity")},
    )


# --- Sinks -----------------------------------------------------------------------------------------
def write_invoice_json(df: DataFrame, path: str) -> None:
    """One JSON document per invoice; nulls are written, text stays UTF-8.  Names repeat in every document, so files are compressed."""
    df.write.option("ignoreNullFields", False).option("compression", "gzip").json(path)


# Records per written file, so that a reader gets many files of moderate size.
RECORDS_PER_FILE = 200_000


def write_xml(df: DataFrame, document: Column, path: str, row_tag: str, root_tag: str) -> None:
    """Documents (a struct column) as well-formed, compressed files: one root, one row element per document, without indentation."""
    writer = df.select(document.alias("_document")).select("_document.*").write.format("xml")
    writer = writer.option("rowTag", row_tag).option("rootTag", root_tag).option("declaration", 'version="1.0" encoding="UTF-8"')
    writer.option("indent", "").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).save(path)


def write_fa_xml(df: DataFrame, path: str, variant: int = 2, created_at: Column | None = None) -> None:
    """Convert invoice records and write them as structured XML."""
    created = F.current_timestamp() if created_at is None else created_at
    write_xml(df, fa_document(df, variant, created), path, "Faktura", "Faktury")


def write_invoice_documents(df: DataFrame, path: str, order: str) -> int:
    """One JSON file per invoice, named after its ``number``; names that clash are numbered in the order of a bigint column."""
    content = F.to_json(F.struct(*[F.col(c) for c in df.columns if c != order]), {"ignoreNullFields": "false"})
    return write_named(df, path, text.document_file_name(F.col("number"), "json"), content, order)


def write_fa_documents(df: DataFrame, path: str, order: str, variant: int = 2, created_at: Column | None = None) -> int:
    """Convert invoice records; one XML file per invoice, named after its ``number``."""
    created = F.current_timestamp() if created_at is None else created_at
    return write_named(to_fa_xml(df, variant, created), path, text.document_file_name(F.col("number"), "xml"), "xml", order)


def split_valid_invalid(df: DataFrame, path: str, violations: str = "violations") -> tuple[DataFrame, DataFrame]:
    """Valid documents go on; the invalid ones keep all their messages.

    One write with a folder per outcome: two filters on the result of the rules
    would run all of them twice.
    """
    errors = F.filter(F.col(violations), lambda v: v["severity"] == "error")
    df.withColumn("is_valid", F.size(errors) == 0).write.partitionBy("is_valid").parquet(path)
    written = df.sparkSession.read.schema(df.withColumn("is_valid", F.lit(True)).schema).parquet(path)
    return written.where("is_valid").drop("is_valid"), written.where("NOT is_valid").drop("is_valid")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
