"""Queries on reference data files, written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from faktorium import schemas
from faktorium.operators import convert, extract
from faktorium.operators import reconcile as rec
from faktorium.operators.schema_rules import check_against_schema as check_values
from faktorium.operators.schema_rules import resolve_types
from faktorium.plans import tables as t
from faktorium.plans.documents import RECORDS_SQL, records
from faktorium.plans.registry import query
from faktorium.session import work_path
from faktorium.sources import invoices as source


def _catalogue(spark, sf):
    """One ``code : text`` line per part, with blank lines in between."""
    path = work_path(spark, "catalogue")
    parts = t.read_table(spark, sf, "part")
    line = F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit(" : "), F.col("p_name"), F.lit(" ["), F.col("p_brand"), F.lit("]. "))
    parts.select(F.explode(F.array(line, F.lit(""))).alias("value")).write.text(path)
    return source.read_error_catalogue(spark, path)


@query("read_error_catalogue", "SELECT CAST(p_partkey AS INTEGER) AS code, p_name || ' [' || p_brand || '].' AS text FROM part")
def read_error_catalogue(spark, sf):
    return _catalogue(spark, sf)


@query("with_error_text", """
SELECT event_id, CAST(CAST(props->>'k' AS INTEGER) AS INTEGER) AS error_code, p_name || ' [' || p_brand || '].' AS error_text
FROM events LEFT JOIN part ON p_partkey = CAST(props->>'k' AS BIGINT) WHERE event_type = 'error'""")
def with_error_text(spark, sf):
    errors = t.read_table(spark, sf, "events").where("event_type = 'error'").select(
        "event_id", F.get_json_object("props", "$.k").cast("int").alias("error_code")
    )
    return rec.with_error_text(errors, _catalogue(spark, sf)).select("event_id", "error_code", "error_text")


@query("read_schema_facets", """
SELECT 'T' || p_partkey AS type, 'xsd:token' AS base, facet, CASE facet WHEN 'maxLength' THEN CAST(p_size AS VARCHAR) WHEN 'minLength' THEN '1'
  WHEN 'pattern' THEN '[A-Z]{' || p_size || '}' ELSE p_name END AS value
FROM part, (VALUES ('minLength'), ('maxLength'), ('pattern'), ('enumeration')) AS f(facet)""")
def read_schema_facets(spark, sf):
    path = work_path(spark, "schema")
    value = lambda column: F.struct(column.alias("_value"))
    document = F.struct(
        F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("_name"),
        F.struct(
            F.lit("xsd:token").alias("_base"), value(F.lit("1")).alias("minLength"), value(F.col("p_size").cast("string")).alias("maxLength"),
            value(F.concat(F.lit("[A-Z]{"), F.col("p_size").cast("string"), F.lit("}"))).alias("pattern"),
            F.array(value(F.col("p_name"))).alias("enumeration"),
        ).alias("restriction"),
    )
    source.write_xml(t.read_table(spark, sf, "part"), document, path, "simpleType", "schema")
    return source.read_schema_facets(spark, path, "simpleType")


# Four types in a row for every four parts, each the base of the next: a pattern and a length, another pattern and a shorter
# length, a longer shortest length, a list. Values are the brand and the container of the part, and the brand of the next one.
SCHEMA_SQL = """
WITH p AS (SELECT p_partkey AS k, p_partkey % 4 AS place, p_size, p_brand, p_type, p_name FROM part),
v AS (SELECT k, place, p_brand AS value FROM p UNION ALL SELECT k, place, ' ' || p_type || '  ' FROM p UNION ALL SELECT k, place, p_name FROM p),
b AS (SELECT k - k % 4 AS head, max(CASE WHEN place = 0 THEN p_size END) AS size, max(CASE WHEN place = 3 THEN p_brand END) AS listed,
             bool_or(place = 0) AS has0, bool_or(place = 1) AS has1, bool_or(place = 2) AS has2 FROM p GROUP BY 1),
c AS (SELECT v.*, trim(regexp_replace(value, '[ \\t\\r\\n]+', ' ', 'g')) AS t, b.* FROM v JOIN b ON b.head = v.k - v.k % 4)
SELECT 'E' || k AS element, value, 'T' || k AS type, list_filter([
  CASE WHEN (has0 AND NOT regexp_full_match(t, '[A-Za-z0-9# ]+')) OR (place >= 1 AND has1 AND NOT regexp_full_match(t, '.*[a-m].*')) THEN 'pattern' END,
  CASE WHEN place = 3 AND t <> listed THEN 'enumeration' END,
  CASE WHEN place >= 2 AND has2 AND length(t) < 7 THEN 'minLength' END,
  CASE WHEN place >= 1 AND has1 THEN CASE WHEN length(t) > 8 THEN 'maxLength' END WHEN has0 AND length(t) > size THEN 'maxLength' END], lambda x: x IS NOT NULL) AS failed
FROM c"""


@query("check_against_schema", SCHEMA_SQL)
def check_against_schema(spark, sf):
    """A schema with chains of types and an element per type, written, read back, resolved and applied."""
    parts, path = t.read_table(spark, sf, "part"), work_path(spark, "types")
    k = F.col("p_partkey")
    text, place = k.cast("string"), k % 4
    value = lambda c: F.struct(c.alias("_value"))
    pattern = F.when(place == 0, value(F.lit("[A-Za-z0-9# ]+"))).when(place == 1, value(F.lit(".*[a-m].*")))
    longest = F.when(place == 0, value(F.col("p_size").cast("string"))).when(place == 1, value(F.lit("8")))
    simple = F.struct(
        F.concat(F.lit("T"), text).alias("_name"),
        F.struct(
            F.when(place == 0, "xsd:token").otherwise(F.concat(F.lit("tns:T"), (k - 1).cast("string"))).alias("_base"),
            F.when(place == 2, value(F.lit("7"))).alias("minLength"), longest.alias("maxLength"), pattern.alias("pattern"),
            F.when(place == 3, F.array(value(F.col("p_brand")))).alias("enumeration"),
        ).alias("restriction"),
    )
    element = F.struct(F.concat(F.lit("E"), text).alias("_name"), F.concat(F.lit("tns:T"), text).alias("_type"))
    source.write_xml(parts, simple, path + "/types", "simpleType", "schema")
    source.write_xml(parts, element, path + "/elements", "element", "schema")
    facets = source.read_schema_facets(spark, path + "/types")
    resolved = resolve_types(spark, source.read_schema_types(spark, path + "/types"), facets)
    given = F.array("p_brand", F.concat(F.lit(" "), "p_type", F.lit("  ")), "p_name")
    values = parts.select(F.concat(F.lit("E"), text).alias("element"), F.explode(given).alias("value"))
    return check_values(values, source.read_schema_elements(spark, path + "/elements"), resolved)


@query("missing_fields", f"""
WITH {RECORDS_SQL}
SELECT invoice_id, concat_ws(',', CASE WHEN invoice_id % 4 = 0 THEN 'seller_name' END, CASE WHEN invoice_id % 3 = 0 THEN 'buyer_tax_no' END,
  CASE WHEN tax = 0 THEN 'price_tax' END) AS missing FROM records""")
def missing_fields(spark, sf):
    holes = records(spark, sf, False).withColumn("seller_name", F.when(F.col("invoice_id") % 4 != 0, F.col("seller_name"))).withColumn(
        "buyer_tax_no", F.when(F.col("invoice_id") % 3 == 0, "").otherwise(F.col("buyer_tax_no"))
    )
    return holes.select("invoice_id", F.array_join(extract.missing_fields(schemas.REQUIRED_FIELDS), ",").alias("missing"))


@query("fa_annotations", f"""
WITH {RECORDS_SQL} SELECT invoice_id, '2' AS p_16, '2' AS p_17, '2' AS p_18, '2' AS p_18a, '1' AS p_19n, '1' AS p_22n, '2' AS p_23, '1' AS margin_none FROM records""")
def fa_annotations(spark, sf):
    rows = records(spark, sf, False).select("invoice_id", convert.fa_annotations().alias("a"))
    return rows.select(
        "invoice_id", F.col("a.P_16").alias("p_16"), F.col("a.P_17").alias("p_17"), F.col("a.P_18").alias("p_18"), F.col("a.P_18A").alias("p_18a"),
        F.col("a.Zwolnienie.P_19N").alias("p_19n"), F.col("a.NoweSrodkiTransportu.P_22N").alias("p_22n"), F.col("a.P_23").alias("p_23"),
        F.col("a.PMarzy.P_PMarzyN").alias("margin_none"),
    )
