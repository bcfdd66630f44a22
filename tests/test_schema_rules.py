"""Types, bases and elements of a schema, and values checked against them."""

from pyspark.sql import functions as F

from faktorium.operators.schema_rules import check_against_schema, resolve_types
from faktorium.sources import invoices

SCHEMA = """<?xml version="1.0" encoding="UTF-8"?>
<xsd:schema xmlns:xsd="http://www.w3.org/2001/XMLSchema" xmlns:tns="http://example.org/">
  <xsd:simpleType name="TText"><xsd:restriction base="xsd:token"><xsd:minLength value="1"/><xsd:maxLength value="20"/></xsd:restriction></xsd:simpleType>
  <xsd:simpleType name="TPhone"><xsd:restriction base="tns:TText"><xsd:maxLength value="9"/></xsd:restriction></xsd:simpleType>
  <xsd:simpleType name="TCode"><xsd:restriction base="tns:TText"><xsd:pattern value="[A-Z]{2}"/><xsd:pattern value="[0-9]{3}"/></xsd:restriction></xsd:simpleType>
  <xsd:simpleType name="TShortCode"><xsd:restriction base="tns:TCode"><xsd:pattern value=".*[AEIOU1].*"/></xsd:restriction></xsd:simpleType>
  <xsd:simpleType name="TRole"><xsd:restriction base="xsd:integer"><xsd:enumeration value="1"/><xsd:enumeration value="2"/></xsd:restriction></xsd:simpleType>
  <xsd:simpleType name="TDate"><xsd:restriction base="xsd:date"><xsd:minInclusive value="1990-01-01"/><xsd:maxExclusive value="2050-01-01"/></xsd:restriction></xsd:simpleType>
  <xsd:simpleType name="TAmount"><xsd:restriction base="xsd:decimal"><xsd:totalDigits value="5"/><xsd:fractionDigits value="2"/><xsd:minInclusive value="0"/></xsd:restriction></xsd:simpleType>
  <xsd:simpleType name="TAlias"><xsd:restriction base="tns:TAmount"/></xsd:simpleType>
  <xsd:element name="Root"><xsd:complexType><xsd:sequence>
    <xsd:element type="tns:TPhone" name="Phone" minOccurs="0"/>
    <xsd:element name="Part"><xsd:complexType><xsd:sequence>
      <xsd:element name="Code" type="tns:TShortCode"/><xsd:element name="Role" type="tns:TRole"/><xsd:element name="Due" type="tns:TDate"/>
      <xsd:element name="Sum" type="tns:TAlias"/><xsd:element name="Other" type="xsd:string"/>
    </xsd:sequence></xsd:complexType></xsd:element>
  </xsd:sequence></xsd:complexType></xsd:element>
</xsd:schema>
"""

CASES = [
    ("Phone", "600 700 8", []), ("Phone", "  600\n 700 8 ", []), ("Phone", "600 700 800", ["maxLength"]), ("Phone", " ", ["minLength"]), ("Phone", None, []),
    ("Code", "AB", []), ("Code", "123", []), ("Code", "XY", ["pattern"]), ("Code", "A1", ["pattern"]), ("Code", "ABABABABABABABABABABA", ["pattern", "maxLength"]),
    ("Role", "2", []), ("Role", "3", ["enumeration"]), ("Due", "1990-01-01", []), ("Due", "1989-12-31", ["minInclusive"]), ("Due", "2050-01-01", ["maxExclusive"]),
    ("Due", "soon", ["minInclusive", "maxExclusive"]), ("Sum", "123.45", []), ("Sum", "00123.4500", []), ("Sum", "1234.56", ["totalDigits"]),
    ("Sum", "1.234", ["fractionDigits"]), ("Sum", "-1", ["minInclusive"]), ("Other", "", []), ("Unknown", "x", []),
]


def test_values_against_a_schema(spark, tmp_path):
    path = tmp_path / "schema.xsd"
    path.write_text(SCHEMA)
    types = invoices.read_schema_types(spark, str(path))
    elements = invoices.read_schema_elements(spark, str(path))
    assert {tuple(r) for r in elements.collect()} == {
        ("Phone", "tns:TPhone"), ("Code", "tns:TShortCode"), ("Role", "tns:TRole"), ("Due", "tns:TDate"), ("Sum", "tns:TAlias"), ("Other", "xsd:string"),
    }
    resolved = resolve_types(spark, types, invoices.read_schema_facets(spark, str(path)))
    facts = {r["type"]: r for r in resolved.collect()}
    assert {t: r["primitive"] for t, r in facts.items()} == {
        "TText": "token", "TPhone": "token", "TCode": "token", "TShortCode": "token", "TRole": "integer", "TDate": "date", "TAmount": "decimal", "TAlias": "decimal",
    }
    assert (facts["TPhone"]["minLength"], facts["TPhone"]["maxLength"], facts["TAlias"]["totalDigits"]) == ("1", "9", "5")
    values = spark.createDataFrame([(i, e, v) for i, (e, v, _) in enumerate(CASES)], "i int, element string, value string")
    checked = check_against_schema(values, elements, resolved).orderBy("i").collect()
    assert [(r["element"], r["value"], sorted(r["failed"])) for r in checked] == [(e, v, sorted(f)) for e, v, f in CASES]
    assert {r["element"] for r in checked if r["type"] is None} == {"Other", "Unknown"}


def test_no_types(spark):
    types, facets = spark.createDataFrame([], "type string, base string"), spark.createDataFrame([], "type string, facet string, value string")
    values = spark.createDataFrame([("a", "b")], "element string, value string")
    elements = spark.createDataFrame([("a", "T")], "element string, type string")
    assert check_against_schema(values, elements, resolve_types(spark, types, facets)).select("failed").first()[0] == []
    assert check_against_schema(values.where(F.lit(False)), elements, resolve_types(spark, types, facets)).count() == 0
