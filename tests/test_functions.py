"""Scalar functions on hand-checked values."""

import pytest
from pyspark.sql import functions as F

from faktorium.functions import checks, ids, money, text, words


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("grosze", "expected"), [
    (0, "zero złotych zero groszy"),
    (100, "jeden złoty"),
    (202, "dwa złote dwa grosze"),
    (1, "zero złotych jeden grosz"),
    (1200, "dwanaście złotych"),
    (16400, "sto sześćdziesiąt cztery złote"),
    (100000, "tysiąc złotych"),
    (421307, "cztery tysiące dwieście trzynaście złotych siedem groszy"),
    (1300000, "trzynaście tysięcy złotych"),
    (100000000, "1000000 złotych"),
])
def test_amount_in_words(spark, grosze, expected):
    assert value(spark, words.amount_in_words_pl(F.lit(grosze))) == expected


@pytest.mark.parametrize(("raw", "decimal", "reference"), [
    ("6208.40", "6208.40", "6208.40"),
    ("8 917,05", "8917.05", "891705.00"),
    ("31,450.00", "31450.00", "31450.00"),
    ("31.450", "31450.00", "31450.00"),
    ("2.604.118,37", "2604118.37", "260411837.00"),
    ("640", "640.00", "640.00"),
])
def test_normalise_amount(spark, raw, decimal, reference):
    assert value(spark, text.normalise_amount(F.lit(raw))) == decimal
    assert value(spark, text.normalise_amount(F.lit(raw), "reference")) == reference


def test_half_up_division(spark):
    assert value(spark, money.divide_half_up(F.lit(5), F.lit(2))) == 3
    assert value(spark, money.divide_half_up(F.lit(-5), F.lit(2))) == -3
    assert value(spark, money.tax_grosze(F.lit(1847311), F.lit(23))) == 424882
    assert value(spark, money.tax_grosze(F.lit(3390450), F.lit(23))) == 779804


def test_pesel(spark):
    assert value(spark, ids.check_pesel(F.lit("44051401359")))
    assert str(value(spark, ids.pesel_birth_date(F.lit("44051401359")))) == "1944-05-14"
    assert str(value(spark, ids.pesel_birth_date(F.lit("02270803624")))) == "2002-07-08"
    assert not value(spark, ids.check_pesel(F.lit("44051401358")))
    assert not value(spark, ids.check_pesel(F.lit("44023001358")))


def test_iban(spark):
    assert value(spark, ids.check_iban_pl(F.lit("PL61109010140000071219812874")))
    assert not value(spark, ids.check_iban_pl(F.lit("PL62109010140000071219812874")))


def test_vat_eu(spark):
    good = ["ATU12345678", "DE123456789", "ES12345678A", "IE1+12345A", "NL123456789B01", "XIGD123", "LT123456789"]
    bad = ["AT12345678", "DE12345678", "PL1234567890", "XIGD12", "123456789"]
    assert all(value(spark, ids.check_vat_eu(F.lit(x))) for x in good)
    assert not any(value(spark, ids.check_vat_eu(F.lit(x))) for x in bad)
    assert value(spark, ids.check_vat_eu(F.lit("123456789"), "reference"))
    assert value(spark, ids.check_nip_vat_eu(F.lit("7311234567-DE123456789")))


@pytest.mark.parametrize(("amount", "expected"), [
    ("917.4", True), ("0", True), ("-12.34", True), ("01.00", False), ("100.999", False), ("1,00", False), ("", False), ("1234567890123456", True),
    ("12345678901234567", False),
])
def test_amount_facet(spark, amount, expected):
    assert value(spark, checks.check_amount(F.lit(amount))) is expected


def test_clearance_number(spark):
    parsed = value(spark, checks.parse_clearance_number(F.lit("1234563218-20250416-010080-615740-E4")))
    assert parsed["taxpayer"] == "1234563218" and str(parsed["received_on"]) == "2025-04-16"
    assert parsed["technical"] == "010080615740" and parsed["check_pair"] == "E4" and parsed["is_valid"]
    assert not value(spark, checks.parse_clearance_number(F.lit("1234563218-20250230-010080-615740-E4")))["is_valid"]


def test_payment_link(spark):
    good = "https://pay.example.com/x?a=1&IPKSeF=123ABCDEFGHIJ"
    assert value(spark, checks.check_payment_link(F.lit(good), F.lit("123ABCDEFGHIJ")))
    assert not value(spark, checks.check_payment_link(F.lit(good), F.lit("123ABCDEFGHIX")))
    assert not value(spark, checks.check_payment_link(F.lit("http://localhost/?IPKSeF=123ABCDEFGHIJ"), F.lit("123ABCDEFGHIJ")))


def test_encryption_round_trip(spark):
    key, iv = F.unhex(F.sha2(F.lit("k"), 256)), F.unhex(F.md5(F.lit("k")))
    sealed = text.encrypt_content(F.lit("treść faktury"), key, iv)
    row = spark.range(1).select(F.octet_length(sealed).alias("n"), text.decrypt_content(sealed, key, iv).cast("string").alias("t")).first()
    assert row["n"] == 16 and row["t"] == "treść faktury"


def test_metadata_keeps_last_value(spark):
    pairs = F.array(*[F.struct(F.lit(k).alias("ZKlucz"), F.lit(v).alias("ZWartosc")) for k, v in (("a", "1"), ("b", "2"), ("a", "3"))])
    assert value(spark, text.attachment_metadata(pairs)) == {"a": "3", "b": "2"}
