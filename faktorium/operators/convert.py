"""Invoice record to structured XML, printable text and rendered templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faktorium import codes
from faktorium.functions import text
from faktorium.functions.words import amount_in_words_pl

# Defaults of an incomplete record.
DEFAULTS = {
    "seller_country": "PL", "buyer_country": "PL", "currency": "PLN", "payment_type": "transfer",
    "seller_bank": "PKO BP", "seller_street": "ul. Sprzedawcy 1", "seller_city": "Warszawa", "seller_post_code": "00-000",
    "buyer_street": "ul. Kupujacego 10", "buyer_city": "Warszawa", "buyer_post_code": "00-001",
}


def fill_defaults(df: DataFrame, defaults: dict[str, str] | None = None, empty_as_null: bool = True) -> DataFrame:
    """Missing values become defaults; an empty text counts as missing unless told otherwise."""
    for name, default in (defaults or DEFAULTS).items():
        if name in df.columns:
            value = text.empty_as_null(F.col(name)) if empty_as_null else F.col(name)
            df = df.withColumn(name, F.coalesce(value, F.lit(default)))
        else:
            df = df.withColumn(name, F.lit(default))
    return df


def fa_header(variant: int, created_at: Column) -> Column:
    """Form code, schema version, variant and creation time."""
    form = F.struct(
        F.lit(f"FA ({variant})").alias("_kodSystemowy"), F.lit(codes.SCHEMA_VERSION).alias("_wersjaSchemy"),
        F.lit(codes.FORM_CODE).alias("_VALUE"),
    )
    time = F.date_format(created_at, "yyyy-MM-dd'T'HH:mm:ss")
    if variant == 3:
        time = F.concat(time, F.lit("Z"))
    return F.struct(
        form.alias("KodFormularza"), F.lit(str(variant)).alias("WariantFormularza"), time.alias("DataWytworzeniaFa")
    )


def _party(tax_no: str, name: str, country: str, address: Column, *extra: Column) -> Column:
    return F.struct(
        F.struct(F.col(tax_no).alias("NIP"), F.col(name).alias("Nazwa")).alias("DaneIdentyfikacyjne"),
        F.struct(F.col(country).alias("KodKraju"), address.alias("AdresL1")).alias("Adres"),
        *extra,
    )


def fa_parties(variant: int) -> tuple[Column, Column]:
    """Seller with the street only; buyer with ``street, post-code city``; variant 3 needs two more flags."""
    buyer_address = F.format_string("%s, %s %s", "buyer_street", "buyer_post_code", "buyer_city")
    extra = [F.lit("2").alias("JST"), F.lit("2").alias("GV")] if variant == 3 else []
    seller = _party("seller_tax_no", "seller_name", "seller_country", F.col("seller_street"))
    buyer = _party("buyer_tax_no", "buyer_name", "buyer_country", buyer_address, *extra)
    return seller, buyer


def fa_annotations() -> Column:
    """Default flags: nothing applies."""
    no, none = F.lit("2"), F.lit("1")
    return F.struct(
        no.alias("P_16"), no.alias("P_17"), no.alias("P_18"), no.alias("P_18A"),
        F.struct(none.alias("P_19N")).alias("Zwolnienie"),
        F.struct(none.alias("P_22N")).alias("NoweSrodkiTransportu"),
        no.alias("P_23"),
        F.struct(none.alias("P_PMarzyN")).alias("PMarzy"),
    )


def fa_lines(positions: Column) -> Column:
    """Invoice positions as schema lines, numbered in array order."""
    return F.transform(
        positions,
        lambda p, i: F.struct(
            (i + 1).cast("string").alias("NrWierszaFa"), p["name"].alias("P_7"), p["quantity_unit"].alias("P_8A"),
            p["quantity"].alias("P_8B"), p["price_net"].alias("P_9A"), p["total_price_net"].alias("P_11"),
            p["tax"].alias("P_12"),
        ),
    )


def fa_body(df: DataFrame) -> Column:
    """Currency, date, number, totals, flags and kind; bucket columns of the record replace the base bucket."""
    buckets = [c for c in df.columns if c.startswith(("p_13_", "p_14_"))]
    ordered = [f"p_{k}_{b}" for b in codes.BUCKETS for k in (13, 14) if f"p_{k}_{b}" in buckets]
    totals = (
        [F.col(c).cast("string").alias(c.upper()) for c in ordered]
        if ordered
        else [F.col("price_net").cast("string").alias("P_13_1"), F.col("price_tax").cast("string").alias("P_14_1")]
    )
    lines = [fa_lines(F.col("positions")).alias("FaWiersz")] if "positions" in df.columns else []
    return F.struct(
        F.col("currency").alias("KodWaluty"), F.col("issue_date").cast("string").alias("P_1"), F.col("number").alias("P_2"),
        *totals, F.col("price_gross").cast("string").alias("P_15"), fa_annotations().alias("Adnotacje"),
        F.lit("VAT").alias("RodzajFaktury"), *lines,
    )


def fa_document(df: DataFrame, variant: int, created_at: Column) -> Column:
    seller, buyer = fa_parties(variant)
    return F.struct(
        F.lit(codes.NAMESPACES[variant]).alias("_xmlns"), fa_header(variant, created_at).alias("Naglowek"),
        seller.alias("Podmiot1"), buyer.alias("Podmiot2"), fa_body(df).alias("Fa"),
    )


def to_fa_xml(df: DataFrame, variant: int = 2, created_at: Column | None = None, indent: str = "    ") -> DataFrame:
    """Add ``xml``: the record as structured invoice of the given variant; without ``indent`` on one line, which is read faster."""
    created = F.current_timestamp() if created_at is None else created_at
    return df.withColumn("xml", F.to_xml(fa_document(df, variant, created), {"rowTag": "Faktura", "indent": indent}))


# --- Templates --------------------------------------------------------------------------
PLACEHOLDERS = ["seller_nip", "buyer_nip", "invoicing_date", "net", "vat", "gross"]


def render_template(df: DataFrame, template: Column, with_number: bool = True) -> DataFrame:
    """Add ``xml``: the template with ``#name#`` placeholders replaced by the columns of the row."""
    rendered = template
    for name in [*PLACEHOLDERS, *(["invoice_number"] if with_number else [])]:
        rendered = F.replace(rendered, F.lit(f"#{name}#"), F.col(name).cast("string"))
    return df.withColumn("xml", rendered)


def replicate_template(df: DataFrame, template: Column, copies: int) -> DataFrame:
    """``copies`` invoices from every case row, each with a number of its own.

    Copies are made in blocks, so that one case with many copies is spread over tasks. Numbers are padded to six
    digits and grow beyond them.  Without copies the result is empty.
    """
    block = 10_000
    if copies < 1:
        return render_template(df.withColumn("copy_no", F.lit(1)).withColumn("invoice_number", F.lit("")), template).limit(0)
    firsts = df.withColumn("_first", F.explode(F.sequence(F.lit(1), F.lit(copies), F.lit(block))))
    if copies > block:
        firsts = firsts.repartition("case_id", "_first")
    last = F.least(F.col("_first") + block - 1, F.lit(copies))
    numbered = firsts.withColumn("copy_no", F.explode(F.sequence(F.col("_first"), last))).drop("_first")
    number = F.format_string("%s-%06d", F.col("case_id").cast("string"), "copy_no")
    return render_template(numbered.withColumn("invoice_number", number), template)


# --- Printable text -------------------------------------------------------------------------
def _row(*cells: Column) -> Column:
    return F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells])


def _money(name: str) -> Column:
    return F.format_string("%s %s", F.col(name).cast("decimal(18,2)").cast("string"), "currency")


def render_invoice_text(df: DataFrame) -> DataFrame:
    """Add ``text``: summary, header, dates, parties, item table, totals, payment and issuer.

    Needs the record columns, ``positions`` and ``vat_rows`` (array of
    ``vat_code, net, tax, gross``: one "of which" row per rate).
    """
    lit = F.lit
    gross = F.col("price_gross").cast("decimal(18,2)")
    paid = F.coalesce(F.col("paid").cast("decimal(18,2)"), gross)
    due = F.greatest(lit(0).cast("decimal(18,2)"), (gross - paid).cast("decimal(18,2)"))
    label = lambda name, value: F.concat(lit(f"{name} "), value)
    items = F.transform(
        "positions",
        lambda p, i: _row(
            i + 1, p["name"], text.label_quantity(p["quantity"], p["quantity_unit"]), p["price_net"], p["total_price_net"],
            p["tax"], p["total_price_tax"], p["total_price_gross"],
        ),
    )
    of_which = F.transform("vat_rows", lambda r: _row(lit("W tym"), r["net"], r["vat_code"], r["tax"], r["gross"]))
    sections = [
        label("Wartość netto", _money("price_net")),
        label("Wartość VAT", _money("price_tax")),
        label("Wartość brutto", _money("price_gross")),
        label("Faktura numer", F.col("number")),
        label("Data wystawienia:", F.col("issue_date").cast("string")),
        label("Data sprzedaży:", F.col("sell_date").cast("string")),
        label("Termin płatności:", F.col("payment_to").cast("string")),
        label("Płatność:", text.payment_label(F.col("payment_type"))),
        lit("Sprzedawca"), F.col("seller_name"), F.col("seller_street"), F.concat_ws(" ", "seller_post_code", "seller_city"),
        label("NIP", F.col("seller_tax_no")), label("Konto:", F.col("seller_bank_account")), label("Bank:", F.col("seller_bank")),
        lit("Nabywca"), F.col("buyer_name"), F.col("buyer_street"), F.concat_ws(" ", "buyer_post_code", "buyer_city"),
        label("NIP", F.col("buyer_tax_no")),
        _row(*[lit(h) for h in ("LP", "Nazwa towaru / usługi", "Ilość", "Cena netto", "Wartość netto", "VAT %", "Wartość VAT", "Wartość brutto")]),
        F.array_join(items, "\n"),
        F.array_join(of_which, "\n"),
        _row(lit("Razem"), F.col("price_net"), lit(""), F.col("price_tax"), F.col("price_gross")),
        label("Wartość netto", _money("price_net")),
        label("Wartość VAT", _money("price_tax")),
        label("Wartość brutto", _money("price_gross")),
        F.format_string("Kwota opłacona %s %s", paid.cast("string"), "currency"),
        F.format_string("Do zapłaty %s %s", due.cast("string"), "currency"),
        label("Słownie:", amount_in_words_pl((gross * 100).cast("long"))),
        lit("Imię i nazwisko wystawcy"),
        F.coalesce("seller_person", lit("")),
    ]
    return df.withColumn("text", F.concat_ws("\n", *sections))
