"""Invoice fields from document text: ordered pattern rules as native columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faktorium import schemas
from faktorium.functions.ids import normalise_tax_id
from faktorium.functions.text import month_from_name, normalise_amount, normalise_date
from faktorium.operators.skew import explode_items

# The label patterns of the recognised layouts, in priority order.
# (?iU) ignores case and reads \d, \s and letters as Unicode classes.
FLAGS = "(?iU)"
TAX_ID = r"NIP[:\s]*(\d{3}[-\s]?\d{3}[-\s]?\d{2}[-\s]?\d{2}|\d{10})"
NUMBERS = [
    r"INVOICE\s*#\s*(\d+)",
    r"Invoice\s+(?:Number|No\.?)[:\s]*(\d+)",
    r"Faktura\s+(?:Nr\.?|numer|VAT)?\s*[:\s]*([A-Z0-9/\-]+)",
    r"F[AV][/\-](\d+[/\-]\d+[/\-]\d+)",
    r"Numer\s+faktury[:\s]*([A-Z0-9/\-]+)",
]
ENGLISH_DATES = [
    r"DATE[:\s]*(\d{1,2})\s+([A-Za-z]+)[,\s]+(\d{4})",
    r"(?:Invoice\s+)?Date[:\s]*(\d{1,2})\s+([A-Za-z]+)[,\s]+(\d{4})",
]
NUMERIC_DATES = [
    (r"Data\s+wystawienia[:\s]*(\d{4}-\d{2}-\d{2})", "issue"),
    (r"Data\s+wystawienia[:\s]*(\d{2}[-/.]\d{2}[-/.]\d{4})", "issue"),
    (r"Data\s+sprzedaży[:\s]*(\d{4}-\d{2}-\d{2})", "sale"),
    (r"Data\s+sprzedaży[:\s]*(\d{2}[-/.]\d{2}[-/.]\d{4})", "sale"),
]
# Amount rules: the last match of a rule counts, later rules win over earlier ones.  A word before a label
# ("Wartość netto") is no part of its rule: it changes no amount, and a pattern that starts with its label is fast.
REFERENCE_AMOUNTS = [
    (r"SUBTOTAL[:\s]*([\d,\s]+(?:\.\d{2})?)\s*zł", "price_net"),
    (r"VAT\s+\d+%[:\s]*(?:EUR\s+)?([\d,\s]+(?:\.\d{2})?)\s*zł", "price_tax"),
    (r"TOTAL[:\s]*([\d,\s]+(?:\.\d{2})?)\s*zł", "price_gross"),
    (r"[Nn]etto[:\s]*([\d,\s]+)", "price_net"),
    (r"VAT[:\s]*([\d,\s]+)", "price_tax"),
    (r"[Bb]rutto[:\s]*([\d,\s]+)", "price_gross"),
    (r"Razem[:\s]*([\d,\s]+)", "price_gross"),
    (r"Do\s+zapłaty[:\s]*([\d,\s]+)", "price_gross"),
]
# The same labels where an amount starts with a digit, may hold a decimal mark
# and ends with its line; the amount due is a field of its own.
AMOUNT = r"(\d[\d,.\t   ]*)"
DECIMAL_AMOUNTS = [
    (r"SUBTOTAL[:\s]*" + AMOUNT + r"\s*zł", "price_net"),
    (r"VAT\s+\d+%[:\s]*(?:EUR\s+)?" + AMOUNT + r"\s*zł", "price_tax"),
    (r"(?<!SUB)TOTAL[:\s]*" + AMOUNT + r"\s*zł", "price_gross"),
    (r"netto[:\s]*" + AMOUNT, "price_net"),
    (r"VAT[:\s]*" + AMOUNT + r"(?![\d%])", "price_tax"),
    (r"brutto[:\s]*" + AMOUNT, "price_gross"),
    (r"Razem[:\s]*" + AMOUNT, "price_gross"),
    (r"Do\s+zapłaty[:\s]*" + AMOUNT, "amount_due"),
]
SELLER_NAME = r"Sprzedawca[:\s]*\n([^\n]+)"
SELLER_ENGLISH = r"INVOICE\s*\n([^\n]+)\s*\n([^\n]+street[^\n]*)"
BUYER_NAME = r"Nabywca[:\s]*\n([^\n]+)"
BUYER_ENGLISH = r"Bill\s+To[:\s]*([^\n]+)"
STREET = r"[uUaApP][lL]\.\s+([^\n,]+)"
# Letters of a street name, with those that ignoring case adds to the Latin ones: dotless i, long s, Kelvin sign, dotted I.
LETTERS = "A-ZĄĆĘŁŃÓŚŹŻa-ząćęłńóśźż\u0131\u017f\u212a\u0130"
# The blanks behind a name and the rest of its line; blanks are looked for first, since they are rare.
SELLER_STREET_ENGLISH = rf"(?=\s+(?iu:street)[^,\n])(?<=[{LETTERS}])(\s+(?iu:street)[^,\n]+)"
BUYER_STREET_ENGLISH = r"Bill\s+To[^\n]*\n[^\n]+\n([^\n]+)"
POSTAL = {
    "reference": r"(\d\d-\d\d\d)[,\s]+([A-ZĄĆĘŁŃÓŚŹŻa-ząćęłńóśźż\s]+)",
    "decimal": r"(\d\d-\d\d\d)[,\s]+([A-ZĄĆĘŁŃÓŚŹŻa-ząćęłńóśźż \t]+)",
}


def _fold(text: Column) -> Column:
    """Lower case under the case rules of the patterns, for cheap label tests."""
    for special, plain in (("İ", "i"), ("ı", "i"), ("ſ", "s")):
        text = F.replace(text, F.lit(special), F.lit(plain))
    return F.lower(text)


class _Scan:
    """Pattern columns over one document, each behind a test for its label.

    A substring test is far cheaper than a pattern over the whole text, and
    most documents lack most labels.
    """

    def __init__(self, text: Column, folded: Column | None = None):
        self.text = text
        self.folded = _fold(text) if folded is None else folded

    def _guard(self, labels: tuple[str, ...], found: Column) -> Column:
        test = F.contains(self.folded, F.lit(labels[0]))
        for label in labels[1:]:
            test = test | F.contains(self.folded, F.lit(label))
        return F.when(test, found)

    def street_english(self, *labels: str) -> Column:
        """First word before "street" with the rest of the line, empty when there is none.

        A pattern that starts with the word would try it from each of its letters.
        """
        rest = F.regexp_extract(self.text, "(?U)" + SELLER_STREET_ENGLISH, 1)
        before = F.regexp_replace(self.text, "(?sU)" + SELLER_STREET_ENGLISH + ".*$", "")
        word = F.regexp_extract(before, rf"(?s)^(?:.*[^{LETTERS}])?([{LETTERS}]+)$", 1)
        return self._guard(labels, F.when(rest == "", "").otherwise(F.concat(word, rest)))

    def first(self, pattern: str, *labels: str, group: int = 1) -> Column:
        """First match, empty when there is none."""
        return self._guard(labels, F.regexp_extract(self.text, FLAGS + pattern, group))

    def all(self, pattern: str, *labels: str, group: int = 1, flags: str = FLAGS) -> Column:
        return self._guard(labels, F.regexp_extract_all(self.text, F.lit(flags + pattern), F.lit(group)))

    # Ids, dates and amounts have no case: their patterns run in lower case over
    # the folded text, which is much cheaper than ignoring case at every position.
    def first_number(self, pattern: str, *labels: str, group: int = 1) -> Column:
        return self._guard(labels, F.regexp_extract(self.folded, "(?U)" + pattern.lower(), group))

    def all_numbers(self, pattern: str, *labels: str) -> Column:
        return self._guard(labels, F.regexp_extract_all(self.folded, F.lit("(?U)" + pattern.lower()), F.lit(1)))


# Fixed value: the characters that count as white space at the ends of a field.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITE_SPACE))


def _filled(value: Column) -> Column:
    return F.when(value != "", value)


def _at(values: Column, position: int) -> Column:
    return F.try_element_at(values, F.lit(position))


NUMBER_LABELS = [("invoice",), ("invoice",), ("faktura",), ("fa/", "fa-", "fv/", "fv-"), ("faktury",)]
AMOUNT_LABELS = [("subtotal",), ("vat",), ("total",), ("netto",), ("vat",), ("brutto",), ("razem",), ("zapłaty",)]


def extract_tax_ids(scan: _Scan) -> dict[str, Column]:
    """All labelled ids in order; the first is the seller's, the second the buyer's."""
    return {"_ids": scan.all_numbers(TAX_ID, "nip")}


def tax_ids() -> tuple[Column, Column]:
    return normalise_tax_id(_at(F.col("_ids"), 1)), normalise_tax_id(_at(F.col("_ids"), 2))


def extract_number(scan: _Scan) -> dict[str, Column]:
    return {f"_number_{i}": scan.first(p, *NUMBER_LABELS[i]) for i, p in enumerate(NUMBERS)}


def number() -> Column:
    """The first rule with a match wins."""
    return F.coalesce(*[_filled(F.col(f"_number_{i}")) for i in range(len(NUMBERS))])


def extract_issue_date(scan: _Scan) -> dict[str, Column]:
    english = {f"_english_{i}": scan.first_number(p, "date", group=0) for i, p in enumerate(ENGLISH_DATES)}
    label = {"issue": "wystawienia", "sale": "sprzedaży"}
    return english | {f"_date_{i}": scan.first_number(p, label[kind]) for i, (p, kind) in enumerate(NUMERIC_DATES)}


def issue_date(mode: str = "decimal") -> Column:
    """Struct of ISO ``value`` and ``source`` (``issue`` or ``sale``).

    An unknown month name counts as January in ``reference`` mode and as no
    date otherwise.
    """
    choices = []
    for i, pattern in enumerate(ENGLISH_DATES):
        found = F.col(f"_english_{i}")
        part = lambda g, p=pattern, f=found: F.regexp_extract(f, FLAGS + p, g)
        month = month_from_name(part(2), strict=mode != "reference")
        iso = F.concat(part(3), F.lit("-"), month, F.lit("-"), F.lpad(part(1), 2, "0"))
        choices.append(F.when(_filled(found).isNotNull() & month.isNotNull(), F.struct(iso.alias("value"), F.lit("issue").alias("source"))))
    for i, (_, kind) in enumerate(NUMERIC_DATES):
        found = _filled(F.col(f"_date_{i}"))
        choices.append(F.when(found.isNotNull(), F.struct(normalise_date(found).alias("value"), F.lit(kind).alias("source"))))
    return F.coalesce(*choices)


def extract_amounts(scan: _Scan, mode: str = "decimal") -> dict[str, Column]:
    """Last match of every amount rule."""
    rules = DECIMAL_AMOUNTS if mode == "decimal" else REFERENCE_AMOUNTS
    return {f"_amount_{i}": _at(scan.all_numbers(p, *AMOUNT_LABELS[i]), -1) for i, (p, _) in enumerate(rules)}


def amounts(mode: str = "decimal") -> dict[str, Column]:
    """Net, VAT, gross (and amount due): later rules win over earlier ones."""
    rules = DECIMAL_AMOUNTS if mode == "decimal" else REFERENCE_AMOUNTS
    fields: dict[str, list[Column]] = {"price_net": [], "price_tax": [], "price_gross": [], "amount_due": []}
    for i, (_, field) in reversed(list(enumerate(rules))):
        fields[field].append(F.col(f"_amount_{i}"))
    return {name: F.coalesce(*found) if found else F.lit(None).cast("string") for name, found in fields.items()}


def extract_party_names(scan: _Scan) -> dict[str, Column]:
    return {
        "_seller": scan.first(SELLER_NAME, "sprzedawca"), "_seller_english": scan.first(SELLER_ENGLISH, "street", group=0),
        "_buyer": scan.first(BUYER_NAME, "nabywca"), "_buyer_english": scan.first(BUYER_ENGLISH, "bill"),
    }


def party_names() -> tuple[Column, Column]:
    """The line after the label, else the English form."""
    english = F.regexp_extract("_seller_english", FLAGS + SELLER_ENGLISH, 1)
    either = lambda a, b: F.coalesce(_filled(_strip(a)), _filled(_strip(b)))
    return either(F.col("_seller"), english), either(F.col("_buyer"), F.col("_buyer_english"))


def extract_streets(scan: _Scan) -> dict[str, Column]:
    return {
        "_streets": scan.all(STREET, "ul.", "al.", "pl.", flags="(?U)"), "_any_street": scan.street_english("street"), "_buyer_street": scan.first(BUYER_STREET_ENGLISH, "bill"),
    }


def streets() -> tuple[Column, Column]:
    """Prefixed street lines, the first for the seller and the second for the buyer; English forms otherwise.

    The header form counts only when the seller was not found by its label.
    """
    first, second = _strip(_at(F.col("_streets"), 1)), _strip(_at(F.col("_streets"), 2))
    by_label = F.coalesce(_strip(F.col("_seller")) != "", F.lit(False))
    header = F.when(~by_label, _filled(_strip(F.regexp_extract("_seller_english", FLAGS + SELLER_ENGLISH, 2))))
    seller = F.coalesce(F.when(second.isNotNull(), first), header, first, _filled(_strip(F.col("_any_street"))))
    return seller, F.coalesce(second, _filled(_strip(F.col("_buyer_street"))))


def extract_postal_city(scan: _Scan, mode: str = "decimal") -> dict[str, Column]:
    return {"_postal": scan.all(POSTAL[mode], "-", group=0, flags="(?U)")}


def postal_city(mode: str = "decimal") -> tuple[Column, Column]:
    """Post code and city of the buyer: the second match, else the first."""
    found = F.coalesce(_at(F.col("_postal"), 2), _at(F.col("_postal"), 1))
    part = lambda g: F.regexp_extract(found, "(?U)" + POSTAL[mode], g)
    return part(1), F.regexp_replace(_strip(part(2)), ",+$", "")


def missing_fields(required: list[str]) -> Column:
    """Names of the required columns that are empty or ``0.00``."""
    names = [F.when(F.coalesce(F.col(c), F.lit("")).isin("", "0.00"), c) for c in required]
    listed = F.concat_ws(",", *names)
    return F.when(listed == "", F.array().cast("array<string>")).otherwise(F.split(listed, ","))


def scan_documents(documents: DataFrame, text: str = "text", mode: str = "decimal") -> DataFrame:
    """Every pattern once per document; the results are read by later projections."""
    folded = documents.withColumn("_folded", _fold(F.col(text)))
    scan = _Scan(F.col(text), F.col("_folded"))
    found = {
        **extract_tax_ids(scan), **extract_number(scan), **extract_issue_date(scan), **extract_amounts(scan, mode),
        **extract_party_names(scan), **extract_streets(scan), **extract_postal_city(scan, mode),
    }
    return folded.select(*documents.columns, *[column.alias(name) for name, column in found.items()])


def extract_invoice(
    documents: DataFrame, text: str = "text", mode: str = "decimal", keep_text: bool = False
) -> DataFrame:
    """All fields of every document, with the missing ones named.

    To route the result, write it with :func:`write_routes` first: a filter on
    the route would otherwise be pushed below the patterns and run them again.
    """
    keys = [c for c in documents.columns if c != text or keep_text]
    scanned = scan_documents(documents, text, mode)
    seller_id, buyer_id = tax_ids()
    seller, buyer = party_names()
    seller_street, buyer_street = streets()
    post_code, city = postal_city(mode)
    chosen = scanned.select(
        *keys, seller_id.alias("seller_tax_no"), buyer_id.alias("buyer_tax_no"), seller.alias("seller_name"),
        buyer.alias("buyer_name"), seller_street.alias("seller_street"), buyer_street.alias("buyer_street"),
        post_code.alias("buyer_post_code"), city.alias("buyer_city"), number().alias("number"),
        issue_date(mode).alias("_date"), *[c.alias(n) for n, c in amounts(mode).items()],
    )
    value = lambda column, default="": F.coalesce(column, F.lit(default))
    given = {c: value(F.col(c)) for c in schemas.EXTRACTION_FIELDS if c in chosen.columns}
    given |= {c: value(normalise_amount(F.col(c), mode), "0.00") for c in ("price_net", "price_tax", "price_gross")}
    given |= {"issue_date": value(F.col("_date.value"))}
    given |= {"seller_country": F.lit("PL"), "buyer_country": F.lit("PL"), "currency": F.lit("PLN")}
    record = chosen.select(
        *keys, *[given[c].alias(c) for c in schemas.EXTRACTION_FIELDS],
        normalise_amount(F.col("amount_due"), mode).alias("amount_due"), F.col("_date.source").alias("date_source"),
    )
    checked = record.withColumn("missing", missing_fields(schemas.REQUIRED_FIELDS))
    return checked.withColumn("success", F.size("missing") == 0)


def route_extractions(extractions: DataFrame, force_review: bool = False) -> DataFrame:
    """Complete records are converted, the others (or all, when forced) are reviewed."""
    route = F.lit("review") if force_review else F.when(F.col("success"), "convert").otherwise("review")
    return extractions.withColumn("route", route)


def write_routes(routed: DataFrame, path: str) -> DataFrame:
    """Write the extractions, one folder per route, and read them back: each route is then a pruned scan."""
    routed.write.partitionBy("route").parquet(path)
    return routed.sparkSession.read.schema(routed.schema).parquet(path)


def parse_extraction_response(df: DataFrame, response: str = "response") -> DataFrame:
    """Stored answers of an extraction service: strip the code fence, parse the 16 fields."""
    body = _strip(F.col(response))
    fenced = body.startswith("```")
    inner = F.try_element_at(F.split(body, "```"), F.lit(2))
    untagged = _strip(F.regexp_replace(inner, "^json", ""))
    payload = F.when(fenced, untagged).otherwise(body)
    schema = schemas.struct(" ".join(schemas.EXTRACTION_FIELDS), "_corrupt_record")
    parsed = F.from_json(payload, schema, {"columnNameOfCorruptRecord": "_corrupt_record"})
    rows = df.withColumn("_p", parsed)
    broken = F.col("_p._corrupt_record").isNotNull() | F.col("_p").isNull()
    return rows.select(
        *df.columns, *[F.col(f"_p.{c}").alias(c) for c in schemas.EXTRACTION_FIELDS], broken.alias("is_corrupt")
    )


def extraction_quality(extractions: DataFrame) -> DataFrame:
    """Documents per route, and how many of them miss each field.

    One row per route and field; ``field`` is ``(complete)`` for the complete ones.
    """
    reasons = F.when(F.size("missing") == 0, F.array(F.lit("(complete)"))).otherwise(F.col("missing"))
    return explode_items(extractions, ["route"], reasons, "field").groupBy("route", "field").agg(
        F.count("*").alias("documents")
    )


Extractor = Callable[[pd.DataFrame], pd.DataFrame]


def apply_extractor(review: DataFrame, extractor: Extractor, keys: list[str]) -> DataFrame:
    """Run a user-supplied extractor on the review route.

    It gets pandas batches with the keys and ``text`` and returns the keys and
    the 16 fields.
    """
    fields = {f.name: f.dataType.simpleString() for f in review.schema.fields}
    schema = ", ".join([f"{k} {fields[k]}" for k in keys] + [f"{c} string" for c in schemas.EXTRACTION_FIELDS])
    columns = [*keys, *schemas.EXTRACTION_FIELDS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield extractor(batch)[columns]

    return review.select(*keys, "text").mapInPandas(run, schema)
