"""Text, date, label and hash helpers on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faktorium import codes


def collapse_whitespace(value: Column) -> Column:
    """Whitespace handling of ``xsd:token``."""
    return F.trim(F.regexp_replace(value, r"[ \t\r\n]+", " "))


def empty_as_null(value: Column) -> Column:
    return F.when(F.trim(value) != "", value)


def normalise_amount(value: Column, mode: str = "decimal") -> Column:
    """Amount text to ``digits.dd``.

    ``decimal``: the last comma or dot before exactly two final digits is the
    decimal mark, all other separators group thousands.  ``reference``: blanks
    and commas are dropped, a dot counts only before exactly two digits.
    """
    if mode == "reference":
        bare = F.regexp_replace(value, "[ ,]", "")
        cents = F.element_at(F.split(bare, r"\."), -1)
        return (
            F.when(~bare.contains("."), F.concat(bare, F.lit(".00")))
            .when(F.length(cents) == 2, bare)
            .otherwise(F.concat(F.regexp_replace(bare, r"\.", ""), F.lit(".00")))
        )
    if mode != "decimal":
        raise ValueError(f"unknown mode {mode}")
    bare = F.regexp_replace(value, r"[\s ]", "")
    whole = F.regexp_replace(F.regexp_replace(bare, r"[.,](\d{2})$", ""), "[.,]", "")
    cents = F.regexp_extract(bare, r"[.,](\d{2})$", 1)
    return F.when(whole != "", F.concat(whole, F.lit("."), F.when(cents == "", "00").otherwise(cents)))


def month_from_name(name: Column, strict: bool = False) -> Column:
    """English month name to two digits; unknown names give ``01``, or null when strict."""
    found = F.element_at(codes.literal_map(codes.MONTHS), F.lower(name))
    return found if strict else F.coalesce(found, F.lit("01"))


def normalise_date(value: Column) -> Column:
    """``DD-MM-YYYY`` with dash, dot or slash to ISO; other text is kept."""
    parts = r"^(\d{2})[-/.](\d{2})[-/.](\d{4})$"
    return F.regexp_replace(value, parts, "$3-$2-$1")


def due_date(issue: Column, days: Column | int) -> Column:
    return F.date_add(issue, days)


def payment_label(kind: Column) -> Column:
    """Label of a payment type; unknown types count as transfer."""
    labels = codes.literal_map(codes.PAYMENT_LABELS)
    return F.coalesce(F.element_at(labels, kind), F.lit(codes.PAYMENT_LABELS["transfer"]))


def payment_code(label: Column) -> Column:
    """Code 1..7 of a payment form label."""
    return F.element_at(codes.literal_map({v: k for k, v in codes.PAYMENT_FORMS.items()}), label)


def payment_form_label(code: Column) -> Column:
    return F.element_at(codes.literal_map(codes.PAYMENT_FORMS), code)


def document_file_name(number: Column, extension: str = "json") -> Column:
    return F.concat(F.lit("faktura-"), F.translate(number, "/", "-"), F.lit(f".{extension}"))


def label_quantity(quantity: Column, unit: Column) -> Column:
    """Quantity without decimals and its unit."""
    return F.format_string("%s %s", F.bround(quantity.cast("decimal(22,6)"), 0).cast("decimal(22,0)"), unit)


def content_hash(content: Column) -> Column:
    """SHA-256 of the content, base64."""
    return F.base64(F.unhex(F.sha2(content.cast("binary"), 256)))


def byte_size(content: Column) -> Column:
    return F.octet_length(content).cast("long")


def encrypt_content(content: Column, key: Column, iv: Column) -> Column:
    """AES-256 in CBC mode; the IV travels apart from the cipher text."""
    return F.substring(F.aes_encrypt(content.cast("binary"), key, F.lit("CBC"), F.lit("PKCS"), iv), 17, 2_147_483_647)


def decrypt_content(content: Column, key: Column, iv: Column) -> Column:
    return F.aes_decrypt(F.concat(iv, content), key, F.lit("CBC"), F.lit("PKCS"))


def to_base64(content: Column) -> Column:
    """Base64 on one line; Spark breaks long output into lines of 76 characters."""
    return F.translate(F.base64(content), "\r\n", "")


def json_extra_fields(line: Column, fixed: list[str]) -> Column:
    """Free keys of a JSON object as a string map, without the fixed keys."""
    parsed = F.from_json(line, "map<string,string>")
    return F.map_filter(parsed, lambda k, v: ~k.isin(fixed))


def attachment_metadata(pairs: Column, key: str = "ZKlucz", value: str = "ZWartosc") -> Column:
    """Key/value list to a map; the last value of a repeated key wins."""
    entries = F.transform(pairs, lambda p, i: F.struct(p[key].alias("key"), (-i).alias("before"), p[value].alias("value")))

    def last_of_key(ordered: Column) -> Column:
        return F.filter(ordered, lambda e, i: (i == 0) | (F.get(ordered, i - 1)["key"] != e["key"]))

    def as_map(ordered: Column) -> Column:
        return F.map_from_entries(F.transform(last_of_key(ordered), lambda e: F.struct(e["key"], e["value"])))

    # The sorted list is bound once, as the only item of an array, and not computed again for each entry.
    return F.get(F.transform(F.array(F.array_sort(entries)), as_map), F.lit(0))
