"""Rules on structured invoices and invoice tables: every finding becomes a violation.

Rules that look at one document are column expressions gathered in one array
per document, without a shuffle.  Rules that compare rows are joins or
aggregates with the same output columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faktorium import codes
from faktorium.functions import checks, ids
from faktorium.functions.money import from_grosze, tax_grosze
from faktorium.operators.content import Content, choice, optional, sequence
from faktorium.operators.lines import bucket_of
from faktorium.operators.skew import explode_items

class Document:
    """Where the rules find the elements of a document: in columns of the whole schema, or in a struct with some of its fields.

    A path that the struct hasn't is null; the optimizer drops the rules that a null passes.
    """

    def __init__(self, column: str = "", schema: T.StructType | None = None):
        self.prefix, self.schema = f"{column}." if column else "", schema

    def _type(self, path: str) -> T.DataType | None:
        kind: T.DataType | None = self.schema
        for name in path.split("."):
            kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
            kind = kind[name].dataType if isinstance(kind, T.StructType) and name in kind.names else None
        return kind

    def has(self, path: str) -> bool:
        return self.schema is None or self._type(path) is not None

    def __call__(self, path: str) -> Column:
        return F.col(self.prefix + path) if self.has(path) else F.lit(None).cast("string")

    def present(self, array: str, facets: dict[str, str]) -> dict[str, str]:
        """The facets of those parts of a repeated element that there are."""
        return {part: facet for part, facet in facets.items() if self.has(f"{array}.{part}")}


WHOLE = Document()
VIOLATION = "struct<rule_id:string,path:string,severity:string,message:string,raw_value:string>"
Check = Callable[[Column], Column]


def violation(
    bad: Column, rule_id: str, path: str | Column, message: str | Column, raw: Column | None = None, severity: str = "error"
) -> Column:
    """A violation struct where ``bad`` holds, else null."""
    where, said = (F.lit(x) if isinstance(x, str) else x for x in (path, message))
    return F.when(
        bad,
        F.struct(
            F.lit(rule_id).alias("rule_id"), where.alias("path"), F.lit(severity).alias("severity"),
            said.alias("message"), (F.lit(None) if raw is None else raw).cast("string").alias("raw_value"),
        ),
    )


def gather(*found: Column) -> Column:
    """The violations that apply, in rule order."""
    return F.array_compact(F.array(*found))


def explode_violations(df: DataFrame, keys: Sequence[str], violations: str = "violations") -> DataFrame:
    return explode_items(df, keys, violations, "_v").select(*keys, "_v.*")


def as_violations(
    found: DataFrame, document: Column, rule_id: str, path: str, message: str, raw: Column | None = None, severity: str = "error"
) -> DataFrame:
    """Findings of a join or an aggregate in the shape of ``explode_violations``, one per row, under the key ``document``."""
    return found.select(
        document.cast("string").alias("document"), F.lit(rule_id).alias("rule_id"), F.lit(path).alias("path"), F.lit(severity).alias("severity"),
        F.lit(message).alias("message"), (F.lit(None) if raw is None else raw).cast("string").alias("raw_value"),
    )


# --- Facets ---------------------------------------------------------------------------------
# One check per named type of the schema: rule, message, function.
FACETS: dict[str, tuple[str, str, Check]] = {
    "TKwotowy": ("VAL-01", "amount is not a number with at most two decimals", checks.check_amount),
    "TKwotowy2": ("VAL-02", "unit price is not a number with at most eight decimals", checks.check_unit_price),
    "TIlosci": ("VAL-03", "quantity is not a number with at most six decimals", checks.check_quantity),
    "TProcentowy": ("VAL-04", "percentage is not between 0 and 100", checks.check_percent),
    **{
        name: ("VAL-05", f"text is empty or longer than {longest} characters", lambda c, n=longest: checks.check_text_length(c, n))
        for name, longest in codes.TEXT_LENGTHS.items()
    },
    **{
        name: ("VAL-06", f"date is not between {low} and {high}", lambda c, n=name: checks.check_date_range(c, n))
        for name, (low, high) in codes.DATE_RANGES.items()
    },
    "TDataCzas": ("VAL-06", "time is out of range", checks.check_time_range),
    **{name: ("VAL-07", f"value is not in the list {name}", lambda c, n=name: checks.check_listed(c, n)) for name in codes.CODE_LISTS},
    "flag": ("VAL-07", "flag is not 1 or 2", checks.check_flag),
    "choice": ("VAL-07", "flag is not 1", lambda c: checks.check_flag(c, False)),
    "TNaturalny": ("VAL-26", "row number is not positive", checks.check_positive),
    "TNrVatUE": ("VAL-09", "VAT number is not 1 to 12 capital letters, digits, + or *", checks.check_generic_vat),
    "TSwift": ("VAL-11", "SWIFT code is malformed", checks.check_swift),
    "clearance_number": ("VAL-08", "clearance number is malformed", lambda c: c.isNull() | checks.parse_clearance_number(c)["is_valid"]),
    "krs": ("VAL-05", "registry number is not 10 digits", lambda c: checks.check_digit_count(c, 10)),
    "regon": ("VAL-05", "registry number is not 9 or 14 digits", lambda c: checks.check_digit_count(c, 9, 14)),
    "account_2": ("VAL-11", "account is not 10 to 32 capital letters or digits", lambda c: checks.check_bank_account(c, 2)),
    "account_3": ("VAL-11", "account is not 10 to 34 characters", lambda c: checks.check_bank_account(c, 3)),
}

# Facet of each element below Fa, by line level.
BODY_FACETS = {
    "KodWaluty": "currency", "P_1": "TDataT", "P_1M": "TZnakowy", "P_2": "TZnakowy", "P_6": "TDataT",
    **{f"P_13_{b}": "TKwotowy" for b in codes.BUCKETS}, **{f"P_14_{b}": "TKwotowy" for b in codes.TAXED_BUCKETS},
    **{f"P_14_{b}W": "TKwotowy" for b in codes.TAXED_BUCKETS[:4]},
    "P_15": "TKwotowy", "KursWalutyZ": "TIlosci", "RodzajFaktury": "kind", "PrzyczynaKorekty": "TZnakowy",
    "TypKorekty": "correction_type", "P_15ZK": "TKwotowy", "FP": "choice", "TP": "choice",
}
LINE_FACETS = {
    "NrWierszaFa": "TNaturalny", "UU_ID": "TZnakowy50", "P_6A": "TDataT", "P_7": "TZnakowy", "Indeks": "TZnakowy50",
    "GTIN": "TZnakowy20", "PKWiU": "TZnakowy50", "CN": "TZnakowy50", "PKOB": "TZnakowy50", "P_8A": "TZnakowy", "P_8B": "TIlosci",
    "P_9A": "TKwotowy2", "P_9B": "TKwotowy2", "P_10": "TKwotowy2", "P_11": "TKwotowy", "P_11A": "TKwotowy", "P_11Vat": "TKwotowy",
    "P_12": "vat_code", "P_12_XII": "TProcentowy", "P_12_Zal_15": "choice", "KwotaAkcyzy": "TKwotowy", "GTU": "gtu",
    "Procedura": "procedure", "KursWaluty": "TIlosci", "StanPrzed": "choice",
}
ORDER_FACETS = {
    "NrWierszaZam": "TNaturalny", "UU_IDZ": "TZnakowy50", "P_7Z": "TZnakowy", "P_8BZ": "TIlosci", "P_9AZ": "TKwotowy2",
    "P_11NettoZ": "TKwotowy", "P_11VatZ": "TKwotowy", "P_12Z": "vat_code", "GTUZ": "gtu", "ProceduraZ": "order_procedure",
}
ACCOUNT_FACETS = {"NrRB": "account_2", "SWIFT": "TSwift", "RachunekWlasnyBanku": "own_account", "NazwaBanku": "TZnakowy", "OpisRachunku": "TZnakowy"}
VEHICLE_FACETS = {
    "P_22A": "TDataT", "P_NrWierszaNST": "TNaturalny",
    **{f"P_22{x}": "TZnakowy" for x in ("BMK", "BMD", "BK", "BNR", "BRP", "B", "B1", "B2", "B3", "B4", "BT", "C", "C1", "D", "D1")},
}
TRANSPORT_FACETS = {
    "RodzajTransportu": "transport", "TransportInny": "choice", "OpisInnegoTransportu": "TZnakowy50", "NrZleceniaTransportu": "TZnakowy",
    "OpisLadunku": "cargo", "LadunekInny": "choice", "OpisInnegoLadunku": "TZnakowy50", "JednostkaOpakowania": "TZnakowy",
    "DataGodzRozpTransportu": "TDataCzas", "DataGodzZakTransportu": "TDataCzas",
}
# Facets of the parts of other repeated elements.
ARRAY_FACETS = {
    "Podmiot3": {
        "IDNabywcy": "buyer_link", "NrEORI": "TZnakowy", "Rola": "third_party_role", "RolaInna": "choice", "OpisRoli": "TZnakowy",
        "Udzial": "TProcentowy", "NrKlienta": "TZnakowy",
    },
    "Podmiot1.DaneKontaktowe": {"Telefon": "phone"}, "Podmiot2.DaneKontaktowe": {"Telefon": "phone"},
    "PodmiotUpowazniony.DaneKontaktowe": {"TelefonPU": "phone"},
    "Fa.WarunkiTransakcji.Transport": TRANSPORT_FACETS,
    "Fa.WarunkiTransakcji.Umowy": {"DataUmowy": "contract_date", "NrUmowy": "TZnakowy"},
    "Fa.WarunkiTransakcji.Zamowienia": {"DataZamowienia": "contract_date", "NrZamowienia": "TZnakowy"},
    "Fa.DaneFaKorygowanej": {
        "DataWystFaKorygowanej": "TDataT", "NrFaKorygowanej": "TZnakowy", "NrKSeF": "choice", "NrKSeFFaKorygowanej": "clearance_number", "NrKSeFN": "choice",
    },
    "Fa.FakturaZaliczkowa": {"NrKSeFZN": "choice", "NrFaZaliczkowej": "TZnakowy", "NrKSeFFaZaliczkowej": "clearance_number"},
    "Fa.Adnotacje.NoweSrodkiTransportu.NowySrodekTransportu": VEHICLE_FACETS,
    "Fa.Platnosc.RachunekBankowy": ACCOUNT_FACETS, "Fa.Platnosc.RachunekBankowyFaktora": ACCOUNT_FACETS,
    "Fa.Platnosc.ZaplataCzesciowa": {"KwotaZaplatyCzesciowej": "TKwotowy", "DataZaplatyCzesciowej": "TData"},
    "Fa.Platnosc.TerminPlatnosci": {"Termin": "TData"},
    "Stopka.Rejestry": {"PelnaNazwa": "TZnakowy", "KRS": "krs", "REGON": "regon", "BDO": "registry"},
}
# The same inside a repeated element: element, part.
NESTED_FACETS = {("Podmiot3", "DaneKontaktowe"): {"Telefon": "phone"}}
# Types that differ by variant.
VARIANT_2 = {"contract_date": "TData"}
VARIANT_3 = {"vat_code": "vat_code_3", "third_party_role": "third_party_role_3", "account_2": "account_3", "contract_date": "TDataU"}
LONG_NAMES_3 = {"P_7": "TZnakowy512", "P_7Z": "TZnakowy512"}


# --- Quick tests on the items of an array -----------------------------------------------------------
# Spark interprets functions on items, but compiles the joining of values and a pattern on the text.  The mark before
# each value is no character of XML of any version.
MARK = "\0"


def _bare(pattern: str) -> str:
    return f"(?:{pattern.removeprefix('^').removesuffix('$')})"


def _any_day(low: str, high: str) -> str:
    """Days of the whole years of a range that ends on a first of January."""
    years = range(int(low[:4]) + (low[4:] != "-01-01"), int(high[:4]))
    day = r"(?:0[1-9]|1[0-2])-(?:0[1-9]|1\d|2[0-8])|(?:0[13-9]|1[0-2])-(?:29|30)|(?:0[13578]|1[02])-31"
    return f"(?:{'|'.join(map(str, years))})-(?:{day})"


# A pattern per facet that only allowed values match, though perhaps not all of them.
SURELY: dict[str, str] = {
    "TKwotowy": _bare(codes.PATTERN_AMOUNT), "TKwotowy2": _bare(codes.PATTERN_UNIT_PRICE), "TIlosci": _bare(codes.PATTERN_QUANTITY),
    "TProcentowy": r"(?:\d{1,2}(?:\.\d{1,6})?|100)",
    **{name: rf"[^\s\x00][^\x00]{{0,{longest - 1}}}" for name, longest in codes.TEXT_LENGTHS.items()},
    **{name: _any_day(*bounds) for name, bounds in codes.DATE_RANGES.items()},
    **{name: "(?:" + "|".join(map(re.escape, values)) + ")" for name, values in codes.CODE_LISTS.items()},
    "flag": "[12]", "choice": "1", "TNaturalny": r"[1-9]\d{0,17}", "TSwift": _bare(codes.PATTERN_SWIFT), "krs": "[0-9]{10}",
    "regon": "(?:[0-9]{9}|[0-9]{14})", "account_2": _bare(codes.PATTERN_ACCOUNT), "account_3": r"[^\x00]{10,34}",
}


def doubtful(array: str, facets: dict[str, str], variant: int, at: Document = WHOLE) -> Column:
    """False where the parts of all items are absent or surely pass; otherwise they have to be looked at one by one."""
    parts: dict[str, list[str]] = {}
    for element in facets:
        parts.setdefault(facet_of(element, facets, variant), []).append(at(f"{array}.{element}"))
    if any(facet not in SURELY for facet in parts):
        return F.lit(True)
    doubt = F.lit(False)
    for facet, columns in parts.items():
        values = F.concat_ws(MARK, F.lit(""), *columns)
        doubt = doubt | values.rlike(rf"\x00(?!{SURELY[facet]}(?:\x00|\z))")
    return doubt


def _has_gap(part: Column) -> Column:
    """True where an item lacks the part: a search among values and nulls that finds nothing has no result."""
    return F.array_contains(part, MARK).isNull()


def _facet(value: Column, facet: str, path: str | Column, severity: str = "error") -> Column:
    rule, message, check = FACETS[facet]
    return violation(~check(value), rule, path, message, value, severity)


def facet_of(element: str, facets: dict[str, str], variant: int) -> str:
    facet = LONG_NAMES_3.get(element, facets[element]) if variant == 3 else facets[element]
    return (VARIANT_3 if variant == 3 else VARIANT_2).get(facet, facet)


def _none() -> Column:
    return F.array().cast(f"array<{VIOLATION}>")


def _items_at(array: Column, facets: dict[str, str], variant: int, root: Column) -> Column:
    """Violations of the parts of the items of an array; ``root`` is its path as text."""

    def of(item: Column, i: Column) -> Column:
        path = lambda e: F.concat(root, F.lit("["), (i + 1).cast("string"), F.lit(f"]/{e}"))
        return gather(*[_facet(item[e], facet_of(e, facets, variant), path(e)) for e in facets])

    return F.coalesce(F.flatten(F.transform(array, of)), _none())


def _in_array(array: str, facets: dict[str, str], variant: int, at: Document = WHOLE) -> Column:
    """Violations of the parts of a repeated element, with their position in the path."""
    facets = at.present(array, facets)
    if not facets:
        return _none()
    found = _items_at(at(array), facets, variant, F.lit(array.replace(".", "/")))
    return F.when(at(array).isNotNull() & doubtful(array, facets, variant, at), found).otherwise(_none())


def _in_nested_array(array: str, inner: str, facets: dict[str, str], variant: int, at: Document = WHOLE) -> Column:
    """The same for a repeated element inside a repeated element."""

    def of(item: Column, i: Column) -> Column:
        root = F.concat(F.lit(array.replace(".", "/") + "["), (i + 1).cast("string"), F.lit(f"]/{inner}"))
        return _items_at(item[inner], facets, variant, root)

    if not at.has(f"{array}.{inner}"):
        return _none()
    return F.when(at(array).isNotNull(), F.coalesce(F.flatten(F.transform(at(array), of)), _none())).otherwise(_none())


# --- Document rules ------------------------------------------------------------------------------
def check_header(variant: int, at: Document = WHOLE) -> list[Column]:
    """System code, schema version, variant, namespace and creation time."""
    form = "Naglowek.KodFormularza"
    expected = {
        f"{form}._kodSystemowy": f"FA ({variant})", f"{form}._wersjaSchemy": codes.SCHEMA_VERSION,
        f"{form}._VALUE": codes.FORM_CODE, "Naglowek.WariantFormularza": str(variant), "_xmlns": codes.NAMESPACES[variant],
    }
    fixed = [
        violation(~at(c).eqNullSafe(F.lit(v)), "VAL-14", c.replace(".", "/"), f"value must be {v}", at(c))
        for c, v in expected.items()
    ]
    created = at("Naglowek.DataWytworzeniaFa")
    path = "Naglowek/DataWytworzeniaFa"
    return [*fixed, violation(~checks.check_header_time(created, variant), "VAL-06", path, "creation time is out of range", created)]


REQUIRED = [
    "Naglowek.DataWytworzeniaFa", "Podmiot1.DaneIdentyfikacyjne.NIP", "Podmiot1.DaneIdentyfikacyjne.Nazwa",
    "Podmiot1.Adres.KodKraju", "Podmiot1.Adres.AdresL1", "Podmiot2.DaneIdentyfikacyjne", "Fa.KodWaluty", "Fa.P_1", "Fa.P_2",
    "Fa.P_15", "Fa.Adnotacje.P_16", "Fa.Adnotacje.P_17", "Fa.Adnotacje.P_18", "Fa.Adnotacje.P_18A", "Fa.Adnotacje.Zwolnienie",
    "Fa.Adnotacje.NoweSrodkiTransportu", "Fa.Adnotacje.P_23", "Fa.Adnotacje.PMarzy", "Fa.RodzajFaktury",
]


# Mandatory parts of each occurrence of a repeated element, and of an optional element where it is there.
REQUIRED_IN_EACH = {
    "Fa.FaWiersz": ["NrWierszaFa"], "Fa.DaneFaKorygowanej": ["DataWystFaKorygowanej", "NrFaKorygowanej"],
    "Fa.Podmiot2K": ["DaneIdentyfikacyjne"], "Podmiot3": ["DaneIdentyfikacyjne", "Adres"], "Fa.Platnosc.RachunekBankowy": ["NrRB"],
    "Fa.Platnosc.RachunekBankowyFaktora": ["NrRB"], "Fa.Platnosc.ZaplataCzesciowa": ["KwotaZaplatyCzesciowej", "DataZaplatyCzesciowej"],
    "Fa.Zamowienie.ZamowienieWiersz": ["NrWierszaZam"],
    "Fa.Adnotacje.NoweSrodkiTransportu.NowySrodekTransportu": ["P_22A", "P_NrWierszaNST"],
}
# Those that hold elements and not text.
NESTED_PARTS = ("DaneIdentyfikacyjne", "Adres")
# Parts that are mandatory in variant 2 only.
REQUIRED_2 = {("Podmiot3", "Adres")}
REQUIRED_WITHIN = {
    "PodmiotUpowazniony": ["DaneIdentyfikacyjne", "Adres", "RolaPU"], "Fa.Zamowienie": ["WartoscZamowienia"],
    "Fa.Platnosc.Skonto": ["WarunkiSkonta", "WysokoscSkonta"],
}


def _each(element: str, of: Callable[[Column, Column], Column], at: Document = WHOLE) -> Column:
    """The violations that ``of`` finds in the occurrences of a repeated element, from the item and its position from 1 as text."""
    if not at.has(element):
        return _none()
    found = F.transform(at(element), lambda item, i: of(item, (i + 1).cast("string")))
    return F.when(at(element).isNotNull(), F.array_compact(found)).otherwise(_none())


def check_required_parts(at: Document = WHOLE) -> list[Column]:
    """Mandatory parts of optional elements."""
    return [
        violation(at(e).isNotNull() & at(f"{e}.{part}").isNull(), "VAL-17", f"{e}.{part}".replace(".", "/"), "element is missing")
        for e, parts in REQUIRED_WITHIN.items() for part in parts
    ]


def check_required_in_each(variant: int, at: Document = WHOLE) -> list[Column]:
    """Mandatory parts of repeated elements: an array per part, one violation per gap with the position in the path.

    A search among the values tells whether there is a gap; only then the items are looked at one by one.
    """

    def gaps(element: str, part: str) -> Column:
        path = lambda i: F.concat(F.lit(element.replace(".", "/") + "["), i, F.lit(f"]/{part}"))
        gap = lambda item: item[part].isNull() if at.has(f"{element}.{part}") else F.lit(True)
        found = _each(element, lambda item, i: violation(gap(item), "VAL-17", path(i), "element is missing"), at)
        if part in NESTED_PARTS or not at.has(f"{element}.{part}"):
            return found
        return F.when(_has_gap(at(f"{element}.{part}")), found).otherwise(_none())

    return [gaps(e, part) for e, parts in REQUIRED_IN_EACH.items() for part in parts if variant == 2 or (e, part) not in REQUIRED_2]


def check_required(at: Document = WHOLE) -> list[Column]:
    """Mandatory elements, and net and VAT of a taxed bucket together."""
    single = [violation(at(c).isNull(), "VAL-17", c.replace(".", "/"), "element is missing") for c in REQUIRED]
    pairs = [
        violation(
            ~checks.all_or_none(at(f"Fa.P_13_{b}"), at(f"Fa.P_14_{b}")), "VAL-17", f"Fa/P_13_{b}",
            "net and VAT of a bucket must come together",
        )
        for b in codes.TAXED_BUCKETS[:4]
    ]
    return single + pairs + check_required_parts(at)


def check_choices(at: Document = WHOLE) -> list[Column]:
    """Exactly one branch of each choice, or at most one where it is optional."""
    buyer, notes, pay, due = "Podmiot2.DaneIdentyfikacyjne", "Fa.Adnotacje", "Fa.Platnosc", "Fa.Rozliczenie"
    col = at
    exact = {
        "buyer id": (buyer, ["NIP", "NrVatUE", "NrID", "BrakID"]), "exemption": (f"{notes}.Zwolnienie", ["P_19", "P_19N"]),
        "new means of transport": (f"{notes}.NoweSrodkiTransportu", ["P_22", "P_22N"]), "margin": (f"{notes}.PMarzy", ["P_PMarzy", "P_PMarzyN"]),
    }
    optional = {
        "payment state": (pay, ["Zaplacono", "ZnacznikZaplatyCzesciowej"]), "payment form": (pay, ["FormaPlatnosci", "PlatnoscInna"]),
        "settlement": (due, ["DoZaplaty", "DoRozliczenia"]),
    }
    out = [
        violation(col(root).isNotNull() & ~checks.exactly_one(*[col(f"{root}.{b}") for b in branches]), "VAL-15",
                  root.replace(".", "/"), f"exactly one branch of {name} is needed")
        for name, (root, branches) in exact.items()
    ]
    out += [
        violation(~checks.at_most_one(*[col(f"{root}.{b}") for b in branches]), "VAL-15", root.replace(".", "/"),
                  f"at most one branch of {name} is allowed")
        for name, (root, branches) in optional.items()
    ]
    exemption, margin = f"{notes}.Zwolnienie", f"{notes}.PMarzy"
    out.append(violation(
        col(f"{exemption}.P_19").isNotNull() & ~checks.exactly_one(*[col(f"{exemption}.P_19{x}") for x in "ABC"]),
        "VAL-15", exemption.replace(".", "/"), "an exemption needs exactly one legal basis",
    ))
    out.append(violation(
        col(f"{margin}.P_PMarzy").isNotNull() & ~checks.exactly_one(*[col(f"{margin}.P_PMarzy_{x}") for x in ("2", "3_1", "3_2", "3_3")]),
        "VAL-15", margin.replace(".", "/"), "a margin procedure needs exactly one kind",
    ))
    vehicles = f"{notes}.NoweSrodkiTransportu"
    out.append(violation(
        col(f"{vehicles}.P_22").isNotNull() & ~Content.of(NEW_VEHICLES).fits(lambda part: col(f"{vehicles}.{part}")), "VAL-15", vehicles.replace(".", "/"),
        "new means of transport need all of their parts",
    ))
    return out


NEW_VEHICLES = sequence("P_22", "P_42_5", "NowySrodekTransportu")
_ID = "DaneIdentyfikacyjne"
_BUYER_ID = choice(
    f"{_ID}.NIP", sequence(f"{_ID}.KodUE", f"{_ID}.NrVatUE"), sequence(optional(f"{_ID}.KodKraju"), f"{_ID}.NrID"), f"{_ID}.BrakID"
)
# Choices inside each occurrence of a repeated element: element, name of the choice, its model.
CHOICES_IN_EACH = [
    ("Podmiot3", "id", choice(_BUYER_ID, f"{_ID}.IDWew")),
    ("Podmiot3", "role", choice("Rola", sequence("RolaInna", "OpisRoli"))),
    ("Fa.Podmiot2K", "id", _BUYER_ID),
    ("Fa.DaneFaKorygowanej", "clearance number", choice(sequence("NrKSeF", "NrKSeFFaKorygowanej"), "NrKSeFN")),
    ("Fa.FakturaZaliczkowa", "clearance number", choice(sequence("NrKSeFZN", "NrFaZaliczkowej"), "NrKSeFFaZaliczkowej")),
    ("Fa.WarunkiTransakcji.Transport", "transport kind", choice("RodzajTransportu", sequence("TransportInny", "OpisInnegoTransportu"))),
    ("Fa.WarunkiTransakcji.Transport", "cargo", choice("OpisLadunku", sequence("LadunekInny", "OpisInnegoLadunku"))),
    (
        "Fa.Adnotacje.NoweSrodkiTransportu.NowySrodekTransportu", "vehicle kind",
        choice(
            sequence("P_22B", optional(choice("P_22B1", "P_22B2", "P_22B3", "P_22B4")), optional("P_22BT")),
            sequence("P_22C", optional("P_22C1")), sequence("P_22D", optional("P_22D1")),
        ),
    ),
]
CHOICES_IN_EACH_3 = [
    ("Fa.Platnosc.ZaplataCzesciowa", "payment form", optional(choice("FormaPlatnosci", sequence("PlatnoscInna", "OpisPlatnosci")))),
]


def check_choices_in_each(variant: int, at: Document = WHOLE) -> list[Column]:
    """Choices inside repeated elements: an array per choice, one violation per occurrence whose parts don't fit.

    An occurrence without the element that holds the whole choice has a finding
    of its own and none here.
    """

    def misfits(element: str, name: str, content: Content) -> Column:
        path = lambda i: F.concat(F.lit(element.replace(".", "/") + "["), i, F.lit("]"))
        holders = {n.split(".")[0] for n in content.names if "." in n}

        def misfit(item: Column, i: Column) -> Column:
            bad = ~content.fits(item)
            for holder in holders:
                bad = bad & item[holder].isNotNull()
            return violation(bad, "VAL-15", path(i), f"exactly one branch of {name} is needed", content.mask(item))

        return _each(element, misfit, at)

    choices = CHOICES_IN_EACH + (CHOICES_IN_EACH_3 if variant == 3 else [])
    return [misfits(element, name, Content.of(model)) for element, name, model in choices]


# Most occurrences of a repeated element; None means unbounded in that variant.
LIMITS = {
    "Fa.FaWiersz": (10_000, 10_000), "Podmiot1.DaneKontaktowe": (3, 3), "Podmiot2.DaneKontaktowe": (3, 3), "Podmiot3": (100, 100),
    "Fa.WZ": (1000, 1000), "Fa.ZaliczkaCzesciowa": (31, 31), "Fa.DaneFaKorygowanej": (None, 50_000), "Fa.Podmiot2K": (101, 101),
    "Fa.DodatkowyOpis": (10_000, 10_000), "Fa.FakturaZaliczkowa": (100, 100), "Fa.Rozliczenie.Obciazenia": (100, 100),
    "Fa.Rozliczenie.Odliczenia": (100, 100), "Fa.Platnosc.TerminPlatnosci": (100, 100), "Fa.Platnosc.RachunekBankowy": (100, 100),
    "Fa.WarunkiTransakcji.Transport": (20, 20), "Fa.Zamowienie.ZamowienieWiersz": (10_000, 10_000),
    "Stopka.Informacje": (3, 3), "Stopka.Rejestry": (100, 100), "PodmiotUpowazniony.DaneKontaktowe": (3, 3),
    "Fa.Adnotacje.NoweSrodkiTransportu.NowySrodekTransportu": (10_000, 10_000), "Fa.Platnosc.ZaplataCzesciowa": (100, 100),
    "Fa.Platnosc.RachunekBankowyFaktora": (20, 20), "Fa.WarunkiTransakcji.Umowy": (100, 100),
    "Fa.WarunkiTransakcji.Zamowienia": (100, 100), "Fa.WarunkiTransakcji.NrPartiiTowaru": (1000, 1000),
}
# The same inside a repeated element: element, part, most occurrences.
NESTED_LIMITS = {
    ("Podmiot3", "DaneKontaktowe"): (3, 3), ("Fa.WarunkiTransakcji.Transport", "WysylkaPrzez"): (20, 20),
}


def check_cardinality_in_each(variant: int, nested_limits: dict | None = None, at: Document = WHOLE) -> list[Column]:
    """Occurrence limits inside repeated elements: an array per limit, one violation per occurrence above it.

    The path is that of the element; the message names the occurrence.
    """

    def above(element: str, part: str, most: int) -> Column:
        path = f"{element}/{part}".replace(".", "/")
        message = lambda i: F.concat(F.lit(f"more than {most} elements in occurrence "), i)
        return _each(element, lambda item, i: violation(F.size(item[part]) > most, "VAL-16", path, message(i), F.size(item[part])), at)

    limits = NESTED_LIMITS if nested_limits is None else nested_limits
    return [above(element, part, bounds[variant - 2]) for (element, part), bounds in limits.items()]


def check_cardinality(variant: int, limits: dict | None = None, at: Document = WHOLE) -> list[Column]:
    """Occurrence limits; other limits than those of the schema may be given."""
    out = []
    for element, bounds in (limits or LIMITS).items():
        most = bounds[variant - 2]
        if most is not None and at.has(element):
            size = F.size(at(element))
            out.append(violation(size > most, "VAL-16", element.replace(".", "/"), f"more than {most} elements", size))
    return out


def check_correction_block(at: Document = WHOLE) -> list[Column]:
    """Correction kinds should name the corrected invoice; the schema cannot enforce it."""
    is_correction = at("Fa.RodzajFaktury").isin("KOR", "KOR_ZAL", "KOR_ROZ")
    return [violation(
        is_correction & at("Fa.DaneFaKorygowanej").isNull(), "VAL-18", "Fa/DaneFaKorygowanej",
        "a correction should name the corrected invoice", at("Fa.RodzajFaktury"), "warning",
    )]


def check_fa3_extras(at: Document = WHOLE) -> list[Column]:
    """Flags, payment id and link, and attachment tables of variant 3."""
    out = []
    for flag in ("JST", "GV"):
        value = at(f"Podmiot2.{flag}")
        out.append(violation(value.isNull() | ~checks.check_flag(value), "VAL-19", f"Podmiot2/{flag}", "flag must be 1 or 2", value))
    link, payment_id = at("Fa.Platnosc.LinkDoPlatnosci"), at("Fa.Platnosc.IPKSeF")
    out.append(violation(~checks.check_payment_id(payment_id), "VAL-19", "Fa/Platnosc/IPKSeF", "payment id is malformed", payment_id))
    out.append(violation(
        ~checks.check_payment_link(link, payment_id), "VAL-19", "Fa/Platnosc/LinkDoPlatnosci", "payment link does not carry the payment id", link
    ))
    return out


MAX_TABLE_COLUMNS = 20


def check_attachment_tables(at: Document = WHOLE) -> Column:
    """Width of every table of the attachment and type of every column, each with its place."""

    def of_table(table: Column, path: Column) -> Column:
        columns = table["TNaglowek"]["Kol"]
        width = F.size(columns)
        wide = violation(width > MAX_TABLE_COLUMNS, "VAL-19", path, f"a table has more than {MAX_TABLE_COLUMNS} columns", width)

        def untyped(column: Column, k: Column) -> Column:
            kind = column["NKom"]["_Typ"]
            place = F.concat(path, F.lit("/TNaglowek/Kol["), (k + 1).cast("string"), F.lit("]"))
            return violation(~F.coalesce(kind.isin(codes.CODE_LISTS["column_type"]), F.lit(False)), "VAL-19", place, "a table column has no known type", kind)

        return F.concat(gather(wide), F.coalesce(F.array_compact(F.transform(columns, untyped)), _none()))

    def of_block(block: Column, i: Column) -> Column:
        path = lambda j: F.concat(F.lit("Zalacznik/BlokDanych["), (i + 1).cast("string"), F.lit("]/Tabela["), (j + 1).cast("string"), F.lit("]"))
        return F.coalesce(F.flatten(F.transform(block["Tabela"], lambda table, j: of_table(table, path(j)))), _none())

    if not at.has("Zalacznik.BlokDanych"):
        return _none()
    return F.coalesce(F.flatten(F.transform(at("Zalacznik.BlokDanych"), of_block)), _none())


def check_party_ids(at: Document = WHOLE) -> list[Column]:
    """Tax ids of seller and buyer; generated test ids may break the pattern, hence a warning."""
    out = []
    for party in ("Podmiot1", "Podmiot2"):
        nip = at(f"{party}.DaneIdentyfikacyjne.NIP")
        path = f"{party}/DaneIdentyfikacyjne/NIP"
        out.append(violation(nip.isNotNull() & ~ids.check_nip(nip), "VAL-10", path, "tax id is malformed", nip, "warning"))
    vat = at("Podmiot2.DaneIdentyfikacyjne.NrVatUE")
    out.append(_facet(vat, "TNrVatUE", "Podmiot2/DaneIdentyfikacyjne/NrVatUE"))
    out.append(_facet(at("Podmiot2.DaneIdentyfikacyjne.KodUE"), "eu_country", "Podmiot2/DaneIdentyfikacyjne/KodUE"))
    return out


def check_texts(at: Document = WHOLE) -> list[Column]:
    paths = {
        "Podmiot1.DaneIdentyfikacyjne.Nazwa": "TZnakowy512", "Podmiot2.DaneIdentyfikacyjne.Nazwa": "TZnakowy512",
        "Podmiot1.Adres.AdresL1": "TZnakowy512", "Podmiot2.Adres.AdresL1": "TZnakowy512", "Podmiot1.Adres.GLN": "gln",
        "Podmiot2.NrKlienta": "TZnakowy", "Podmiot2.IDNabywcy": "buyer_link", "Naglowek.SystemInfo": "TZnakowy",
        "Podmiot1.StatusInfoPodatnika": "taxpayer_state", "PodmiotUpowazniony.RolaPU": "authorised_role",
    }
    return [_facet(at(p), f, p.replace(".", "/")) for p, f in paths.items()]


def check_flags(at: Document = WHOLE) -> list[Column]:
    two = [_facet(at(f"Fa.Adnotacje.{c}"), "flag", f"Fa/Adnotacje/{c}") for c in ("P_16", "P_17", "P_18", "P_18A", "P_23")]
    one = ["Zwolnienie.P_19", "Zwolnienie.P_19N", "NoweSrodkiTransportu.P_22", "NoweSrodkiTransportu.P_22N", "PMarzy.P_PMarzy", "PMarzy.P_PMarzyN"]
    return two + [_facet(at(f"Fa.Adnotacje.{c}"), "choice", f"Fa/Adnotacje/{c}".replace(".", "/")) for c in one]


def check_payment(variant: int, at: Document = WHOLE) -> list[Column]:
    """Payment form, accounts, codes and dates of the payment block."""
    form = _facet(at("Fa.Platnosc.FormaPlatnosci"), "payment_form", "Fa/Platnosc/FormaPlatnosci")
    paid = _facet(at("Fa.Platnosc.DataZaplaty"), "TData", "Fa/Platnosc/DataZaplaty")
    return [form, paid]


def _rules(variant: int, at: Document) -> Column:
    """The violations of a document and nulls for the rules that it meets, in rule order."""
    body = [_facet(at(f"Fa.{e}"), facet_of(e, BODY_FACETS, variant), f"Fa/{e}") for e in BODY_FACETS]
    extras = check_fa3_extras(at) if variant == 3 else []
    return F.concat(
        F.array(*check_header(variant, at), *check_required(at)), *check_required_in_each(variant, at),
        F.array(*check_party_ids(at), *check_texts(at), *body, *check_flags(at), *check_choices(at)), *check_choices_in_each(variant, at),
        *check_cardinality_in_each(variant, at=at),
        F.array(*check_cardinality(variant, at=at), *check_correction_block(at), *check_payment(variant, at), *extras),
        _in_array("Fa.FaWiersz", LINE_FACETS, variant, at), _in_array("Fa.Zamowienie.ZamowienieWiersz", ORDER_FACETS, variant, at),
        *[_in_array(array, facets, variant, at) for array, facets in ARRAY_FACETS.items()],
        *[_in_nested_array(array, inner, facets, variant, at) for (array, inner), facets in NESTED_FACETS.items()],
        *([check_attachment_tables(at)] if variant == 3 else []),
    )


def validate_fa(df: DataFrame, variant: int, plain: str | None = None) -> DataFrame:
    """All document rules of a structured invoice: adds ``violations``.

    The columns of ``df`` are those of the parsed document, next to any keys.  ``plain`` names the struct that holds the
    documents with plain elements only, as ``parse_fa_xml`` gives it; all rules apply to them, those on other elements
    with the element missing.
    """
    rules = _rules(variant, WHOLE)
    if plain is not None:
        rules = F.when(F.col(plain).isNotNull(), _rules(variant, Document(plain, df.schema[plain].dataType))).otherwise(rules)
    # Dropping nulls is a function on items, which Spark interprets with all that is below it.  The rules are compiled
    # in a projection of their own; it stays one because its result is read twice.
    found = df.withColumn("_found", rules)
    return found.withColumn("violations", F.when(F.size("_found") > 0, F.array_compact("_found")).otherwise(_none())).drop("_found")


# --- Amount rules on tables ----------------------------------------------------------------------
def check_amount_signs(net: Column, tax: Column, gross: Column) -> list[Column]:
    """Basic invoices: net above zero, VAT not negative, gross above zero, not all zero."""
    everything = (net == 0) & (tax == 0) & (gross == 0)
    return [
        violation(net <= 0, "VAL-21", "net", "net must be above zero", net),
        violation(tax < 0, "VAL-21", "tax", "VAT must not be negative", tax),
        violation(gross <= 0, "VAL-21", "gross", "gross must be above zero", gross),
        violation(everything, "VAL-21", "amounts", "all amounts are zero"),
    ]


def check_amount_sum(net: Column, tax: Column, gross: Column) -> Column:
    return violation(net + tax != gross, "VAL-22", "gross", "net and VAT do not add up to gross", gross)


def check_line_amount(lines: DataFrame) -> DataFrame:
    """Declared line net against quantity times discounted unit price, in grosze."""
    expected = F.col("quantity") * (F.col("unit_net_gr") - F.coalesce("unit_discount_gr", F.lit(0)))
    return lines.withColumn("expected_gr", expected).withColumn("is_valid", F.col("declared_net_gr") == F.col("expected_gr"))


def check_header_vs_lines(headers: DataFrame, lines: DataFrame, tolerance_gr: int = 0) -> DataFrame:
    """Declared bucket net and VAT against the lines.

    ``headers``: ``invoice_id, bucket, net_gr, tax_gr``.  VAT of a bucket is the
    rounded net per rate times the rate; net is the plain sum.
    """
    per_rate = lines.withColumn("bucket", bucket_of(F.col("vat_code"))).groupBy("invoice_id", "bucket", "rate").agg(
        F.sum("net_gr").alias("net_gr")
    )
    expected = per_rate.groupBy("invoice_id", "bucket").agg(
        F.sum("net_gr").alias("expected_net_gr"), F.sum(tax_grosze(F.col("net_gr"), F.col("rate"))).alias("expected_tax_gr")
    )
    joined = headers.join(expected, ["invoice_id", "bucket"], "full_outer").na.fill(
        0, ["net_gr", "tax_gr", "expected_net_gr", "expected_tax_gr"]
    )
    net_diff, tax_diff = F.col("net_gr") - F.col("expected_net_gr"), F.col("tax_gr") - F.col("expected_tax_gr")
    return joined.select(
        "invoice_id", "bucket", from_grosze(net_diff).alias("net_diff"), from_grosze(tax_diff).alias("tax_diff"),
        ((F.abs(net_diff) <= tolerance_gr) & (F.abs(tax_diff) <= tolerance_gr)).alias("is_valid"),
    )


def check_line_numbers(lines: DataFrame, number: str = "line_no") -> DataFrame:
    """Lines numbered 1..n without gaps or repeats."""
    counts = lines.groupBy("invoice_id").agg(
        F.count(F.lit(1)).alias("line_count"), F.min(number).alias("lowest"), F.max(number).alias("highest"),
        F.count_distinct(number).alias("distinct_numbers"),
    )
    good = (F.col("lowest") == 1) & (F.col("highest") == F.col("line_count")) & (F.col("distinct_numbers") == F.col("line_count"))
    return counts.withColumn("is_valid", good)


# Gross amount in PLN above which split payment is due for annex 15 goods.
SPLIT_PAYMENT_GR = 1_500_000


def check_split_payment(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """The split payment flag is expected above the limit when a line is marked for annex 15.

    ``invoices``: ``invoice_id, gross_pln_gr, split_flag``; ``lines``: ``invoice_id, annex15``.
    """
    marked = lines.groupBy("invoice_id").agg(F.bool_or("annex15").alias("has_annex15"))
    joined = invoices.join(marked, "invoice_id", "left").withColumn("has_annex15", F.coalesce("has_annex15", F.lit(False)))
    needed = F.col("has_annex15") & (F.col("gross_pln_gr") > SPLIT_PAYMENT_GR)
    return joined.withColumn("is_needed", needed).withColumn("is_valid", ~needed | (F.col("split_flag") == "1"))


def check_order_value(orders: DataFrame, order_lines: DataFrame) -> DataFrame:
    """Declared order value against the sum of net and VAT of the order lines."""
    sums = order_lines.groupBy("invoice_id").agg(F.sum(F.col("net_gr") + F.col("tax_gr")).alias("expected_gr"))
    joined = orders.join(sums, "invoice_id", "left").na.fill(0, ["expected_gr"])
    return joined.withColumn("is_valid", F.col("value_gr") == F.col("expected_gr"))


def check_transport_times(starts: Column, ends: Column) -> Column:
    """Start not after end, both in the allowed range."""
    low, high = (F.lit(x).cast("timestamp") for x in codes.TIME_RANGE)
    inside = lambda t: t.isNull() | t.between(low, high)
    return inside(starts) & inside(ends) & F.coalesce(starts <= ends, F.lit(True))


# --- Results -------------------------------------------------------------------------------------
# Catalogue entry of each rule; all schema rules share one.
ERROR_OF_RULE = {
    "VAL-10": "issuer", "VAL-27s": "session_duplicate", "VAL-27p": "package_duplicate",
    "PKG-size": "part_size", "PKG-hash": "part_hash", "file_size": "file_size", "file_hash": "file_hash",
}


def error_rules(spark: SparkSession) -> DataFrame:
    """Fixed table of rule id, catalogue code and text."""
    rules = [f"VAL-{i:02d}" for i in range(1, 34)] + ["VAL-27s", "VAL-27p", "PKG-size", "PKG-hash", "file_size", "file_hash"]
    entries = [(r, *codes.RULE_ERRORS[ERROR_OF_RULE.get(r, "schema")]) for r in rules]
    values = ", ".join(f"('{r}', {code}, '{text}')" for r, code, text in entries)
    return spark.sql(f"SELECT * FROM VALUES {values} AS rules(rule_id, error_code, error_text)")


def attach_error_code(violations: DataFrame) -> DataFrame:
    return violations.join(F.broadcast(error_rules(violations.sparkSession)), "rule_id", "left")


def summarise_validation(documents: DataFrame, violations: str = "violations") -> DataFrame:
    """``is_valid`` and all messages of a document, one per line; warnings do not fail it."""
    errors = F.exists(violations, lambda v: v["severity"] == "error")
    text = F.array_join(F.transform(violations, lambda v: F.concat(v["path"], F.lit(": "), v["message"])), "\n")
    return documents.withColumn("is_valid", ~errors).withColumn("messages", text)


