"""Explicit schemas of the source formats.

Inference would drop leading zeros of tax ids and turn amounts into doubles, so
raw values are strings and are converted after validation.  Attributes carry the
prefix ``_`` and element text of elements with attributes is ``_VALUE``.
"""

from __future__ import annotations

from pyspark.sql import types as T


def struct(*fields: str | tuple[str, T.DataType]) -> T.StructType:
    """Fields in order: ``'a b c'`` gives strings, ``(name, type)`` gives anything else."""
    out = []
    for field in fields:
        if isinstance(field, str):
            out += [T.StructField(name, T.StringType()) for name in field.split()]
        else:
            out.append(T.StructField(field[0], field[1]))
    return T.StructType(out)


def many(element: T.DataType) -> T.ArrayType:
    return T.ArrayType(element)


STRINGS = many(T.StringType())


def narrow(schema: T.DataType, paths: list[str]) -> T.DataType:
    """The schema with the fields at dotted paths only, all below a path included; arrays are passed through.

    A parser does work for every field of a schema and for every object, so who
    reads some fields of a document parses those.
    """
    if isinstance(schema, T.ArrayType):
        return many(narrow(schema.elementType, paths))
    below: dict[str, list[str]] = {}
    for path in paths:
        name, _, rest = path.partition(".")
        below.setdefault(name, []).append(rest)
    missing = set(below) - set(schema.names)
    if missing:
        raise ValueError(f"no fields {sorted(missing)}")
    kept = [(f.name, f.dataType if "" in below[f.name] else narrow(f.dataType, below[f.name])) for f in schema.fields if f.name in below]
    return struct(*kept)


# The field that takes the elements which a narrower schema doesn't name; no element or attribute is called like it.
OTHERS = "other elements"


def with_others(schema: T.DataType, names: set[str]) -> T.DataType:
    """The schema with the elements of the given names only, at every depth, and a field for all others; attributes stay.

    Where that field is null throughout, the document has none of the elements left out.
    """
    if isinstance(schema, T.ArrayType):
        return many(with_others(schema.elementType, names))
    if not isinstance(schema, T.StructType):
        return schema
    kept = [(f.name, with_others(f.dataType, names)) for f in schema.fields if f.name in names or f.name.startswith("_")]
    return struct(*kept, (OTHERS, STRINGS))


def others_within(schema: T.StructType, path: str) -> list[tuple[str, bool]]:
    """Paths of those fields below a column, and whether they are in the items of an array; an array inside an array is not looked for."""
    found = [(f"{path}.`{OTHERS}`", False)] if OTHERS in schema.names else []
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            found += others_within(f.dataType, f"{path}.{f.name}")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            inside = others_within(f.dataType.elementType, f"{path}.{f.name}")
            if any(in_items for _, in_items in inside) or len(inside) > 1:
                raise ValueError(f"structs inside the items of {f.name}")
            found += [(p, True) for p, _ in inside]
    return found


# --- Invoice record (JSON document, one object per invoice) ----------------------------
POSITION_FIELDS = (
    "name price_net quantity total_price_gross total_price_net additional_info quantity_unit tax "
    "price_gross price_tax total_price_tax discount discount_percent tax2 code"
)
HEADER_FIELDS = (
    "number place sell_date payment_type price_net price_gross currency description "
    "seller_name seller_tax_no seller_street seller_post_code seller_city seller_country seller_email seller_phone "
    "seller_fax seller_www seller_person seller_bank seller_bank_account "
    "buyer_name buyer_tax_no buyer_post_code buyer_city buyer_street buyer_country buyer_email buyer_www buyer_fax "
    "buyer_phone kind payment_to paid seller_bank_account_id lang issue_date price_tax oid discount"
)
TRAILING_FIELDS = (
    "description_long buyer_tax_no_kind seller_tax_no_kind description_footer sell_date_kind payment_to_kind "
    "exchange_currency discount_kind"
)
EXCHANGE_FIELDS = "exchange_kind exchange_rate delivery_address buyer_person buyer_bank_account buyer_bank exchange_note"
LAST_FIELDS = (
    "exchange_currency_rate exchange_date split_payment buyer_mobile_phone seller_bdo_no e_receipt_view_url"
)
BOOLEAN_FIELDS = ("show_discount", "income", "buyer_company")

POSITION = struct(POSITION_FIELDS)
INVOICE_JSON = struct(
    HEADER_FIELDS, ("show_discount", T.BooleanType()), TRAILING_FIELDS, ("income", T.BooleanType()), EXCHANGE_FIELDS,
    ("buyer_company", T.BooleanType()), LAST_FIELDS, ("positions", many(POSITION)),
)


# --- Accounting export: the same record with hyphens, type and nil attributes --------------
def _hyphenated(names: str) -> list[tuple[str, T.DataType]]:
    value = struct("_VALUE _type _nil")
    return [(name.replace("_", "-"), value) for name in names.split()]


_FLAGS = " ".join(BOOLEAN_FIELDS)
ACCOUNTING_XML = struct(
    *_hyphenated(f"{HEADER_FIELDS} {TRAILING_FIELDS} {EXCHANGE_FIELDS} {LAST_FIELDS} {_FLAGS}"),
    ("positions", struct("_type", ("position", many(struct("_type", *_hyphenated(POSITION_FIELDS)))))),
)

# --- UBL 2.1 -----------------------------------------------------------------------------------
_MONEY = struct("_VALUE _currencyID")
_PARTY = struct((
    "Party",
    struct(
        ("EndpointID", struct("_VALUE _schemeID")),
        ("PartyIdentification", struct("ID")),
        ("PartyName", struct("Name")),
        ("PostalAddress", struct("StreetName CityName PostalZone", ("Country", struct("IdentificationCode")))),
        ("PartyTaxScheme", struct("CompanyID", ("TaxScheme", struct("ID")))),
        ("PartyLegalEntity", struct("RegistrationName CompanyID")),
        ("Contact", struct("Name")),
    ),
))
UBL_XML = struct(
    "CustomizationID ProfileID ID IssueDate DueDate InvoiceTypeCode DocumentCurrencyCode",
    ("AccountingSupplierParty", _PARTY),
    ("AccountingCustomerParty", _PARTY),
    ("TaxTotal", struct(
        ("TaxAmount", _MONEY),
        ("TaxSubtotal", many(struct(
            ("TaxableAmount", _MONEY), ("TaxAmount", _MONEY),
            ("TaxCategory", struct("ID Percent", ("TaxScheme", struct("ID")))),
        ))),
    )),
    ("LegalMonetaryTotal", struct(
        ("LineExtensionAmount", _MONEY), ("TaxExclusiveAmount", _MONEY), ("TaxInclusiveAmount", _MONEY),
        ("PrepaidAmount", _MONEY), ("PayableAmount", _MONEY),
    )),
    ("InvoiceLine", many(struct(
        "ID",
        ("InvoicedQuantity", struct("_VALUE _unitCode")),
        ("LineExtensionAmount", _MONEY),
        ("Item", struct("Name", ("ClassifiedTaxCategory", struct("ID Percent")))),
        ("Price", struct("PriceAmount")),
    ))),
)

# --- Structured invoice, variants 2 and 3 ----------------------------------------------------------
_ADDRESS = struct("KodKraju AdresL1 AdresL2 GLN")
_CONTACTS = many(struct("Email Telefon"))
_SELLER_ID = struct("NIP Nazwa")
_BUYER_ID = struct("NIP KodUE NrVatUE KodKraju NrID BrakID Nazwa")
_THIRD_ID = struct("NIP IDWew KodUE NrVatUE KodKraju NrID BrakID Nazwa")
_ACCOUNT = many(struct("NrRB SWIFT RachunekWlasnyBanku NazwaBanku OpisRachunku"))
_AMOUNT_AND_REASON = many(struct("Kwota Powod"))
_BUCKET_FIELDS = (
    "P_13_1 P_14_1 P_14_1W P_13_2 P_14_2 P_14_2W P_13_3 P_14_3 P_14_3W P_13_4 P_14_4 P_14_4W P_13_5 P_14_5 "
    "P_13_6_1 P_13_6_2 P_13_6_3 P_13_7 P_13_8 P_13_9 P_13_10 P_13_11 P_15 KursWalutyZ"
)
_VEHICLE = struct(
    "P_22A P_NrWierszaNST P_22BMK P_22BMD P_22BK P_22BNR P_22BRP P_22B P_22B1 P_22B2 P_22B3 P_22B4 P_22BT "
    "P_22C P_22C1 P_22D P_22D1"
)
LINE_FIELDS = (
    "NrWierszaFa UU_ID P_6A P_7 Indeks GTIN PKWiU CN PKOB P_8A P_8B P_9A P_9B P_10 P_11 P_11A P_11Vat P_12 P_12_XII "
    "P_12_Zal_15 KwotaAkcyzy GTU Procedura KursWaluty StanPrzed"
)
ORDER_LINE_FIELDS = (
    "NrWierszaZam UU_IDZ P_7Z IndeksZ GTINZ PKWiUZ CNZ PKOBZ P_8AZ P_8BZ P_9AZ P_11NettoZ P_11VatZ P_12Z P_12Z_XII "
    "P_12Z_Zal_15 GTUZ ProceduraZ KwotaAkcyzyZ StanPrzedZ"
)
_TRANSPORT = struct(
    "RodzajTransportu TransportInny OpisInnegoTransportu",
    ("Przewoznik", struct(("DaneIdentyfikacyjne", _BUYER_ID), ("AdresPrzewoznika", _ADDRESS))),
    "NrZleceniaTransportu OpisLadunku LadunekInny OpisInnegoLadunku JednostkaOpakowania "
    "DataGodzRozpTransportu DataGodzZakTransportu",
    ("WysylkaZ", _ADDRESS), ("WysylkaPrzez", many(_ADDRESS)), ("WysylkaDo", _ADDRESS),
)
_ANNOTATIONS = struct(
    "P_16 P_17 P_18 P_18A",
    ("Zwolnienie", struct("P_19 P_19A P_19B P_19C P_19N")),
    ("NoweSrodkiTransportu", struct("P_22 P_42_5", ("NowySrodekTransportu", many(_VEHICLE)), "P_22N")),
    "P_23",
    ("PMarzy", struct("P_PMarzy P_PMarzy_2 P_PMarzy_3_1 P_PMarzy_3_2 P_PMarzy_3_3 P_PMarzyN")),
)


def _term(variant: int) -> T.DataType:
    return T.StringType() if variant == 2 else struct("Ilosc Jednostka ZdarzeniePoczatkowe")


def _payment(variant: int) -> T.StructType:
    part = "KwotaZaplatyCzesciowej DataZaplatyCzesciowej"
    if variant == 3:
        part += " FormaPlatnosci PlatnoscInna OpisPlatnosci"
    fields: list = [
        "Zaplacono DataZaplaty ZnacznikZaplatyCzesciowej",
        ("ZaplataCzesciowa", many(struct(part))),
        ("TerminPlatnosci", many(struct("Termin", ("TerminOpis", _term(variant))))),
        "FormaPlatnosci PlatnoscInna OpisPlatnosci",
        ("RachunekBankowy", _ACCOUNT),
        ("RachunekBankowyFaktora", _ACCOUNT),
        ("Skonto", struct("WarunkiSkonta WysokoscSkonta")),
    ]
    return struct(*fields, "LinkDoPlatnosci IPKSeF") if variant == 3 else struct(*fields)


ATTACHMENT = struct((
    "BlokDanych",
    many(struct(
        "ZNaglowek",
        ("MetaDane", many(struct("ZKlucz ZWartosc"))),
        ("Tekst", struct(("Akapit", STRINGS))),
        ("Tabela", many(struct(
            ("TMetaDane", many(struct("TKlucz TWartosc"))),
            "Opis",
            ("TNaglowek", struct(("Kol", many(struct(("NKom", struct("_VALUE _Typ"))))))),
            ("Wiersz", many(struct(("WKom", STRINGS)))),
            ("Suma", struct(("SKom", STRINGS))),
        ))),
    )),
))


# Names of the elements that any invoice has or may well have: header, parties, amounts, flags and lines.
PLAIN_ELEMENTS = set((
    "Faktura Naglowek KodFormularza WariantFormularza DataWytworzeniaFa Podmiot1 Podmiot2 DaneIdentyfikacyjne NIP Nazwa Adres KodKraju AdresL1 "
    "JST GV Fa KodWaluty P_1 P_2 P_13_1 P_14_1 P_13_2 P_14_2 P_13_3 P_14_3 P_13_4 P_14_4 P_13_6_1 P_13_7 P_15 Adnotacje P_16 P_17 P_18 P_18A "
    "Zwolnienie P_19N NoweSrodkiTransportu P_22N P_23 PMarzy P_PMarzyN RodzajFaktury FaWiersz NrWierszaFa P_7 P_8A P_8B P_9A P_11 P_12"
).split())


# Elements of a plain invoice: header, parties, amounts, flags and lines, without the blocks that some invoices have.
PLAIN_ELEMENTS = set((
    "Naglowek KodFormularza WariantFormularza DataWytworzeniaFa Podmiot1 Podmiot2 DaneIdentyfikacyjne NIP Nazwa Adres KodKraju AdresL1 JST GV "
    "Fa KodWaluty P_1 P_2 P_13_1 P_14_1 P_13_2 P_14_2 P_13_3 P_14_3 P_13_4 P_14_4 P_13_6_1 P_13_7 P_15 Adnotacje P_16 P_17 P_18 P_18A "
    "Zwolnienie P_19N NoweSrodkiTransportu P_22N P_23 PMarzy P_PMarzyN RodzajFaktury FaWiersz NrWierszaFa P_7 P_8A P_8B P_9A P_11 P_12"
).split())


def fa_xml(variant: int) -> T.StructType:
    """Schema of the structured invoice; element order is the order of the document."""
    if variant not in (2, 3):
        raise ValueError(f"unknown schema variant {variant}")
    buyer: list = [
        "NrEORI", ("DaneIdentyfikacyjne", _BUYER_ID), ("Adres", _ADDRESS), ("AdresKoresp", _ADDRESS),
        ("DaneKontaktowe", _CONTACTS), "NrKlienta IDNabywcy",
    ]
    body = struct(
        "KodWaluty P_1 P_1M P_2", ("WZ", STRINGS), "P_6", ("OkresFa", struct("P_6_Od P_6_Do")),
        _BUCKET_FIELDS,
        ("Adnotacje", _ANNOTATIONS),
        "RodzajFaktury PrzyczynaKorekty TypKorekty",
        ("DaneFaKorygowanej", many(struct("DataWystFaKorygowanej NrFaKorygowanej NrKSeF NrKSeFFaKorygowanej NrKSeFN"))),
        "OkresFaKorygowanej NrFaKorygowany",
        ("Podmiot1K", struct("PrefiksPodatnika", ("DaneIdentyfikacyjne", _SELLER_ID), ("Adres", _ADDRESS))),
        ("Podmiot2K", many(struct(("DaneIdentyfikacyjne", _BUYER_ID), ("Adres", _ADDRESS), "IDNabywcy"))),
        "P_15ZK KursWalutyZK",
        ("ZaliczkaCzesciowa", many(struct("P_6Z P_15Z KursWalutyZW"))),
        "FP TP",
        ("DodatkowyOpis", many(struct("NrWiersza Klucz Wartosc"))),
        ("FakturaZaliczkowa", many(struct("NrKSeFZN NrFaZaliczkowej NrKSeFFaZaliczkowej"))),
        "ZwrotAkcyzy",
        ("FaWiersz", many(struct(LINE_FIELDS))),
        ("Rozliczenie", struct(
            ("Obciazenia", _AMOUNT_AND_REASON), "SumaObciazen", ("Odliczenia", _AMOUNT_AND_REASON),
            "SumaOdliczen DoZaplaty DoRozliczenia",
        )),
        ("Platnosc", _payment(variant)),
        ("WarunkiTransakcji", struct(
            ("Umowy", many(struct("DataUmowy NrUmowy"))), ("Zamowienia", many(struct("DataZamowienia NrZamowienia"))),
            ("NrPartiiTowaru", STRINGS), "WarunkiDostawy KursUmowny WalutaUmowna",
            ("Transport", many(_TRANSPORT)), "PodmiotPosredniczacy",
        )),
        ("Zamowienie", struct("WartoscZamowienia", ("ZamowienieWiersz", many(struct(ORDER_LINE_FIELDS))))),
    )
    document: list = [
        "_xmlns",
        ("Naglowek", struct(
            ("KodFormularza", struct("_VALUE _kodSystemowy _wersjaSchemy")),
            "WariantFormularza DataWytworzeniaFa SystemInfo",
        )),
        ("Podmiot1", struct(
            "PrefiksPodatnika NrEORI", ("DaneIdentyfikacyjne", _SELLER_ID), ("Adres", _ADDRESS),
            ("AdresKoresp", _ADDRESS), ("DaneKontaktowe", _CONTACTS), "StatusInfoPodatnika",
        )),
        ("Podmiot2", struct(*buyer, "JST GV") if variant == 3 else struct(*buyer)),
        ("Podmiot3", many(struct(
            "IDNabywcy NrEORI", ("DaneIdentyfikacyjne", _THIRD_ID), ("Adres", _ADDRESS), ("AdresKoresp", _ADDRESS),
            ("DaneKontaktowe", _CONTACTS), "Rola RolaInna OpisRoli Udzial NrKlienta",
        ))),
        ("PodmiotUpowazniony", struct(
            "NrEORI", ("DaneIdentyfikacyjne", _SELLER_ID), ("Adres", _ADDRESS), ("AdresKoresp", _ADDRESS),
            ("DaneKontaktowe", many(struct("EmailPU TelefonPU"))), "RolaPU",
        )),
        ("Fa", body),
        ("Stopka", struct(
            ("Informacje", many(struct("StopkaFaktury"))), ("Rejestry", many(struct("PelnaNazwa KRS REGON BDO"))),
        )),
    ]
    return struct(*document, ("Zalacznik", ATTACHMENT)) if variant == 3 else struct(*document)


# --- Extraction record --------------------------------------------------------------------------------
EXTRACTION_FIELDS = [
    "seller_name", "seller_tax_no", "seller_street", "seller_country", "buyer_name", "buyer_tax_no", "buyer_street",
    "buyer_post_code", "buyer_city", "buyer_country", "currency", "issue_date", "number", "price_net", "price_tax",
    "price_gross",
]
EXTRACTION = struct(" ".join(EXTRACTION_FIELDS))
REQUIRED_FIELDS = [
    "seller_name", "seller_tax_no", "buyer_name", "buyer_tax_no", "number", "issue_date", "price_net", "price_tax",
    "price_gross",
]
