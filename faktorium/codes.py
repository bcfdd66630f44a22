"""Fixed values of the public invoice schema, VAT rules and labels.

Everything in this module is data that results depend on: code lists, labels,
patterns and constants, stated as they are.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_map(values: dict[str, str]) -> Column:
    """A constant lookup map; missing keys give null through ``element_at``."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


# --- VAT -------------------------------------------------------------------
TAX_RATES = [23, 22, 8, 7, 5, 4, 3]

# Summary bucket of each VAT code (both schema variants).
VAT_BUCKETS = {
    "23": "1", "22": "1", "8": "2", "7": "2", "5": "3", "4": "4", "3": "4",
    "0": "6_1", "0 KR": "6_1", "0 WDT": "6_2", "0 EX": "6_3",
    "zw": "7", "np": "8", "np I": "8", "np II": "9", "oo": "10",
}
BUCKETS = ["1", "2", "3", "4", "5", "6_1", "6_2", "6_3", "7", "8", "9", "10", "11"]
TAXED_BUCKETS = ["1", "2", "3", "4", "5"]

# UBL tax category of each VAT code.
UBL_CATEGORIES = {
    "23": "S", "22": "S", "8": "S", "7": "S", "5": "S", "4": "S", "3": "S",
    "0": "Z", "0 KR": "Z", "0 WDT": "K", "0 EX": "G",
    "zw": "E", "np": "O", "np I": "O", "np II": "O", "oo": "AE",
}

# --- Schema variants ---------------------------------------------------------
NAMESPACES = {
    2: "http://crd.gov.pl/wzor/2023/06/29/12648/",
    3: "http://crd.gov.pl/wzor/2025/06/25/13775/",
}
SCHEMA_VERSION = "1-0E"
FORM_CODE = "FA"
HEADER_TIME_FROM = {2: "2022-01-01 00:00:00", 3: "2025-09-01 00:00:00"}
HEADER_TIME_TO = "2050-01-01 23:59:59"

# --- Code lists ----------------------------------------------------------------
EU_COUNTRIES = "AT BE BG CY CZ DK EE FI FR DE EL HR HU IE IT LV LT LU MT NL PL PT RO SK SI ES SE XI".split()

CURRENCIES = """
AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BOV BRL BSD BTN BWP BYN BZD
CAD CDF CHE CHF CHW CLF CLP CNY COP COU CRC CUC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP
GEL GGP GHS GIP GMD GNF GTQ GYD HKD HNL HRK HTG HUF IDR ILS IMP INR IQD IRR ISK JEP JMD JOD JPY KES KGS
KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MXV
MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK
SGD SHP SLL SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD USN UYI UYU UYW
UZS VES VND VUV WST XAF XAG XAU XBA XBB XBC XBD XCD XDR XOF XPD XPF XPT XSU XUA XXX YER ZAR ZMW ZWL
""".split()

CODE_LISTS: dict[str, list[str]] = {
    "currency": CURRENCIES,
    "eu_country": EU_COUNTRIES,
    "payment_form": [str(i) for i in range(1, 8)],
    "cargo": [str(i) for i in range(1, 21)],
    "own_account": ["1", "2", "3"],
    "taxpayer_state": ["1", "2", "3", "4"],
    "authorised_role": ["1", "2", "3"],
    "third_party_role": [str(i) for i in range(1, 11)],
    "third_party_role_3": [str(i) for i in range(1, 12)],
    "kind": ["VAT", "KOR", "ZAL", "ROZ", "UPR", "KOR_ZAL", "KOR_ROZ"],
    "correction_type": ["1", "2", "3"],
    "vat_code": ["23", "22", "8", "7", "5", "4", "3", "0", "zw", "oo", "np"],
    "vat_code_3": ["23", "22", "8", "7", "5", "4", "3", "0 KR", "0 WDT", "0 EX", "zw", "oo", "np I", "np II"],
    "procedure": ["WSTO_EE", "IED", "TT_D", "I_42", "I_63", "B_SPV", "B_SPV_DOSTAWA", "B_MPV_PROWIZJA"],
    "order_procedure": ["WSTO_EE", "IED", "TT_D", "B_SPV", "B_SPV_DOSTAWA", "B_MPV_PROWIZJA"],
    "gtu": [f"GTU_{i:02d}" for i in range(1, 14)],
    "transport": ["1", "2", "3", "4", "5", "7", "8"],
    "column_type": ["date", "datetime", "dec", "int", "time", "txt"],
}


def code_list(spark: SparkSession) -> DataFrame:
    """All code lists as one table of fixed size (list, value)."""
    rows = [(name, value) for name, values in CODE_LISTS.items() for value in values]
    values = ", ".join(f"('{name}', '{value}')" for name, value in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS code_list(list, value)")


# Labels of payment forms, by code and by the payment type of an invoice record.
PAYMENT_FORMS = {
    "1": "Gotówka", "2": "Karta", "3": "Bon", "4": "Czek", "5": "Kredyt", "6": "Przelew", "7": "Mobilna",
}
PAYMENT_LABELS = {"cash": "Gotówka", "transfer": "Przelew", "card": "Karta"}

# --- Facet patterns ----------------------------------------------------------------
PATTERN_AMOUNT = r"^-?([1-9]\d{0,15}|0)(\.\d{1,2})?$"
PATTERN_UNIT_PRICE = r"^-?([1-9]\d{0,13}|0)(\.\d{1,8})?$"
PATTERN_QUANTITY = r"^-?([1-9]\d{0,15}|0)(\.\d{1,6})?$"
PATTERN_NIP = r"^[1-9]((\d[1-9])|([1-9]\d))\d{7}$"
PATTERN_INTERNAL_ID = r"^[1-9]((\d[1-9])|([1-9]\d))\d{7}-\d{5}$"
PATTERN_VAT_EU = r"^(\d|[A-Z]|\+|\*){1,12}$"
PATTERN_ACCOUNT = r"^[0-9A-Z]{10,32}$"
PATTERN_SWIFT = r"^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3}){0,1}$"
PATTERN_FOREIGN_ID = r"^[a-zA-Z0-9]{1,50}$"
PATTERN_PAYMENT_ID = r"^[0-9]{3}[a-zA-Z0-9]{10}$"
# Taxpayer id, date, two hexadecimal blocks, check pair.
PATTERN_CLEARANCE = (
    r"^([1-9](?:\d[1-9]|[1-9]\d)\d{7}|M\d{9}|[A-Z]{3}\d{7})"
    r"-((?:20[2-9][0-9]|2[1-9][0-9]{2}|[3-9][0-9]{3})(?:0[1-9]|1[0-2])(?:0[1-9]|[1-2][0-9]|3[0-1]))"
    r"-([0-9A-F]{6})-?([0-9A-F]{6})-([0-9A-F]{2})$"
)
PATTERN_PESEL = r"^\d{2}(0[1-9]|1[0-2]|2[1-9]|3[0-2]|4[1-9]|5[0-2]|6[1-9]|7[0-2]|8[1-9]|9[0-2])\d{7}$"
PATTERN_PAYMENT_LINK = (
    r"^(https?)://([a-zA-Z0-9][a-zA-Z0-9-]*\.)+[a-zA-Z]{2,}(:[0-9]{1,5})?(/[^\s?#]*)?"
    r"\?([^#\s]*&)?IPKSeF=[0-9]{3}[a-zA-Z0-9]{10}(&[^#\s]*)?(#.*)?$"
)

# VAT number grammar per country, without the country prefix.
VAT_EU_GRAMMAR = {
    "AT": r"U\d{8}",
    "BE": r"[01]\d{9}",
    "BG": r"\d{9,10}",
    "CY": r"\d{8}[A-Z]",
    "CZ": r"\d{8,10}",
    "DE": r"\d{9}",
    "DK": r"\d{8}",
    "EE": r"\d{9}",
    "EL": r"\d{9}",
    "ES": r"[A-Z]\d{8}|\d{8}[A-Z]|[A-Z]\d{7}[A-Z]",
    "FI": r"\d{8}",
    "FR": r"[A-Z0-9]{2}\d{9}",
    "HR": r"\d{11}",
    "HU": r"\d{8}",
    "IE": r"\d{7}[A-Z]{2}|\d[A-Z0-9+*]\d{5}[A-Z]",
    "IT": r"\d{11}",
    "LT": r"\d{9}|\d{12}",
    "LU": r"\d{8}",
    "LV": r"\d{11}",
    "MT": r"\d{8}",
    "NL": r"[A-Z0-9+*]{12}",
    "PT": r"\d{9}",
    "RO": r"\d{2,10}",
    "SE": r"\d{12}",
    "SI": r"\d{8}",
    "SK": r"\d{10}",
    "XI": r"\d{9}|\d{12}|(GD|HA)\d{3}",
}

# Ranges of the date and time types.
DATE_RANGES = {
    "TData": ("2016-07-01", "2050-01-01"),
    "TDataT": ("2006-01-01", "2050-01-01"),
    "TDataU": ("1990-01-01", "2050-01-01"),
}
TIME_RANGE = ("2021-10-01 00:00:00", "2050-01-01 23:59:59")

# Longest text per type, after whitespace collapse.
TEXT_LENGTHS = {"TZnakowy20": 20, "TZnakowy50": 50, "TZnakowy": 256, "TZnakowy512": 512,
                "phone": 16, "gln": 13, "buyer_link": 32, "registry": 9}

# Weights of the control digits.
PESEL_WEIGHTS = [1, 3, 7, 9, 1, 3, 7, 9, 1, 3]
ACCOUNT_WEIGHTS = [3, 9, 7, 1]

# --- Error catalogue entries that rules point to -----------------------------------
RULE_ERRORS = {
    "schema": (21401, "Dokument nie jest zgodny ze schemą (xsd)."),
    "file_size": (21402, "Nieprawidłowy rozmiar pliku."),
    "file_hash": (21403, "Nieprawidłowy skrót pliku."),
    "part_size": (21157, "Nieprawidłowy rozmiar części pakietu."),
    "part_hash": (21158, "Nieprawidłowy skrót części pakietu."),
    "issuer": (21212, "Nieprawidłowy wystawca dokumentu."),
    "session_duplicate": (21176, "Duplikat faktury w kontekście sesji."),
    "package_duplicate": (21218, "Duplikat faktury w kontekście pakietu."),
}

# --- Amount in words -----------------------------------------------------------------
ONES = ["", "jeden", "dwa", "trzy", "cztery", "pięć", "sześć", "siedem", "osiem", "dziewięć"]
TEENS = ["dziesięć", "jedenaście", "dwanaście", "trzynaście", "czternaście",
         "piętnaście", "szesnaście", "siedemnaście", "osiemnaście", "dziewiętnaście"]
TENS = ["", "", "dwadzieścia", "trzydzieści", "czterdzieści",
        "pięćdziesiąt", "sześćdziesiąt", "siedemdziesiąt", "osiemdziesiąt", "dziewięćdziesiąt"]
HUNDREDS = ["", "sto", "dwieście", "trzysta", "czterysta",
            "pięćset", "sześćset", "siedemset", "osiemset", "dziewięćset"]
ZLOTY_FORMS = ("złoty", "złote", "złotych")
GROSZ_FORMS = ("grosz", "grosze", "groszy")
THOUSAND_FORMS = ("tysiąc", "tysiące", "tysięcy")

# --- Month names ------------------------------------------------------------------------
MONTHS = {
    "january": "01", "february": "02", "march": "03", "april": "04", "may": "05", "june": "06",
    "july": "07", "august": "08", "september": "09", "october": "10", "november": "11", "december": "12",
}
