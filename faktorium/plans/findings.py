"""Findings of rules that need more than one row, in the shape of the document rules and with catalogue codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faktorium.operators.validation import as_violations, attach_error_code
from faktorium.plans import identifiers, log_queries, packages, rules
from faktorium.plans.registry import ORACLES, query


def cross_row_violations(spark, sf) -> DataFrame:
    """All findings of joins and aggregates over the given tables."""
    broken = lambda df: df.where(~F.col("is_valid"))
    parts, files = packages.verify_parts(spark, sf), packages.verify_files(spark, sf)
    part = F.concat_ws("/", "package_id", "part_no")
    copies = log_queries.duplicate_lines(spark, sf)
    issuers = identifiers.nip_check(spark, sf).where("NOT is_nip")
    found = [
        as_violations(issuers, F.col("invoice_id"), "VAL-10", "Podmiot1/DaneIdentyfikacyjne/NIP", "tax id of the issuer is malformed", F.col("nip")),
        as_violations(
            broken(rules.check_header_vs_lines(spark, sf)), F.col("invoice_id"), "VAL-24", "Fa/P_13", "summary differs from the lines", F.col("net_diff")
        ),
        as_violations(
            broken(rules.line_numbering_check(spark, sf)), F.col("invoice_id"), "VAL-26", "Fa/FaWiersz/NrWierszaFa", "lines are not numbered 1..n",
            F.col("highest"),
        ),
        as_violations(log_queries.find_duplicates(spark, sf), F.col("event_id"), "VAL-27s", "Fa/P_2", "sent twice in a session", F.col("k")),
        as_violations(copies, F.col("invoice_id"), "VAL-27p", "Fa/P_2", "sent twice in a package", F.col("raw_line_no")),
        as_violations(
            broken(rules.split_payment(spark, sf)), F.col("invoice_id"), "VAL-29", "Fa/Adnotacje/P_18A", "split payment is not marked", F.col("split_flag")
        ),
        as_violations(
            broken(rules.check_order_value(spark, sf)), F.col("invoice_id"), "VAL-32", "Fa/Zamowienie/WartoscZamowienia",
            "order value differs from its lines", F.col("declared"),
        ),
        as_violations(
            log_queries.code_list_antijoin(spark, sf), F.col("c_custkey"), "VAL-07", "Fa/KodWaluty", "value is not in the code list", F.col("currency")
        ),
        as_violations(parts.where("size_error <> 0"), part, "PKG-size", "fileSize", "size of a part differs"),
        as_violations(parts.where("hash_error <> 0"), part, "PKG-hash", "fileHash", "hash of a part differs"),
        as_violations(files.where("size_error <> 0"), F.col("doc_id"), "file_size", "fileSize", "size of a file differs"),
        as_violations(files.where("hash_error <> 0"), F.col("doc_id"), "file_hash", "fileHash", "hash of a file differs"),
    ]
    return reduce(DataFrame.unionByName, found)


def _count_sql(rule_id: str, code: int, name: str, condition: str) -> str:
    return f"SELECT '{rule_id}' AS rule_id, {code} AS error_code, count(*) AS findings FROM ({ORACLES[name]}) WHERE {condition} HAVING count(*) > 0"


@query("cross_row_violations", " UNION ALL ".join(_count_sql(*x) for x in [
    ("VAL-10", 21212, "nip_check", "NOT is_nip"), ("VAL-24", 21401, "check_header_vs_lines", "NOT is_valid"), ("VAL-26", 21401, "line_numbering_check", "NOT is_valid"),
    ("VAL-27s", 21176, "find_duplicates", "TRUE"), ("VAL-27p", 21218, "duplicate_lines", "TRUE"),
    ("VAL-29", 21401, "split_payment", "NOT is_valid"), ("VAL-32", 21401, "check_order_value", "NOT is_valid"),
    ("VAL-07", 21401, "code_list_antijoin", "TRUE"), ("PKG-size", 21157, "verify_parts", "size_error <> 0"),
    ("PKG-hash", 21158, "verify_parts", "hash_error <> 0"), ("file_size", 21402, "verify_files", "size_error <> 0"),
    ("file_hash", 21403, "verify_files", "hash_error <> 0"),
]))
def count_cross_row_violations(spark, sf):
    coded = attach_error_code(cross_row_violations(spark, sf))
    return coded.groupBy("rule_id", "error_code").agg(F.count(F.lit(1)).alias("findings"))
