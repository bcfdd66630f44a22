"""Ordered windows give the same result when groups are treated as hot."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from faktorium.operators import reconcile, skew
from faktorium.operators.convert import PLACEHOLDERS, replicate_template
from faktorium.operators.corrections import correction_running_balance
from faktorium.operators.lines import explode_lines, nest_lines
from faktorium.operators.numbering import number_invoices
from faktorium.operators.package import pack_parts


@pytest.fixture(scope="module")
def rows(spark):
    """Half of all rows share one group."""
    base = spark.range(4000).withColumn("g", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 37))
    return base.withColumn("o", (F.col("id") * 7919) % 1009).withColumn("v", F.col("id") % 11).repartition(5).cache()




def same(left, right):
    return sorted(map(tuple, left.collect())) == sorted(map(tuple, right.collect()))


@pytest.mark.parametrize("width", [1, 50, 10_000])
def test_ordered_windows(rows, width):
    window = Window.partitionBy("g").orderBy("o", "id")
    running = window.rowsBetween(Window.unboundedPreceding, 0)
    order, split = [F.col("o"), F.col("id")], [F.floor(F.col("o") / width)]
    numbered = skew.number_rows(rows, ["g"], order, split, "n").select("id", "n")
    assert same(numbered, rows.select("id", F.row_number().over(window).cast("long").alias("n")))
    summed = skew.running_sum(rows, ["g"], order, split, "v", "s").select("id", "s")
    assert same(summed, rows.select("id", F.sum("v").over(running).alias("s")))
    lagged = skew.previous_value(rows, ["g"], order, split, "v", "p").select("id", F.coalesce("p", F.lit(-1)).alias("p"))
    assert same(lagged, rows.select("id", F.coalesce(F.lag("v").over(window), F.lit(-1)).alias("p")))


def test_null_group_is_one_split_group(rows):
    some = rows.withColumn("g", F.when(F.col("g") != 0, F.col("g")))
    window = Window.partitionBy("g").orderBy("id")
    numbered = skew.number_rows(some, ["g"], [F.col("id")], [F.floor(F.col("id") / 100)], "n").select("id", "n")
    assert same(numbered, some.select("id", F.row_number().over(window).cast("long").alias("n")))


def test_rows_are_read_twice_and_exchanged_once(spark, rows, tmp_path):
    path = str(tmp_path / "rows")
    rows.write.parquet(path)
    order, split = [F.col("o"), F.col("id")], [F.floor(F.col("o") / 50)]
    plan = skew.running_sum(spark.read.parquet(path), ["g"], order, split, "v", "s")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 2 and "NestedLoop" not in plan


def test_packages_and_balances_of_one_large_group(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("invoice_id"), F.date_add(F.lit("2025-01-01").cast("date"), (F.col("id") % 90).cast("int")).alias("issue_date"),
        F.when(F.col("id") % 3 == 0, "1").otherwise(F.col("id").cast("string")).alias("seller_nip"),
    )
    month = Window.partitionBy("seller_nip", F.trunc("issue_date", "month")).orderBy("issue_date", "invoice_id")
    expected = docs.select("invoice_id", F.concat_ws("/", F.row_number().over(month), F.month("issue_date"), F.year("issue_date")))
    assert same(number_invoices(docs).select("invoice_id", "number"), expected)
    balance = docs.select(F.col("seller_nip").alias("original_id"), F.col("invoice_id").alias("document_id"), "issue_date", F.lit(5).alias("gross_gr"))
    total = correction_running_balance(balance).groupBy("original_id").agg(F.max("balance").alias("b"))
    assert same(total, balance.groupBy("original_id").agg((F.sum("gross_gr") / 100).cast("decimal(18,2)").alias("b")))
    files = docs.select(F.lit("p").alias("package_id"), (F.col("invoice_id") * 1000).alias("doc_id"), (F.col("invoice_id") % 9).alias("size_bytes"))
    run = F.sum("size_bytes").over(Window.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1))
    expected = files.select("package_id", "doc_id", "size_bytes", (F.floor(F.coalesce(run, F.lit(0)) / 100) + 1).cast("long"))
    assert same(pack_parts(files, 100), expected)


def test_a_long_invoice_stays_one_document(spark):
    lines = spark.range(1, 10_002).select(F.lit(1).alias("invoice_id"), F.col("id").alias("line_no"), (F.col("id") * 2).alias("v"))
    nested = nest_lines(lines, ["v"])
    assert [len(r["positions"]) for r in nested.collect()] == [10_001]
    assert same(explode_lines(nested), lines)


def test_copies_beyond_six_digits_have_numbers_of_their_own(spark):
    case = spark.createDataFrame([("c",)], "case_id string")
    for name in PLACEHOLDERS:
        case = case.withColumn(name, F.lit("x"))
    copies = replicate_template(case, F.lit("#invoice_number#"), 1_000_010)
    assert copies.agg(F.countDistinct("xml"), F.count("xml"), F.max("xml")).first()[:2] == (1_000_010, 1_000_010)
    assert {r["xml"] for r in copies.where("copy_no in (7, 1000001)").collect()} == {"c-000007", "c-1000001"}


def test_duplicates_of_one_popular_key(spark):
    rows = spark.range(2000).select(F.lit("s").alias("scope"), F.when(F.col("id") < 1500, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    found = reconcile.find_duplicates(rows, "scope", ["k"], ["id"])
    assert found.count() == 1499 and found.where("id = 0").count() == 0
    assert reconcile.duplicate_groups(rows, ["scope", "k"], ["id"]).collect()[0]["copies"] == 1499
