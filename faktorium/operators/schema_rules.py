"""Rules that come from a schema: types with their bases, elements with their types, and values checked against both.

The schema is data here, not code: a table of facets per type, inherited along
the bases, joined to the values.  A schema of any number of types is checked in
one pass over the values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faktorium.functions.text import collapse_whitespace
from faktorium.operators.chains import ancestors

# Fixed names of the facets that are checked.
LENGTHS = ["minLength", "maxLength", "length"]
DIGITS = ["totalDigits", "fractionDigits"]
BOUNDS = ["minInclusive", "maxInclusive", "minExclusive", "maxExclusive"]
# Primitive types whose bounds are compared as dates, times or numbers.
DATES, TIMES = ["date"], ["dateTime"]


def local_name(name: Column) -> Column:
    """A name without its prefix."""
    return F.element_at(F.split(name, ":"), -1)


def resolve_types(spark: SparkSession, types: DataFrame, facets: DataFrame) -> DataFrame:
    """What each type demands, with everything that it inherits: one row per type.

    ``types`` has ``type, base``, ``facets`` has ``type, facet, value``.  Of a
    single-valued facet and of the enumeration the one nearest to the type
    holds; every type of a chain adds its patterns, of which one must match.
    ``primitive`` is the end of the chain.
    """
    named = types.select(local_name(F.col("type")).alias("type"), local_name(F.col("base")).alias("base")).distinct()
    up = ancestors(spark, named, "type", "base")
    chain = up.unionByName(named.select("type", F.col("type").alias("ancestor"), F.lit(0).cast("long").alias("steps")))
    primitive = chain.groupBy("type").agg(F.max_by("ancestor", "steps").alias("primitive"))
    own = facets.select(local_name(F.col("type")).alias("ancestor"), "facet", "value")
    inherited = chain.join(own, "ancestor")

    patterns = inherited.where("facet = 'pattern'").groupBy("type", "steps").agg(F.collect_set("value").alias("any"))
    patterns = patterns.groupBy("type").agg(F.collect_list("any").alias("patterns"))
    listed = inherited.where("facet = 'enumeration'").groupBy("type", "steps").agg(F.collect_set("value").alias("values"))
    listed = listed.groupBy("type").agg(F.min_by("values", "steps").alias("enumeration"))
    single = inherited.where(F.col("facet").isin(*LENGTHS, *DIGITS, *BOUNDS)).groupBy("type").agg(
        *[F.min_by("value", F.when(F.col("facet") == f, F.col("steps"))).alias(f) for f in LENGTHS + DIGITS + BOUNDS]
    )
    return primitive.join(patterns, "type", "left").join(listed, "type", "left").join(single, "type", "left")


def _ordered(value: Column, bound: Column, primitive: Column, compare) -> Column:
    """A comparison as dates, as times or as numbers, by the primitive type."""
    as_date = compare(value.try_cast("date"), bound.try_cast("date"))
    as_time = compare(value.try_cast("timestamp"), bound.try_cast("timestamp"))
    as_number = compare(value.try_cast("decimal(38,12)"), bound.try_cast("decimal(38,12)"))
    return F.when(primitive.isin(*DATES), as_date).when(primitive.isin(*TIMES), as_time).otherwise(as_number)


def failed_facets(value: Column, rules: str) -> Column:
    """Names of the facets that a value breaks, from the columns of ``resolve_types`` in the struct ``rules``; a null breaks none."""
    rule = lambda name: F.col(f"{rules}.{name}")
    text = collapse_whitespace(value)
    digits = F.regexp_replace(F.regexp_replace(text, r"^[+-]?0*", ""), r"(\.[0-9]*?)0*$", "$1")
    decimals = F.length(F.regexp_extract(text, r"\.([0-9]*?)0*$", 1))
    matches = F.forall(rule("patterns"), lambda step: F.exists(step, lambda p: F.regexp_like(text, F.concat(F.lit("^(?:"), p, F.lit(")$")))))
    good = {
        "pattern": matches, "enumeration": F.array_contains(rule("enumeration"), text),
        "minLength": F.length(text) >= rule("minLength").try_cast("int"), "maxLength": F.length(text) <= rule("maxLength").try_cast("int"),
        "length": F.length(text) == rule("length").try_cast("int"),
        "totalDigits": F.length(F.regexp_replace(digits, r"\.", "")) <= rule("totalDigits").try_cast("int"),
        "fractionDigits": decimals <= rule("fractionDigits").try_cast("int"),
        "minInclusive": _ordered(text, rule("minInclusive"), rule("primitive"), lambda v, b: v >= b),
        "maxInclusive": _ordered(text, rule("maxInclusive"), rule("primitive"), lambda v, b: v <= b),
        "minExclusive": _ordered(text, rule("minExclusive"), rule("primitive"), lambda v, b: v > b),
        "maxExclusive": _ordered(text, rule("maxExclusive"), rule("primitive"), lambda v, b: v < b),
    }
    column = {"pattern": "patterns"}
    broken = [
        F.when(value.isNotNull() & rule(column.get(name, name)).isNotNull() & ~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in good.items()
    ]
    return F.array_compact(F.array(*broken))


def check_against_schema(values: DataFrame, elements: DataFrame, resolved: DataFrame) -> DataFrame:
    """Add ``type`` and ``failed`` to ``element, value`` rows; elements without a known type have a null type and fail nothing.

    ``elements`` has ``element, type``, ``resolved`` is what ``resolve_types`` gives.
    """
    typed = elements.select("element", local_name(F.col("type")).alias("type")).distinct()
    rules = resolved.select("type", F.struct(*[F.col(c) for c in resolved.columns if c != "type"]).alias("_rules"))
    joined = values.join(typed.join(rules, "type"), "element", "left")
    failed = F.when(F.col("type").isNotNull(), failed_facets(F.col("value"), "_rules")).otherwise(F.array().cast("array<string>"))
    return joined.select(*values.columns, "type", failed.alias("failed"))
