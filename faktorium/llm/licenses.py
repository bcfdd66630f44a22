"""License scans by ordered signature rules, in DataFrame functions only.

A text is folded (A-Z) and cut into words. Texts without any of the words that every rule needs are done after a few
substring tests. The others are normalised to single-spaced words; each rule is tried only where its keyword occurs;
marks put before and behind every match give the word interval of each detection. Detections are then resolved in
order of their start (longest first): one that lies inside an accepted detection of the same or a higher priority is
suppressed. A label that only names a family (``gpl``) yields to a more specific one of that family (``gpl-3``) in the
same text. The places of the base phrases are found by their words alone and are never suppressed.

Everything is a projection of the row: no shuffle, no join, and memory in proportion to one text. The rules are a
fixed list. Edge cases: a null or empty text has no words and no labels; other columns of the input may have any name;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faktorium.llm.license_rules import BASE_PHRASES, FAMILY_NAMES, GATES, RULES, Rule
from faktorium.llm.texts import lower_ascii

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
START, END = "\x01", "\x02"
PRIORITIES = 4
PLACE = "struct<start:int,label:string>"
DETECTION = "struct<start:int,before_end:int,before_priority:int,rule:int,label:string>"


def _gate(folded: Column) -> Column:
    """Whether a text can match anything: every base phrase and every rule contains one of these."""
    found = folded.contains("cc") & folded.contains("by")
    for word in GATES:
        found = found | folded.contains(word)
    return found


def _indices(words: Column, test) -> Column:
    """Word numbers (from 0) of the array items that pass; item 0 is the empty one before the first space."""
    marked = F.transform(words, lambda w, i: F.when(test(w), i - 1))
    return F.filter(marked, lambda i: i.isNotNull())


def base_places(normal: Column, phrases: Sequence[tuple[str, str]] = BASE_PHRASES) -> Column:
    """All places where the words of a phrase stand in a row, overlapping ones too."""

    def places(phrase: str, label: str) -> Column:
        marked = F.regexp_replace(normal, f"(?<= )(?={phrase} )", START)
        starts = _indices(F.split(marked, " "), lambda w: w.startswith(START))
        found = F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))
        return F.when(normal.contains(f" {phrase} "), found).otherwise(F.array().cast(f"array<{PLACE}>"))

    return F.concat(*[places(phrase, label) for phrase, label in phrases])


def _rule_table(rules: Sequence[Rule]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"),
                F.lit(f"(?<= )({r.pattern})(?= )").alias("pattern"), F.lit(r.priority).alias("priority"),
                F.lit(i).alias("rule"),
            )
            for i, r in enumerate(rules)
        ]
    )


def detections(normal: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Unresolved detections, sorted by start, longest first, then by priority and the order of the rules."""

    def intervals(rule: Column) -> Column:
        marked = F.split(F.regexp_replace(normal, rule["pattern"], F.lit(f"{START}$1{END}")), " ")
        starts = _indices(marked, lambda w: w.startswith(START))
        ends = _indices(marked, lambda w: w.endswith(END))
        return F.zip_with(
            starts, ends,
            lambda s, e: F.struct(
                s.alias("start"), (-e - 1).alias("before_end"), (-rule["priority"]).alias("before_priority"),
                rule["rule"].alias("rule"), rule["label"].alias("label"),
            ),
        )

    tried = F.filter(_rule_table(rules), lambda r: normal.contains(r["keyword"]))
    return F.array_sort(F.flatten(F.transform(tried, intervals)))


def resolve(found: Column) -> Column:
    """Drop the detections that lie inside an accepted one of the same or a higher priority."""
    state = F.struct(
        F.array_repeat(F.lit(0), PRIORITIES).alias("reach"), F.array().cast(f"array<{DETECTION}>").alias("kept")
    )

    def step(held: Column, item: Column) -> Column:
        priority, end = -item["before_priority"], -item["before_end"]
        reach = F.transform(held["reach"], lambda r, i: F.when(i + 1 <= priority, F.greatest(r, end)).otherwise(r))
        inside = F.element_at(held["reach"], priority) >= end
        accepted = F.struct(reach.alias("reach"), F.array_append(held["kept"], item).alias("kept"))
        return F.when(inside, held).otherwise(accepted)

    return F.aggregate(found, state, step)["kept"]


def most_specific(kept: Column) -> Column:
    """Drop the detections of a family's name where the text has one of a member of the family."""
    names = F.array_distinct(F.transform(kept, lambda d: d["label"]))

    def vague(item: Column) -> Column:
        return item["label"].isin(*FAMILY_NAMES) & F.exists(names, lambda name: name.startswith(F.concat(item["label"], F.lit("-"))))

    return F.filter(kept, lambda item: ~vague(item))


def scan(documents: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """All columns with ``license_words`` (number of words), ``license_base`` (places of the base phrases) and
    ``license_found`` (resolved detections; ends and priorities are kept negated, in sorting order)."""
    added = ("license_words", "license_base", "license_found")
    given = [F.col(f"`{c}`") for c in documents.columns if c not in added]
    folded = documents.select(*given, lower_ascii(F.col(f"`{text}`")).alias("_folded"))
    spaced = F.concat(F.lit(" "), F.regexp_replace("_folded", GAPS, " "), F.lit(" "))
    normal = F.when(_gate(F.col("_folded")), F.regexp_replace(spaced, "^ +| +$", " "))
    cut = folded.select(*given, F.regexp_count("_folded", F.lit(WORDS)).cast("long").alias("license_words"), normal.alias("_normal"))
    none = F.array().cast(f"array<{PLACE}>"), F.array().cast(f"array<{DETECTION}>")
    return cut.select(
        *given, "license_words",
        F.when(F.col("_normal").isNotNull(), base_places(F.col("_normal"))).otherwise(none[0]).alias("license_base"),
        F.when(F.col("_normal").isNotNull(), most_specific(resolve(detections(F.col("_normal"), rules)))).otherwise(none[1]).alias("license_found"),
    )


def labels(*arrays: Column) -> Column:
    """Distinct labels, sorted and comma-joined."""
    return F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(*[F.transform(a, lambda x: x["label"]) for a in arrays]))))


def summarise(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts, first and last place, labels and a confidence per row of ``scan``."""
    base, found = F.col("license_base"), F.col("license_found")
    starts = F.transform(base, lambda p: p["start"])
    best = F.array_max(F.transform(found, lambda d: -d["before_priority"]))
    score = F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce(best / F.lit(float(PRIORITIES)), F.lit(0.0)))
    return scanned.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col("license_words").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        labels(base).alias("base_labels"), labels(base, found).alias("labels"), score.cast("double").alias("score"),
    )
