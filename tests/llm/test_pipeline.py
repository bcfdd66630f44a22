"""The pipeline against a plain version of each stage, and the registration of the corpus queries."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import corpus_pipeline
from faktorium.llm import queries, texts, tokens
from tests.llm.test_operators import plain_components, plain_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage_results(spark, docs, tmp_path):
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, docs, "unused").write.parquet(path)
        docs = spark.read.parquet(path)
        yield name, docs, docs.collect()


def plain_stages(rows, answer, spark, schema):
    rows = [r for r in rows if any(c.isalpha() for c in r["text"] or "")]
    yield rows
    groups = defaultdict(list)
    for r in rows:
        groups["".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])].append(r)
    rows = [max(g, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)) for g in groups.values()]
    yield rows
    groups = defaultdict(list)
    for r, root in zip(rows, plain_components([plain_fingerprint(r["text"]) for r in rows])):
        groups[root].append(r)
    rows = [min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) for g in groups.values()]
    yield rows
    copies = answer(queries.MIX_SQL, spark.createDataFrame(rows, schema))
    by_id = {r["doc_id"]: r for r in rows}
    yield [by_id[c["doc_id"]] for c in copies for _ in range(c["copies"])]


def test_stages_against_plain_versions(spark, given, awkward, answer, tmp_path):
    tokenizer = Tokenizer.from_file(tokens.default_path())
    for k, df in enumerate([given, awkward]):
        found = list(stage_results(spark, df, tmp_path / str(k)))
        expected = list(plain_stages(df.collect(), answer, spark, df.schema))
        for (name, stage_df, rows), plain in zip(found, expected):
            assert stage_df.columns == COLUMNS, name
            assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in plain), name
        mixed, packed = found[3][2], found[4][2]
        lengths = Counter((r["doc_id"], len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1) for r in mixed)
        pieces = Counter()
        for r in packed:
            pieces[r["doc_id"], r["doc_tokens"]] += r["length"]
        assert pieces == Counter({key: key[1] * n for key, n in lengths.items()})


def test_reruns_agree_whatever_the_layout(spark, make):
    line = "one text that is there again and again under the same id with other columns"
    rows = [(1, line, "en", f"s{i}", i) for i in range(8)] + [(None, line + " too", None, f"t{i}", None) for i in range(8)]
    rows += [(2, line + " near", "en", "a", i) for i in range(4)] + [(3, f"other words {i} " * 9, "en", "a", i) for i in range(6)]
    df, seen = make(rows), set()
    for n in range(1, 6):
        spread = df.repartition(n, F.xxhash64("source", "n_chars", F.lit(n)))
        kept = corpus_pipeline.drop_near_copies(spark, corpus_pipeline.drop_exact_copies(spark, spread, ""), "").collect()
        mixed = corpus_pipeline.mix_sources(spark, spread, "").collect()
        seen.add((tuple(sorted(map(repr, kept))), tuple(sorted(map(repr, mixed)))))
    assert len(seen) == 1


def test_extra_columns_pass_all_stages(spark, awkward, tmp_path):
    clash = awkward
    for name in ("digest", "size", "fp", "_hash", "lang_pred", "component_id", "ids"):
        clash = clash.withColumn(name, clash["source"])
    for name, df, _ in list(stage_results(spark, clash, tmp_path))[:-1]:
        assert set(df.columns) >= {*COLUMNS, "digest", "size", "fp", "component_id", "ids"}, name


def test_empty_table_passes_all_stages(spark, given, tmp_path):
    for _, _, rows in stage_results(spark, given.limit(0), tmp_path):
        assert rows == []


def test_one_query_per_operator_is_registered():
    numbers = Counter(m[1] for name in entry_points.queries() if (m := re.match(r"op(\d+)_", name)))
    assert numbers == {str(n): 1 for n in range(1, 14)} and "pipeline" in entry_points.queries()
    assert {"op3_exact_dedup", "op6_mix_sources", "op11_merkle_manifest", "op12_collocations"} <= set(entry_points.oracle_sql())


def test_queries_match_their_sql_on_the_given_table(spark, given, answer):
    for name, sql in queries.ORACLES.items():
        rows = queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
        expected = answer(sql, given)
        columns = sorted(expected[0])
        assert Counter(tuple(str(r[c]) for c in columns) for r in rows) == Counter(tuple(str(r[c]) for c in columns) for r in expected)


def test_near_copies_are_decided_per_row(spark, make):
    def text(name, n=60):
        return " ".join(f"{name}{i}" for i in range(n))

    near = lambda name: text(name).upper()  # The same fingerprint: case doesn't count.
    rows = [
        (1, text("a"), "en", "s", 1), (None, near("a"), "en", "s", 2),  # A null id next to an id: the id stays.
        (None, text("b"), "en", "s", 3),  # Null ids that are alone stay.
        (None, text("c"), "en", "s", 4),
        (None, text("d"), "en", "s", 5), (None, near("d"), "en", "s", 6),  # Null ids only: one of them stays.
        (7, text("e"), "en", "s", 7), (7, near("f"), "en", "s", 8), (3, text("f"), "en", "s", 9),  # One id, two components.
        (4, text("g"), "en", "s", 10), (4, near("g"), "en", "s", 11), (5, text("g"), "en", "s", 12),  # Copies of the kept id.
    ]
    kept = corpus_pipeline.drop_near_copies(spark, make(rows).repartition(3), "unused").collect()
    texts = Counter(r["text"].lower() for r in kept)
    assert texts == Counter({text(name): 1 for name in "abcdefg"})
    ids = {r["text"].lower()[0]: r["doc_id"] for r in kept}
    assert ids == {"a": 1, "b": None, "c": None, "d": None, "e": 7, "f": 3, "g": 4}


def test_a_missing_language_model_rejects_nothing(spark, given, awkward):
    for df in (given.limit(50), awkward):
        without = df.withColumn("lang", F.lit(None).cast("string"))
        held_out = df.withColumn("lang", F.when(texts.is_held_out(F.col("doc_id")), F.col("lang")))
        expected = Counter(r["text"] for r in df.collect() if any(c.isalpha() for c in r["text"] or ""))
        for unlearnable in (without, held_out):
            found = corpus_pipeline.identify_language(spark, unlearnable, "unused")
            assert found.columns == COLUMNS and Counter(r["text"] for r in found.collect()) == expected
