"""The corpus operators against their SQL or a plain version in Python."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faktorium.llm import components, exact_dedup, language, mixing, packing, queries, simhash, texts, tokens


def canonical(rows, columns):
    return Counter(tuple(str(r[c]) for c in columns) for r in rows)


# --- exact copies ---------------------------------------------------------------------------------------------------

COPIES = ["doc_id", "keep_id", "group_size", "text_sha256"]


@pytest.mark.parametrize("counters", [1, 3, 2048])
def test_exact_copies(spark, given, awkward, answer, counters):
    for df in (given, awkward, given.limit(0)):
        found = exact_dedup.find_copies(spark, df, counters=counters)
        rows = found.withColumn("text_sha256", F.lower(F.hex("digest"))).collect()
        assert canonical(rows, COPIES) == canonical(answer(queries.ORACLES["op3_exact_dedup"], df), COPIES)
        kept = Counter(r["text_sha256"] for r in rows if r["kept"])
        assert set(kept) == {r["text_sha256"] for r in rows} and set(kept.values()) <= {1}


def test_misra_gries_finds_every_frequent_digest():
    import pandas as pd

    values = [bytes([i % 50]) for i in range(500)] + [b"hot"] * 300
    batches = [pd.DataFrame({"digest": values[i : i + 100]}) for i in range(0, 800, 100)]
    (summary,) = exact_dedup.misra_gries(4)(iter(batches))
    assert len(summary) <= 4 and b"hot" in set(summary["digest"])


def test_drop_copies_keeps_one_row_of_each_text(spark, awkward):
    clash = awkward.withColumn("digest", F.lit("x")).withColumn("stays", F.lit(1))
    rows = exact_dedup.drop_copies(spark, clash).collect()
    assert Counter((r["text"] or "").lower() for r in rows).most_common(1)[0][1] == 1
    assert {r["doc_id"] for r in rows} == {2, 4, 5, 6, 7, 8, 9} and rows[0].asDict().keys() >= {"digest", "stays"}


# --- SimHash --------------------------------------------------------------------------------------------------------


def plain_fingerprint(text, width=4):
    parts = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(parts[i : i + width]) for i in range(max(1, len(parts) - width + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps, distance=4):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def test_simhash_against_all_pairs(spark, given, awkward):
    for df in (given, awkward, given.limit(0)):
        rows = df.collect()
        fps = [plain_fingerprint(r["text"]) for r in rows]
        groups = defaultdict(list)
        for r, root in zip(rows, plain_components(fps)):
            groups[root].append(r["doc_id"])
        name = {root: min((i for i in ids if i is not None), default=None) for root, ids in groups.items()}
        expected = Counter((r["doc_id"], f, name[root]) for r, f, root in zip(rows, fps, plain_components(fps)))
        found = simhash.near_duplicates(spark, df).collect()
        assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found) == expected


def test_cells_lose_no_pair_in_range(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for fp in base.tolist():
        for flips in range(1, 6):
            for bit in rng.choice(64, flips, replace=False).tolist():
                fp ^= 1 << bit
            fps.add(fp)
    fps = sorted(fps)
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    linked = components.components(spark, simhash.near_links(table)).collect()
    names = {r["node"] % (1 << 64): r["component"] for r in linked}
    found, expected = defaultdict(set), defaultdict(set)
    for i, (f, root) in enumerate(zip(fps, plain_components(fps))):
        expected[root].add(f)
        found[names.get(f, ("alone", f))].add(f)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))


def test_manhattan_distance_of_counts_is_a_lower_bound():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 63, (2, 500), dtype=np.uint64)
    counts = np.abs(simhash.popcounts(a).astype(int) - simhash.popcounts(b)).sum(axis=1)
    assert (counts <= np.bitwise_count(a ^ b)).all()


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    found = components.components(spark, spark.createDataFrame(links, "u long, v long")).collect()
    assert {(r["node"], r["component"]) for r in found} == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 140)}


# --- languages ------------------------------------------------------------------------------------------------------


def test_language_on_held_out_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(df, language.learnable())
    rows = language.predict(spark, model, df.where(texts.is_held_out(F.col("doc_id")))).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95
    assert all(0 <= r["lang_score"] <= 1 for r in rows)


def test_language_scores_are_the_sums_of_log_probabilities(spark, given):
    model = language.fit(given, language.learnable())
    log_probs = model.log_probs
    values = ["Und der Text", "été", "x", "", "Привет мир", "日本語の文 𝔘"]
    for value, got in zip(values, zip(*language.score_texts(model, pa.array(values)))):
        data = value.lower()
        total = model.priors.astype(float)
        for order in language.ORDERS:
            for i in range(len(data) - order + 1):
                gram = sum(ord(c) << 21 * (order - 1 - k) for k, c in enumerate(data[i : i + order]))
                h = (gram + order) * 0x9E3779B97F4A7C15 % 2**64
                h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % 2**64
                total = total + log_probs[h >> 64 - language.BUCKET_BITS]
        best = int(np.argmax(total))
        expected = (model.languages[best], 1 / np.exp(total - total[best]).sum()) if data else ("und", 0.0)
        assert got[0] == expected[0] and abs(got[1] - expected[1]) < 1e-6


def test_language_edge_cases(spark, awkward):
    model = language.fit(awkward, language.learnable())
    rows = language.predict(spark, model, awkward).collect()
    for r in rows:
        has_letter = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not has_letter)
    nothing = language.fit(awkward.limit(0), language.learnable())
    assert {r["lang_pred"] for r in language.predict(spark, nothing, awkward).collect()} == {"und"}
    assert language.predict(spark, model, awkward.limit(0)).count() == 0


def test_every_language_is_learned(spark, make):
    letters = "abcdefghijklmnop"
    own = lambda i: " ".join([letters[i // 16] + letters[i % 16] + letters[i // 16] * 2] * (40 if i % 2 else 20))
    labelled = make([(4 * i + k, own(i), f"l{i:03}", "a", 1) for i in range(200) for k in range(4 if i else 40)])
    model = language.fit(labelled, F.lit(True))
    assert model.languages == [f"l{i:03}" for i in range(200)] and model.log_probs.shape[1] == 200
    rows = language.predict(spark, model, labelled).collect()
    assert len(rows) == labelled.count() and all(r["lang_pred"] == r["lang"] for r in rows)


def test_languages_by_their_characters(spark, make):
    words = {"ru": "привет как дела мир", "el": "γεια σου κόσμε", "zh": "你好世界今天", "ja": "こんにちは世界です"}
    rows = [(i, " ".join([w] * (i % 3 + 1)), lang, "a", 1) for i, (lang, w) in enumerate(list(words.items()) * 12)]
    model = language.fit(make(rows), language.learnable())
    assert all(r["lang_pred"] == r["lang"] for r in language.predict(spark, model, make(rows)).collect())
    # One character is one unigram, whatever its bytes.
    buckets, owners = language.gram_buckets(pa.array(["жё", "日", "a"]))
    assert np.bincount(owners).tolist() == [3, 1, 1] and len(buckets) == 5


def test_sample_of_a_language_is_never_empty_and_bounded(spark, make, monkeypatch):
    counts = [1, 10, 10**4, 5 * 10**9, 10**18]
    sizes = spark.createDataFrame([(n, 7) for n in counts], "n long, least long").select(
        "n", language.sample_limit(F.col("n"), F.col("least")).alias("most")
    )
    most = {r["n"]: r["most"] for r in sizes.collect()}
    for n in counts:
        share = min(language.MARGIN * language.DOCS_PER_LANGUAGE * language.HASH_RANGE // n, language.HASH_RANGE)
        assert most[n] == max(share, 7) > 0
    # One text is a third of the rows, one language a single text that is repeated under one id.
    monkeypatch.setattr(language, "DOCS_PER_LANGUAGE", 20)
    rows = [(i, "the same text again", "en", "a", 1) for i in range(300)] + [(1000 + i, f"other words {i}", "en", "a", 1) for i in range(600)]
    rows += [(5000, "immer nur dieses", "de", "a", 1)] * 300
    model = language.fit(make(rows), F.lit(True))
    total = {r["place"]: r["n"] for r in model.counts.groupBy("place").agg(F.sum("n").alias("n")).collect()}
    assert total[0] == 20 * (16 + 15 + 14) and 20 * 3 * 12 < total[1] <= 20 * 3 * 19
    rows = language.predict(spark, model, make(rows)).collect()
    assert all(r["lang_pred"] == r["lang"] for r in rows)


def test_more_languages_than_one_broadcast(spark, given, monkeypatch):
    labelled = given.withColumn("lang", F.concat("lang", (F.col("doc_id") % 3).cast("string")))
    expected = language.predict(spark, language.fit(labelled, language.learnable()), labelled).collect()
    monkeypatch.setattr(language, "PART_LANGUAGES", 5)
    model = language.fit(labelled, language.learnable())
    assert len(list(model.parts())) == 3
    found = language.predict(spark, model, labelled, letters_name="letters").collect()
    assert [r["lang_pred"] for r in found] == [r["lang_pred"] for r in expected]
    assert np.allclose([r["lang_score"] for r in found], [r["lang_score"] for r in expected])


@pytest.mark.parametrize("at_once", [1, 3, 128])
def test_blocks_of_languages_give_the_same_answers(spark, given, monkeypatch, at_once):
    labelled = given.withColumn("lang", F.concat("lang", (F.col("doc_id") % 2).cast("string")))
    whole = language.fit(labelled, language.learnable())
    values = pa.array([r["text"] for r in given.limit(40).collect()] + ["", None, "x", "123"])
    expected = language.score_texts(whole, values)
    monkeypatch.setattr(language, "BLOCK_LANGUAGES", at_once)
    model = language.fit(labelled, language.learnable())
    found = language.score_texts(model, values)
    assert model.languages == whole.languages and np.array_equal(model.log_probs, whole.log_probs)
    assert found[0] == expected[0] and np.allclose(found[1], expected[1])


# --- mixing ---------------------------------------------------------------------------------------------------------

MIXED = ["doc_id", "size", "source_size", "taken", "copies"]


def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted(n for n in sizes if n is not None) + [n for n in sizes if n is None]
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    target, rest, open_names = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while rest > 1e-9 and open_names:
        share = rest / sum(weight[n] for n in open_names)
        rest = 0.0
        for n in list(open_names):
            target[n] += share * weight[n]
            if target[n] >= 3 * sizes[n]:
                rest += target[n] - 3 * sizes[n]
                target[n] = 3.0 * sizes[n]
                open_names.discard(n)
    return target


def test_mixing(spark, given, awkward, answer):
    for df in (given, awkward, given.limit(0)):
        sized = df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
        rows = mixing.copies(sized).select(
            "row.*", "source_size", "target", (F.col("copies") * F.col("row.size")).alias("taken"), "copies"
        ).collect()
        expected = answer(queries.ORACLES["op6_mix_sources"], df)
        assert canonical(rows, MIXED) == canonical(expected, MIXED)
        sizes = Counter()
        for r in df.collect():
            sizes[r["source"]] += len((r["text"] or "").replace("\x1c", "x").split())
        targets = plain_targets(dict(sizes))
        for r in rows:
            assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-6 * (1 + r["target"])
            assert 0 <= r["copies"] <= 3


def test_mixed_words_come_near_the_target(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sized = df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    rows = mixing.copies(sized).groupBy("row.source").agg(
        F.max("target").alias("target"), F.sum(F.col("copies") * F.col("row.size")).alias("taken"), F.max("row.size").alias("largest")
    ).collect()
    assert all(abs(r["taken"] - r["target"]) <= 2 * r["largest"] for r in rows)


def test_mix_emits_copies_with_all_columns(spark, awkward):
    extra = awkward.withColumn("copies", F.lit("clash")).withColumn("size", F.lit(-1))
    mixed = mixing.mix(extra)
    assert mixed.columns == extra.columns and set(r["copies"] for r in mixed.collect()) == {"clash"}


# --- tokens and packing ---------------------------------------------------------------------------------------------

ODD_TEXTS = [
    "", " ", "Hello, World!!", "don't we'll it's I'M x's", "a\x1cb\x1fc", "café café İstanbul ΣΟΣ",
    "<|endoftext|> a<|startoftext|>b", "x" * 300, "3.14 1,000 a1b2", "tab\tnew\nline em nbsp\u0085nel", "你好 \U0001f600!",
    "Word. word... WORD? (word) word;word a|b | c", "'s 's.x 'T", "-- _under_score_", "École ÜBER straße Ñandú, ÿ÷×", "cafe\u0301 \u00c5ngstro\u0308m", "​zero ﻿bom", "KKelvin ſs",
]


def test_pieces_encode_like_whole_texts(given):
    tokenizer = Tokenizer.from_file(tokens.default_path())
    pieces = tokens.PieceTable(tokens.default_path(), entries=500)
    for text in ODD_TEXTS + [r["text"] for r in given.limit(120).collect()]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(pieces.ids(text), "<u4").tolist() == ids, text[:50]


@pytest.mark.parametrize("open_limit", [4, 8192])
def test_packing_loses_and_repeats_nothing(spark, given, awkward, open_limit):
    tokenizer = Tokenizer.from_file(tokens.default_path())
    for df in (given, awkward, given.limit(0)):
        rows = packing.pack(df, tokens.default_path(), open_limit=open_limit).collect()
        ids = defaultdict(list)
        for r in df.collect():
            ids[r["doc_id"]].append(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2])
        windows = defaultdict(list)
        covered = defaultdict(Counter)
        for r in rows:
            windows[r["sequence_id"]].append((r["offset"], r["length"]))
            fits = [x for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"]]
            piece = [x[r["start"] : r["start"] + r["length"]] for x in fits]
            assert any(zlib.crc32(np.array(p, "<u4").tobytes()) == r["ids_crc32"] for p in piece)
            for i in range(r["start"], r["start"] + r["length"]):
                covered[r["doc_id"], r["doc_tokens"]][i] += 1
        for name, texts_of in ids.items():
            for length in {len(x) for x in texts_of}:
                n = sum(len(x) == length for x in texts_of)
                assert covered[name, length] == Counter({i: n for i in range(length)})
        for parts in windows.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
        short = [w for w, parts in windows.items() if sum(n for _, n in parts) < 4096]
        assert len(short) <= max(1, df.rdd.getNumPartitions())


def test_sum_of_squares_picks_the_level_with_the_smallest_sum():
    rng = np.random.default_rng(5)
    packer = packing.SumOfSquares(16)
    for i, length in enumerate(rng.integers(1, 16, 400).tolist()):
        counts = packer.levels.copy()
        choices = {}
        for level in [0, *[h for h in range(1, 16) if counts[h] and h + length <= 16]]:
            after = counts.copy()
            after[level] -= level > 0
            after[level + length] += level + length < 16
            choices[level] = int((after.astype(int) ** 2).sum())
        assert choices[packer.best_level(length)] == min(choices.values())
        packer.place((i, 0, length))
