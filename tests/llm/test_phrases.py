"""Collocations against a plain count of all phrases."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from faktorium.llm import phrases, queries

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_pieces(rows):
    for r in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (r["text"] or "").translate(UPPER)):
            yield r["lang"] or "und" if r["lang"] is None else r["lang"], [w for w in re.split(r"[\x20\x09]", piece) if w]


def plain_counts(rows, least):
    found = Counter()
    for lang, words in plain_pieces(rows):
        found[lang, ()] += len(words)
        for i in range(len(words)):
            for k in range(1, min(4, len(words) - i) + 1):
                found[lang, tuple(words[i : i + k])] += 1
    return {key: n for key, n in found.items() if n >= least}


def plain_collocations(rows, least, top=2000):
    counts = plain_counts(rows, least)
    ranked = defaultdict(list)
    longer = defaultdict(int)
    for (lang, words), n in counts.items():
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                if j - i < len(words):
                    longer[lang, words[i:j]] = max(longer[lang, words[i:j]], n)
    for (lang, words), a in counts.items():
        if len(words) < 2 or 100 * longer[lang, words] >= 80 * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((2000000 * a // (l + r), k, l, r))
        score, _, l, r = min(cuts)
        ranked[lang].append((-score, -a, " ".join(words).encode(), l, r))
    return {
        (lang, rank, phrase.decode(), -a, l, r, counts[lang, ()], -score)
        for lang, found in ranked.items() for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1)
    }


def spoken(seed, n, vocabulary=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["Été", "THE", "\x00", "日本"]
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "\n", " \t", "!."]) for _ in range(n))


@pytest.fixture(scope="module")
def talk(make):
    rows = [(i % 7 or None, spoken(i, 200), ["en", "de", None, "und", ""][i % 5], "a", 1) for i in range(60)]
    rows += [(1, "the same line is here again", "en", "a", 1)] * 200
    rows += [(2, None, "en", "a", 1), (3, "", "fr", "a", 1), (4, spoken(99, 9000), "de", "a", 1), (5, "x" * 30000, "en", "a", 1)]
    return make(rows)


@pytest.mark.parametrize("block_bytes, bucket_rows", [(1 << 20, 1 << 20), (700, 300), (5000, 97)])
def test_counts_of_all_phrases(spark, talk, block_bytes, bucket_rows):
    found = phrases.count_phrases(spark, talk, least=30, block_bytes=block_bytes, bucket_rows=bucket_rows).collect()
    counts = {(r["lang"], tuple(r["phrase"].split(" ")) if r["words"] else ()): r["n"] for r in found}
    assert len(counts) == len(found) and counts == plain_counts(talk.collect(), 30)


def test_collocations(spark, talk, given, awkward, answer):
    for df in (talk, given, awkward, given.limit(0)):
        found = {tuple(r) for r in phrases.mine(spark, df, block_bytes=4000, bucket_rows=500).collect()}
        assert found == plain_collocations(df.collect(), 30)
        expected = answer(queries.PHRASE_SQL, df)
        names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert found == {tuple(r[c] for c in names) for r in expected}
    wide = talk.withColumns({c: F.lit("x") for c in ("phrase", "n", "words", "block", "bucket", "page", "sample", "w1")})
    assert {tuple(r) for r in phrases.mine(spark, wide).collect()} == plain_collocations(talk.collect(), 30)


def test_less_frequent_and_fewer_than_all(spark, talk):
    found = {tuple(r) for r in phrases.mine(spark, talk, least=3, top=5, bucket_rows=200).collect()}
    assert found == plain_collocations(talk.collect(), 3, 5)


def test_scores_beyond_64_bits(spark):
    big = 9 * 10**17
    counts = spark.createDataFrame(
        [("en", "", 0, 3 * big), ("en", "a", 1, 2 * big), ("en", "b", 1, big), ("en", "a b", 2, big), ("en", "c", 1, 7), ("en", "a c", 2, 7)],
        "lang string, phrase string, words int, n long",
    )
    found = {r["phrase"]: r["score"] for r in phrases.collocations(counts).collect()}
    assert found == {"a b": 2000000 * big // (3 * big), "a c": 2000000 * 7 // (2 * big + 7)}


def test_three_way_quicksort_abandons_what_is_rare():
    rng = np.random.default_rng(1)
    columns = [np.zeros(5000, np.int32), *[rng.integers(0, 6, 5000).astype(np.int32) for _ in range(4)]]
    for i in range(2, 5):
        columns[i][columns[i - 1] == 0] = 0
    weights = rng.integers(1, 4, 5000)
    expected = Counter()
    for row in zip(*columns, weights):
        for d in range(5):
            if d and not row[d]:
                break
            expected[row[: d + 1]] += row[5]
    found = {tuple(int(columns[i][p]) for i in range(d + 1)): n for d, p, n in phrases.quicksort_counts(columns, weights, 40)}
    assert found == {k: n for k, n in expected.items() if n >= 40}


def test_packed_blocks_and_their_parts():
    items = [(b"en", b"b a c. a b", 10), (b"", b"zz a b c d", 10)]
    block = phrases.sort_block(items)
    back = phrases.Block.unpack(block.pack())
    keys = [back.key(i) for i in range(len(back))]
    assert keys == sorted(keys) and len(keys) == 10 and keys[0] == (b"", b"a", b"b", b"c", b"d")
    for at, key in enumerate(keys):
        assert back.find(key, back.words.to_pylist()) == at
        assert [back.part(at, 10).key(i) for i in range(10 - at)] == keys[at:]
    assert back.find((b"en", b"aa", b"", b"", b""), back.words.to_pylist()) == 7


def test_a_block_is_sorted_in_little_memory():
    rng = random.Random(7)
    vocabulary = [f"word{i}" for i in range(3000)]
    text = " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", "."]) for _ in range(200_000)).encode()
    tracemalloc.start()
    try:
        block = phrases.sort_block([(b"en", text, len(text))])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(block) > 100_000 and peak < 13 * len(text)


def test_stored_blocks_are_pages_of_their_own_without_a_codec(spark, talk, tmp_path, monkeypatch):
    monkeypatch.setattr(phrases, "work_path", lambda spark, label: str(tmp_path / label))
    phrases.count_phrases(spark, talk.coalesce(1), block_bytes=5000).count()
    (file,) = (tmp_path / "suffix-blocks").glob("*.parquet")
    column = pq.ParquetFile(file).metadata.row_group(0).column(0)
    assert column.path_in_schema == "block" and column.compression == "UNCOMPRESSED"
