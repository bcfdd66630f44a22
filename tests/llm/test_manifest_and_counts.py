"""The Merkle manifest and the token counts against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from faktorium.llm import manifest, queries, token_counts

# --- Merkle manifest ------------------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, i):
    for level in levels[:-1]:
        start = i - i % 3
        yield "".join(level[start:i]), "".join(level[i + 1 : start + 3])
        i //= 3


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for members in groups.values():
        members.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"])))
    trees = {s: plain_tree([plain_leaf(r, r["text"]) for r in groups[s]]) for s in names}
    top = plain_tree([trees[s][-1][0] for s in names])
    found = Counter()
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            path = [*plain_path(trees[s], i), *plain_path(top, k)]
            text = r["text"]
            if r["doc_id"] is not None and text is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = plain_leaf(r, text)
            for left, right in path:
                node = sha(left + node + right)
            proof = sha("".join(left + right for left, right in path))
            root = top[-1][0]
            found[r["doc_id"], plain_leaf(r, r["text"]), trees[s][-1][0], root, proof, node, node == root] += 1
    return found


def test_manifest_is_that_of_plain_trees(spark, given, awkward, make, answer):
    rng = random.Random(5)
    many = [
        (rng.choice([None, i, i, i // 2]), rng.choice([None, "", "a\nb", f"é{i}\n"]), rng.choice([None, "en"]),
         rng.choice([None, "hot", "hot", "Ä", "a", f"s{i % 30}"]), rng.choice([None, i]))
        for i in range(2500)
    ]
    copies = [(7, "same\ntext", "en", "hot", 9)] * 400
    for df in (make(many + copies), given, awkward, make(many[:1])):
        found = queries.merkle_columns(spark, df).collect()
        assert Counter(map(tuple, found)) == plain_manifest(df.collect())
        expected = answer(queries.MERKLE_SQL, df)
        assert Counter(tuple(r[c] for c in found[0].__fields__) for r in expected) == Counter(map(tuple, found))


def test_manifest_of_nothing_and_extra_columns(spark, given, awkward):
    assert queries.merkle_columns(spark, given.limit(0)).collect() == []
    wide = awkward.withColumns({c: F.lit(1) for c in ("tree", "digest", "place", "item", "levels", "row_no", "path", "group")})
    assert Counter(queries.merkle_columns(spark, wide).collect()) == Counter(queries.merkle_columns(spark, awkward).collect())


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 242, 243, 244, 730])
def test_paths_at_the_edges_of_blocks(spark, n):
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    found = manifest.build(spark, rows, fields=("doc_id", "source")).orderBy("doc_id").collect()
    levels = plain_tree([sha(f"{len(str(i))}:{i}1:s") for i in range(n)])
    assert {r["root"] for r in found} == {levels[-1][0]}
    for i in {0, n // 2, n - 1}:
        assert [tuple(p) for p in found[i]["path"]] == list(plain_path(levels, i))


# --- token counts ---------------------------------------------------------------------------------------------------

AWKWARD_PARTS = [
    "a", "b ", "  ", "\n", "'re", "'r", "e", "1", "日本", "é", "<|endoftext|>", "<|endof", "text|>", "!!", "   ", "\t", "😀", " x",
    "word ", "s'", " ", " ", "12 345", "'", "''ll",
]


def awkward_texts():
    rng = random.Random(11)
    texts = ["".join(rng.choice(AWKWARD_PARTS) for _ in range(rng.randint(0, 2500))) for _ in range(40)]
    return texts + [
        "x" * 5000, "x y " * 2000, " " * 5000 + "a", None, "", "q" * 700 + " " + "z" * 1500 + "! " * 900, "<|endoftext|>" * 400,
        "日" * 3000, "a" * 499 + " " + "b" * 3, "\n" * 999 + "'" * 999, "x y " * 2000,
    ]


@pytest.mark.parametrize("step, overlap", [(200, 100), (500, 65), (1024, 1024)])
def test_token_counts_of_spliced_chunks(spark, make, step, overlap):
    tokenizer = token_counts.load(token_counts.default_path())
    texts = awkward_texts()
    df = make([(None if i == 5 else i // 2, t, None, None, None) for i, t in enumerate(texts)])
    found = token_counts.count_tokens(spark, df, token_counts.default_path(), step=step, overlap=overlap).collect()
    expected = Counter()
    for i, t in enumerate(texts):
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        expected[None if i == 5 else i // 2, len((t or "").encode()), n, n > 512] += 1
    assert Counter(map(tuple, found)) == expected


def test_token_counts_with_production_parameters(spark, given, awkward):
    tokenizer = token_counts.load(token_counts.default_path())
    for df in (given, awkward, given.limit(0), awkward.withColumns({c: F.lit("x") for c in ("row", "n", "part", "n_bytes")})):
        found = token_counts.count_tokens(spark, df, token_counts.default_path()).collect()
        expected = Counter(
            (r["doc_id"], len((r["text"] or "").encode()), len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids))
            for r in df.collect()
        )
        assert Counter(tuple(r)[:3] for r in found) == expected
        assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in found)


def test_a_word_longer_than_the_overlap_is_widened_and_only_it(spark, make):
    text = ("ab " * 400) + "w" * 900 + (" cd" * 400)
    rows = make([(1, text, None, None, None)]).select(F.lit(0).cast("long").alias("row"), "text")
    pieces = rows.mapInArrow(token_counts.cut(300, 100), "row long, part long, chunk string")
    todo = pieces.select("row", "part", F.col("part").alias("last"), "chunk")
    encoded = todo.mapInArrow(token_counts.encode_chunks(token_counts.default_path(), 300, 100), token_counts._SPLICE)
    spliced = token_counts.splice(encoded, 300, 100)
    failed = {r["part"] for r in spliced.where("fails").collect()}
    assert failed == {3, 4, 5}
    stay, again = token_counts.widen(spliced, pieces, 300)
    assert [(r["part"], r["last"]) for r in again.collect()] == [(3, 6)]
    assert stay.count() == pieces.count() - 4
    assert again.first()["chunk"] == text[900 : 7 * 300 + 100]


def test_other_files_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        token_counts.load(public_tokenizers.path("word_bpe_49k.json"))
