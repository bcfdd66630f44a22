"""Removal of repeated strings against a plain version that looks at every start."""

import hashlib
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from faktorium.llm import repeats


def plain_removal(texts):
    seen = Counter()
    raw = [(t or "").encode() for t in texts]
    for r in raw:
        seen.update(r[i : i + 200] for i in range(len(r) - 199))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def compare(spark, df):
    rows = df.collect()
    expected = Counter((r["doc_id"], *x) for r, x in zip(rows, plain_removal([r["text"] for r in rows])))
    assert Counter(map(tuple, repeats.remove_repeats(spark, df).collect())) == expected
    return expected


def crafted(make):
    rng = np.random.default_rng(11)

    def noise(n):
        return "".join(rng.choice(list("abcdefg é"), n))

    passage, short, tail = noise(260), noise(170), noise(90)
    rows = [noise(100) + passage + noise(150), passage + noise(30), noise(40) + passage[:205], passage[61:], passage[10:215]]
    rows += ["x" * 500, "x" * 199, "x" * 200, "x" * 201, "ab" * 150, "lorem ipsum " * 60]
    rows += [short + "1" + tail, short + "2" + tail, noise(50) + short + "1" + tail[:40]]
    base = noise(1200)
    for edit in range(12):
        at = int(rng.integers(0, 1200))
        rows.append(base[:at] + noise(1 + edit % 3) + base[at + edit % 2 :])
    rows += [base, base, noise(900), None, ""]
    return make([(i, t, "en", "s", 0) for i, t in enumerate(rows)])


def test_crafted_texts(spark, make):
    expected = compare(spark, crafted(make))
    assert sum(x[2] for x in expected) > 10_000


def test_awkward_and_empty_tables(spark, awkward):
    compare(spark, awkward.where("text is null or length(text) < 1000"))
    assert repeats.remove_repeats(spark, awkward.limit(0)).count() == 0


def test_many_repeated_rows(spark, make):
    rng = np.random.default_rng(3)
    line = "".join(rng.choice(list("abcdefgh "), 10_500))
    other = "".join(rng.choice(list("ijklmnop "), 3_000))
    rows = [(None, line, None, "s", None)] * 2000 + [(1, other, "en", "s", 1), (2, other[500:900] + line[:300] + other[1500:1600], "en", "s", 1)]
    found = Counter(map(tuple, repeats.remove_repeats(spark, make(rows).repartition(16)).collect()))
    (first, n), *rest = found.most_common()
    assert n == 2000 and first[:4] == (None, 10_500, 10_500, 1)
    assert sorted(r[:4] for r, _ in rest) == [(1, 3000, 400, 1), (2, 800, 700, 1)]


def test_given_texts(spark, given):
    compare(spark, given.where("length(text) < 6000"))


def test_long_texts_are_named_in_segments(monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("abcd "), 5000))
    batch = pa.RecordBatch.from_pydict({"text": [text, text[300:]], "uid": [1, 2], "check": pa.array([3, 4], pa.int32())})
    starts = {1: [], 2: []}
    for found in repeats._emit_blocks(iter([batch])):
        for uid, place in zip(found.column("uid").to_pylist(), found.column("place").to_pylist()):
            first, more = divmod(place, repeats.WINDOW)
            starts[uid] += range(first, first + more + 1)
    assert sorted(starts[1]) == list(range(4801)) and sorted(starts[2]) == list(range(4501))


@pytest.mark.parametrize("n", [16, 64, 128])
def test_names_are_those_of_the_bytes(n):
    rng = np.random.default_rng(n)
    data = rng.integers(0, 3, 4000, dtype=np.uint8)
    name = repeats.names(data, (n,))[n]
    strings = [data[i : i + n].tobytes() for i in range(len(name))]
    assert len(name) == len(data) - n + 1
    assert len(set(zip(strings, name.tolist()))) == len(set(strings)) == len(set(name.tolist()))


def test_blocks_are_named_in_little_memory():
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abcdefgh "), 20_000)) for _ in range(60)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "uid": list(range(60)), "check": pa.array(range(60), pa.int32())})
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in repeats._emit_blocks(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows > 10_000 and peak < 60 << 20


def test_numbers_of_rows_with_nulls_and_slices():
    column = pa.array([[1], [2, 3], None, [], [4]], pa.list_(pa.int64()))
    assert [x.tolist() for x in repeats._lists(column)] == [[1], [2, 3], [], [], [4]]
    assert [x.tolist() for x in repeats._lists(column.slice(1, 3))] == [[2, 3], [], []]


def test_exchanges_of_the_first_ranks_do_not_stay(spark, make):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    before = shuffled()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key)
    repeats.remove_repeats(spark, crafted(make))
    until = time.time() + 10
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before and spark.conf.get(key) == setting
