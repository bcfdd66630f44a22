"""One file per row, chains of references, content models and bounded manifests."""

import json
from itertools import product

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from faktorium.functions import text
from faktorium.operators import package
from faktorium.operators.chains import ancestors, find_roots
from faktorium.operators.content import Content, choice, optional, sequence
from faktorium.operators.corrections import correction_chains
from faktorium.plans.documents import created_at, records
from faktorium.sources import invoices
from faktorium.sources.named import NamedFileWriter, publish, write_named


def written(folder):
    return {p.name: p.read_text() for p in folder.iterdir() if p.is_file() and not p.name.startswith(".")}


def test_names_and_contents(spark, tmp_path):
    rows = [(3, "1/1", "c"), (1, "1/1", "a"), (2, "1/1~2", "b"), (4, "1-1", "d"), (5, "ż/2", None), (6, "1/1~2", "")]
    df = spark.createDataFrame(rows, "id long, number string, body string").repartition(4)
    assert write_named(df, str(tmp_path / "out"), text.document_file_name(F.col("number"), "txt"), "body", "id") == 6
    assert written(tmp_path / "out") == {
        "faktura-1-1.txt": "a", "faktura-1-1~2.txt": "c", "faktura-1-1~3.txt": "d", "faktura-1-1~2~1.txt": "b", "faktura-1-1~2~2.txt": "",
        "faktura-ż-2.txt": "",
    }
    assert write_named(df.limit(0), str(tmp_path / "out"), "number", "body", "id") == 0
    assert len(written(tmp_path / "out")) == 6 and not any((tmp_path / "out" / "_attempts").iterdir())


def test_lost_attempts_leave_nothing_visible(spark, tmp_path):
    writer = NamedFileWriter(str(tmp_path), "run")

    def failing():
        yield Row("a.txt", "half")
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        writer.write(failing())
    repeated = writer.write(iter([Row("a.txt", "whole"), Row("b.txt", "b")]))
    twice = writer.write(iter([Row("a.txt", "speculative")]))
    assert twice.files == 1 and written(tmp_path) == {}
    writer.commit([repeated, None])
    assert publish(spark, str(tmp_path), "run") == 2
    assert written(tmp_path) == {"a.txt": "whole", "b.txt": "b"}
    with pytest.raises(ValueError):
        writer.write(iter([Row("../x", "out of the folder")]))


def test_publishing_goes_on_where_it_stopped(spark, tmp_path):
    writer = NamedFileWriter(str(tmp_path), "run")
    attempt = writer.write(iter([Row("a.txt", "a"), Row("b.txt", "b")]))
    writer.commit([attempt])
    (tmp_path / "_attempts" / attempt.name / "0").rename(tmp_path / "a.txt")
    assert publish(spark, str(tmp_path), "run") == 2
    assert written(tmp_path) == {"a.txt": "a", "b.txt": "b"}


def test_invoice_documents(spark, tmp_path):
    rows = records(spark, "/root/testdata/sf0.001", False, True).where("invoice_id <= 20")
    assert invoices.write_invoice_documents(rows, str(tmp_path / "json"), "invoice_id") == rows.count()
    numbers = {r["number"] for r in rows.select("number").collect()}
    assert {json.loads(c)["number"] for c in written(tmp_path / "json").values()} == numbers
    count = invoices.write_fa_documents(rows, str(tmp_path / "xml"), "invoice_id", 2, created_at())
    parsed = invoices.read_fa_xml(spark, str(tmp_path / "xml"), 2)
    assert count == rows.count() and {r[0] for r in parsed.select("Fa.P_2").collect()} == numbers


def test_chains_and_circles(spark):
    links = [(i, i + 1) for i in range(1, 21)] + [(101, 102), (102, 103), (103, 101), (104, 101), (200, 1), (300, 300), (400, None), (None, 5)]
    found = {r["node"]: (r["root"], r["steps"], r["is_cycle"]) for r in find_roots(spark, spark.createDataFrame(links, "node long, to long"), "node", "to").collect()}
    expected = {i: (21, 21 - i, False) for i in range(1, 21)} | {200: (21, 21, False)} | {i: (None, None, True) for i in (101, 102, 103, 104, 300)}
    assert found == expected
    linked = spark.createDataFrame([(2, 1), (3, 2), (4, None), (5, 6), (6, 5)], "correction_id long, original_id long")
    chains = {r["correction_id"]: (r["root_id"], r["depth"], r["is_cycle"]) for r in correction_chains(spark, linked).collect()}
    assert chains == {2: (1, 1, False), 3: (1, 2, False), 4: (None, 0, False), 5: (None, None, True), 6: (None, None, True)}


def test_ancestors(spark):
    types = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "c")], "type string, base string")
    found = {(r["type"], r["ancestor"], r["steps"]) for r in ancestors(spark, types, "type", "base").collect()}
    chain = "abcde"
    assert found == {(chain[i], chain[j], j - i) for i in range(5) for j in range(i + 1, 5)} | {("x", "c", 1), ("x", "d", 2), ("x", "e", 3)}
    with pytest.raises(ValueError):
        ancestors(spark, spark.createDataFrame([("a", "b"), ("b", "a")], "type string, base string"), "type", "base")


def test_content_masks(spark):
    model = Content.of(choice(sequence("b", optional(choice("c", "d"))), sequence("e", "f.g")))
    forms = [{"b"}, {"b", "c"}, {"b", "d"}, {"e", "f.g"}]
    rows = []
    for n, present in enumerate(product([False, True], repeat=5)):
        chosen = {name for name, there in zip(("b", "c", "d", "e", "f.g"), present) if there}
        rows.append((n, *[name if name in chosen else None for name in "bcde"], ("y" if "f.g" in chosen else None,), chosen in forms))
    df = spark.createDataFrame(rows, "n int, b string, c string, d string, e string, f struct<g:string>, expected boolean")
    item = F.struct("b", "c", "d", "e", "f")
    assert df.where(model.fits(item) != F.col("expected")).count() == 0
    assert df.where(model.fits(item)).count() == 4


@pytest.mark.parametrize("fan_out", [2, 3, 10, 1000])
def test_manifest_of_any_length(spark, fan_out):
    rows = [("p", i, 10 * i, f"h{i}") for i in range(1, 24)] + [("q", 1, 5, "h")] + [("r", i, 1, "x") for i in (1, 2, 9)]
    parts = spark.createDataFrame(rows, "package_id string, part_no long, size_bytes long, sha256_b64 string")

    def root(numbers):
        level, reach = {i - 1: h for i, h in numbers.items()}, 1
        while True:
            nodes = {}
            for i in sorted(level):
                nodes.setdefault(i // fan_out, []).append(level[i])
            level, reach = {i: sha(hashes) for i, hashes in nodes.items()}, reach * fan_out
            if reach >= max(numbers):
                return level[0]

    def sha(hashes):
        import base64
        import hashlib

        return base64.b64encode(hashlib.sha256("".join(hashes).encode()).digest()).decode()

    found = {r["package_id"]: r["sha256_b64"] for r in package.package_manifest(parts, fan_out).collect()}
    assert found == {p: root({r[1]: r[3] for r in rows if r[0] == p}) for p in "pqr"}
    pieces = package.build_manifest(parts, fan_out=fan_out).orderBy("package_id", "piece_no").collect()
    for p in "pqr":
        request = json.loads("".join(r["request"] for r in pieces if r["package_id"] == p))
        assert [x["ordinalNumber"] for x in request["batchFile"]["fileParts"]] == [r[1] for r in rows if r[0] == p]
        assert request["batchFile"]["fileHash"] == found[p]
    assert max(r["request"].count("ordinalNumber") for r in pieces) <= fan_out
