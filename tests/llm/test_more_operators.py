"""Token files, toxicity, winnowing and license scans against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faktorium.llm import license_rules, licenses, token_files, tokens, toxicity, winnowing

# --- token files ----------------------------------------------------------------------------------------------------


def in_ascending_order(df):
    rows = df.collect()
    return sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))


@pytest.mark.parametrize("frame_ids", [50, 1 << 16])
def test_token_files_round_trip(spark, given, awkward, frame_ids):
    tokenizer = Tokenizer.from_file(tokens.default_path())
    for df in (given, awkward, given.limit(0)):
        manifest = token_files.write_files(spark, df, tokens.default_path(), frame_ids=frame_ids)
        found = token_files.checked(token_files.read_files(spark, manifest)).collect()
        expected, start = [], 0
        for r in in_ascending_order(df):
            ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]
            expected.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert Counter(map(tuple, found)) == Counter(expected)


def test_reader_opens_only_the_frames_asked_for(tmp_path):
    path = tmp_path / "x.ids"
    content = {i: np.arange(i * 7, dtype="<u4").tobytes() for i in range(60)}
    with path.open("wb") as sink:
        writer = token_files.TokenFileWriter(sink, frame_ids=100)
        for name, ids in content.items():
            writer.add(name, ids)
        writer.close(pa.int64())
    with path.open("rb") as source:
        reader = token_files.TokenFileReader(source, path.stat().st_size)
        assert reader.document(3) == content[3] and reader.frames_read == 1
        assert reader.document(59) == content[59] and reader.frames_read <= 1 + 6
        assert all(reader.document(i) == content[i] for i in content)
    # Any zstandard reader reads the ids: skippable frames are skipped.
    with path.open("rb") as source:
        plain = zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True).read()
    assert plain == b"".join(content.values())


def test_reader_finds_damage(tmp_path):
    path = tmp_path / "x.ids"
    with path.open("wb") as sink:
        writer = token_files.TokenFileWriter(sink)
        writer.add(1, bytes(4000))
        writer.close(pa.int64())
    data = bytearray(path.read_bytes())
    reader = token_files.TokenFileReader(path.open("rb"), len(data))
    reader.sums[0] += 1
    with pytest.raises(ValueError):
        reader.document(0)


def test_reading_wanted_documents_only(spark, given):
    manifest = token_files.write_files(spark, given, tokens.default_path())
    assert {r["doc_id"] for r in token_files.read_files(spark, manifest, wanted=[3, 77]).collect()} == {3, 77}


# --- toxicity -------------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1/"
    df, labels = spark.read.parquet(folder + "documents.parquet"), spark.read.parquet(folder + "labels.parquet")
    model = toxicity.fit(df, labels)
    assert 0 < len(model.buckets) < (1 << toxicity.BUCKET_BITS) / 4
    held = df.where(toxicity.is_held_out(F.col("doc_id")))
    rows = toxicity.predict(spark, model, held).join(labels, "doc_id").collect()
    predicted = [r["score"] >= toxicity.THRESHOLD for r in rows]
    truth = [r["toxic"] == 1 for r in rows]
    hits = sum(p and t for p, t in zip(predicted, truth))
    # About a sixth of the given labels don't follow from any word of the text.
    assert hits / sum(truth) > 0.75 and hits / sum(predicted) > 0.9


def test_toxicity_features_are_words_pairs_and_skip_pairs():
    def count(text):
        return Counter(toxicity.gram_buckets(pa.array(text))[1].tolist())

    assert count(["One two, three four", None, "", "x"]) == {0: 4 + 3 + 2, 3: 1}
    same = toxicity.gram_buckets(pa.array(["a b c", "A-b C"]))
    assert set(same[0][same[1] == 0].tolist()) == set(same[0][same[1] == 1].tolist())


def test_toxicity_edge_cases(spark, awkward):
    nothing = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(awkward, nothing)
    assert {r["score"] for r in toxicity.predict(spark, model, awkward).collect()} == {0.5}
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(9)] + [(2, 0)], "doc_id long, toxic int")
    model = toxicity.fit(awkward, labels)
    rows = toxicity.predict(spark, model, awkward).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.predict(spark, model, awkward.limit(0)).count() == 0


def test_ftrl_matches_a_plain_loop():
    rng = np.random.default_rng(1)
    model = toxicity.Ftrl(32)
    z, n = [0.0] * 33, [0.0] * 33
    for _ in range(200):
        at, label = sorted(set(rng.integers(0, 32, 5).tolist())), int(rng.integers(0, 2))
        model.update(np.array(at), label)
        w = {}
        for i in [*at, 32]:
            l1 = toxicity.L1 if i < 32 else 0.0
            sign = float(np.sign(z[i]))
            w[i] = 0.0 if abs(z[i]) <= l1 else -(z[i] - sign * l1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)
        p = 1 / (1 + np.exp(-sum(w.values())))
        for i, wi in w.items():
            g = p - label
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * wi
            n[i] += g * g
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


# --- winnowing ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("gram,span", [(3, 4), (5, 7), (12, 48)])
def test_winnowing_against_a_plain_version(gram, span):
    rng = np.random.default_rng(gram)
    for n in [0, 1, 2, 3, 10, 60, 61, 400]:
        text = "".join(rng.choice(list("abé\U0001f600"), n))
        positions, hashes = winnowing.fingerprint(text, gram, span)
        g = min(gram, n)
        values = [int(winnowing._gram_hashes(np.array([ord(c) for c in text[i : i + g]], np.uint32), g)[0]) for i in range(n - g + 1)] if n else []
        expected = set()
        for s in range(max(1, len(values) - span + 1) if values else 0):
            window = values[s : s + span]
            least = min(window)
            expected.add(s + max(i for i, v in enumerate(window) if v == least))
        assert positions.tolist() == sorted(expected)
        assert hashes.tolist() == [values[i] for i in sorted(expected)]


def test_shared_passages_are_always_found():
    rng = np.random.default_rng(9)
    letters = list("abcdefgh ")
    passage = "".join(rng.choice(letters, winnowing.GRAM + winnowing.SPAN - 1))
    for _ in range(50):
        a, b = ("".join(rng.choice(letters, 300)) for _ in range(2))
        one, two = winnowing.fingerprint(a[:100] + passage + a[100:]), winnowing.fingerprint(b[:7] + passage + b[7:])
        assert set(one[1].tolist()) & set(two[1].tolist())


def test_next_documents_and_edited_texts(spark, given, awkward, make):
    one = make([(1, "alone", "en", "a", 5)])
    for df in (given, given.repartition(5), awkward, one, given.limit(0)):
        rows = sorted(df.collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["text"] or ""))
        texts = [r["text"] or "" for r in rows]
        expected = Counter()
        for i, (r, own) in enumerate(zip(rows, texts)):
            following = texts[(i + 1) % len(texts)]
            third = len(own) // 3
            changed = own[: len(own) - third] + following[:third]
            a, b, c = (winnowing.fingerprint(t) for t in (own, changed, following))
            expected[
                (
                    r["doc_id"], len(own), hashlib.sha256(changed.encode()).hexdigest(), winnowing.as_text(a),
                    winnowing.as_text(b), winnowing.likeness(a, b), winnowing.likeness(a, c),
                )
            ] += 1
        assert Counter(map(tuple, winnowing.against_next(spark, df).collect())) == expected


def test_short_documents_are_closer_to_their_edited_text_than_to_the_next(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.length("text").between(29, 300))
    rows = winnowing.against_next(spark, df).where("near_next < 1").collect()
    assert sum(r["n_chars"] < 60 for r in rows) > 50 and sum(60 <= r["n_chars"] < 120 for r in rows) > 50
    assert [r for r in rows if r["near_edited"] <= r["near_next"]] == []


# --- licenses -------------------------------------------------------------------------------------------------------

LICENSE_TEXTS = [
    "Released under the MIT License, under the MIT license.", "Licensed under the Apache License, Version 2.0 (the License)",
    "This work is licensed under CC BY-NC 4.0.", "cc by nc cc BY nc", "SPDX-License-Identifier: GPL-3.0-or-later",
    "GNU General Public License version 3", "distributed under the terms of the GNU Lesser General Public License v2.1",
    "All rights reserved.", "mit und der MIT LICENSE", "under the mit", "xunder the mit license", "", None,
    "under the mit licenseé", "boost your python with json", "0 under\n\nthe\tmit-license 1", "CC0 1.0 Universal",
    "licensed under the mit license " * 40, "placed in the public domain",
]


def plain_base(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = []
    for phrase, label in license_rules.BASE_PHRASES:
        parts = phrase.split(" ")
        places += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    return words, sorted(places)


def plain_scan(text):
    """Labels of all rules with suppression, without any prefilter."""
    words, base = plain_base(text)
    normal, found = " " + " ".join(words) + " ", []
    for number, rule in enumerate(license_rules.RULES):
        for m in re.finditer(f"(?<= )({rule.pattern})(?= )", normal):
            start = normal[: m.start()].count(" ") - 1
            found.append((start, -(start + m[0].count(" ") + 1), -rule.priority, number, rule.label))
    kept = []
    for item in sorted(found):
        if not any(k[1] <= item[1] and k[2] <= item[2] for k in kept):
            kept.append(item)
    names = {k[-1] for k in kept}
    return [k for k in kept if k[-1] not in license_rules.FAMILY_NAMES or not any(n.startswith(k[-1] + "-") for n in names)]


def test_license_scan(spark, given, awkward, make):
    clash = make([(i, t, "en", "s", 0) for i, t in enumerate(LICENSE_TEXTS)]).withColumn("license_words", F.lit("x"))
    for df in (clash, awkward, given, given.limit(0)):
        rows = {(r["doc_id"], r["text"]): r for r in df.collect()}
        found = licenses.scan(df.drop("license_words"))
        for r in found.collect():
            words, base = plain_base(r["text"])
            assert r["license_words"] == len(words)
            assert sorted((p["start"], p["label"]) for p in r["license_base"]) == base
            kept = [(d["start"], d["before_end"], d["before_priority"], d["rule"], d["label"]) for d in r["license_found"]]
            assert kept == plain_scan(r["text"]), r["text"][:80]
        for r in licenses.summarise(found).collect():
            texts = [t for i, t in rows if i == r["doc_id"]]
            options = []
            for t in texts:
                words, base = plain_base(t)
                own = {label for _, label in base}
                every = sorted(own | {k[-1] for k in plain_scan(t)})
                options.append((len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(own)), ",".join(every)))
            assert tuple(r)[1:7] in options and 0 <= r["score"] <= 1


def test_every_rule_passes_the_gate_and_has_its_keyword():
    assert len(license_rules.RULES) > 300
    for rule in license_rules.RULES:
        text = re.sub(r"\[cs\]", "s", license_rules.required(rule.pattern.replace(license_rules.LICENCE, " license ")))
        assert any(g in text for g in license_rules.GATES) or ("cc" in text and "by" in text), rule
        assert rule.keyword in text or rule.keyword == "license", rule


_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
NOTICES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
    "bsd-2": _BSD + "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS",
    "bsd-3": _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
             "products derived from this software without specific prior written permission.",
    "apache-2": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS.""",
    "gpl-3": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. You should have
received a copy of the GNU General Public License along with this program.""",
    "gpl-2": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "lgpl-2": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "agpl-3": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
License as published by the Free Software Foundation, either version 3 of the License.""",
    "mpl-2": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
           "that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
                 "sell, or distribute this software.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
            "damages arising from the use of this software. Permission is granted to anyone. The origin of this software must not be "
            "misrepresented; you must not claim that you wrote the original software.",
}


def test_license_texts_have_exactly_their_label(spark, make):
    assert len(license_rules.TEXTS) > 90 and len(license_rules.RULES) > 550
    rows = [(i, text, "en", "s", 0) for i, text in enumerate(NOTICES.values())]
    found = licenses.summarise(licenses.scan(make(rows))).collect()
    assert {r["doc_id"]: r["labels"] for r in found} == dict(enumerate(NOTICES))


def test_own_labels():
    def found(text):
        return {k[-1] for k in plain_scan(text)}

    assert found("SPDX-License-Identifier: GPL-3.0-or-later") == {"gpl-3"}
    assert found("distributed under the terms of the GNU Lesser General Public License version 2.1") == {"lgpl-2"}
    assert found("placed in the public domain") == {"public-domain"}
    assert not found("boost your python with json and a commit")
