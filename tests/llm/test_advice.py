"""Cases that a review found cut: each fails on the code before its fix."""

import re
from collections import defaultdict

import corpus_pipeline
from stratalake.llm import fingerprints, licenses, mixing, personal_data, queries

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_mix_takes_sources_without_a_remainder_whole(spark, sf_dir):
    sizes = {"a": [5, 5], "b": [10] * 4, "c": [10] * 6, "e": [0, 0]}
    flat = [(s, n) for s, own in sizes.items() for n in own]
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(n)) if n else None, "en", s, 0) for i, (s, n) in enumerate(flat)]
    docs = spark.createDataFrame(rows, DOC)
    got = mixing.mix(docs, weights={"a": 5, "b": 1, "c": 1, "e": 1}, keep=True).collect()
    own = defaultdict(list)
    for r in got:
        assert r.taken == r.copies * r["size"]
        own[r.source].append(r.copies)
    # a stops at its cap of 3, b's target is its size, c's 40 of 60 words, and e has no words
    assert own["a"] == [3, 3] and own["b"] == [1] * 4 and sorted(own["c"]) == [0, 0, 1, 1, 1, 1] and own["e"] == [0, 0]
    assert sum(r.taken for r in got) == sum(r["size"] for r in got) == 110
    kept = corpus_pipeline.mix_stage(spark, docs, sf_dir).collect()
    assert [r.copies for r in kept if r.source == "a"] == [3, 3]
    assert not [r for r in kept if r.source == "e"]
    assert abs(sum(r.taken for r in kept) - 110) <= 10


def test_personal_data_filter_skips_no_match(spark, monkeypatch):
    places = ["jane.doe{at}example{dot}com", "jane at\nexample.com", "jane\tat\texample.org", "jane.doe [AT] example (dot) org", "jane(at)example.net", "dead::beef", "fe80::", "ab:cd:ef:ab:cd:ef:ab:cd"]
    texts = [f"please write to {p} for more" for p in places]
    held = [personal_data._found(t) for t in texts]
    assert all(more for _, more, _ in held)
    never = re.compile("")
    open_ = tuple(personal_data._matches(p, never) for p in (personal_data.WIDE_EMAIL, personal_data.WIDE_CARD, personal_data.WIDE_PHONE))
    monkeypatch.setattr(personal_data, "WIDE", (open_[0], personal_data._ipv6, *open_[1:], personal_data._secrets))
    monkeypatch.setattr(personal_data, "COLON", never)
    monkeypatch.setattr(personal_data, "DIGIT", never)
    assert held == [personal_data._found(t) for t in texts]
    monkeypatch.undo()
    rows = [(i, t.replace("please", "please, contact:")) for i, t in enumerate(texts[:1] * 30)]
    out = personal_data.mask(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all("[EMAIL]" in r.text and "doe" not in r.text for r in out)


def test_personal_data_finds_compressed_ipv6(spark):
    good = ["2001:db8::1", "2001:DB8:0:0:8:800:200C:417A", "fe80::1ff:fe23:4567:890a", "2001:db8::", "fd00:1:2:3:4:5:6::"]
    for a in good + ["::1", "::ffff:1"]:
        for around in ("server {} is down", "server {}: down", "addr:{} up", "{}.", "[{}]:80", "({})") if not a.startswith(":") else ("server {} is down", "({})"):
            text = around.format(a)
            assert [text[i:j] for k, (i, j), _ in personal_data._found(text)[1] if k == 1] == [a], text
    for bad in ("a :: b", "std::vector", "Ada::Text", "1:2:3:4::5:6:7:8", "1::2::3", "x::1", "12:30:45", "::"):
        assert not [1 for k, _, _ in personal_data._found(bad)[1] if k == 1], bad
    rows = [(i, f"the server {a} is down") for i, a in enumerate(good)]
    for r in personal_data.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.spans == f"ip:11:{11 + len(good[r.doc_id])}" and r.n_added == 1


def five_words(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_fingerprints_estimate_similarity_at_every_length(spark):
    big = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text").collect()}
    ids = sorted(texts)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    seen = defaultdict(int)
    for r in queries.op9_fingerprints(spark, big).collect():
        a, b = five_words(texts[r.doc_id]), five_words(fingerprints.edited(texts[r.doc_id], texts[after[r.doc_id]]))
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r.near_edited - true) <= 0.05, (len(a), r.near_edited, true)
        for bound in (8, 20, 60, 200, 10**9):
            if len(a) < bound:
                seen[bound] += 1
                break
        x, y = fingerprints.read(r.fingerprint), fingerprints.read(r.edited_fingerprint)
        assert abs(fingerprints.likeness(x, y) - true) <= 0.05
    assert len(seen) == 5


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
ISC = """Copyright (c) 2020 Someone. All rights reserved.

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies."""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version."""


def test_licenses_of_full_texts_wrapped_headers_spdx_and_embedded_sentences(spark):
    filler = " ".join(f"word{i}" for i in range(40))
    planted = {
        "MIT": ["MIT License\n\nCopyright (c) 2020 Someone\n\n" + MIT, MIT, "// SPDX-License-Identifier: MIT\n" + filler, "Released under\nthe MIT License.", f"{filler} Released under the MIT License. {filler}", "SPDX-License-Identifier: (Unknown-1 OR MIT)"],
        "ISC": [ISC],
        "GPL-3.0": [GPL + "\n" + filler, "# SPDX-License-Identifier: GPL-3.0-or-later"],
        "LGPL-3.0": [GPL.replace("GNU General", "GNU Lesser General")],
        "Apache-2.0": ["SPDX-License-Identifier: Apache-2.0", f"{filler} Licensed under the Apache License, Version 2.0. {filler}", filler + "\nLicensed under the\nApache License, Version 2.0."],
        "all-rights-reserved": ["Copyright 2020 Someone. All\nrights reserved."],
        None: [filler, "", None, "SPDX-License-Identifier: Unknown-1", "permission to enter was not given"],
    }
    cases = [(name, text) for name, texts in planted.items() for text in texts]
    rows = [(i, f"/d{i}", text) for i, (_, text) in enumerate(cases)] + [(1000 + i, "/prose", f"{filler} more{i}") for i in range(200)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, dir string, text string")).collect()}
    wrong = [(name, got[i].own_license, got[i].score, text) for i, (name, text) in enumerate(cases) if got[i].own_license != name]
    assert not wrong
    assert all(got[i].is_file for i, (_, text) in enumerate(cases) if text in (MIT, ISC))
