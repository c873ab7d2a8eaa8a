"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

A unit is a line of a file that mentions licensing (HINT), cut into overlapping windows where it is
long; or a window as long as a template, across line breaks, laid at each place of one of the
template's two rarest terms, and kept from CLOSE on.  Full licence texts and headers are known by passages (PASSAGES) that
only they have; `SPDX-License-Identifier` lines by their identifier.  Units and templates are bags of terms weighed by term frequency and inverse document frequency;
the document frequencies are counted over all files.  A file's own licence is the template of highest
cosine among its units, from THRESHOLD on; one of GENERAL only where there is no other.  A file of whose words the winning unit,
or the text that its passage stands for, makes up FILE_SHARE or more is a licence file and speaks for its directory.  Every file without a licence of its own takes
that of the nearest directory above it, found by joining the distinct directories' ancestors with the
directories that have a licence.

All steps are DataFrame functions.  Templates are a configuration: at most TEMPLATES texts and TERMS
terms, checked; their weights are literals of the plan, so scoring needs no shuffle and no hot term
or line gathers in one task.  Directories are aggregated before they are joined.

Defined results: null and empty texts have no units; repeated rows are kept one for one; among equal
scores the first template in order of names wins; of an SPDX expression the first known identifier counts; a null directory is the root `/`; an empty table gives
an empty result; terms that no template has weigh as the mean template term.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from math import log
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, pick

TEMPLATES, TERMS = 200, 5000
THRESHOLD = 0.7
FILE_SHARE = 0.2
WINDOW, STRIDE = 24, 12
CLOSE = 0.9
HINT = r"(?i)licen[cs]|copyright|spdx|public\s+domain|rights\s+reserved"
#: Files that are scanned; lines are still those of HINT, as a wrapped sentence may leave a line without its word.
FILE_HINT = HINT + r"|permission|redistribut|reserved|creative\s+commons|cc\W+by"
#: At least one is in every text that FILE_HINT matches.
HINT_WORDS = ("licen", "copyright", "spdx", "public", "reserved", "permission", "redistribut", "creative", "cc")
SPDX = r"(?i)spdx-license-identifier\s*:((?:[ \t(]*[a-z0-9.+-]+\)*)+)"
GENERAL = frozenset({"all-rights-reserved"})
HINT_TERM = r"^(licen[cs]|copyright|spdx|domain|reserved)"
#: Short forms of common licences, as headers state them.
HEADERS = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, all copyright is waived and the work is in the public domain under CC0 1.0.",
    "GPL-2.0": "This program is free software under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify and distribute this software is granted under the ISC License.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "all-rights-reserved": "All rights reserved.",
}
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation; either version {1} of the License, or (at your option) any later version."
#: A licence, a passage of its text or header, and the terms of the text that the passage stands for (0: itself).
PASSAGES = (
    ("AGPL-3.0", _GNU.format("Affero General Public License", 3), 90),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation", 5600),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", 80),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", 1600),
    ("BSD-3-Clause", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", 220),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal", 1000),
    ("GPL-2.0", _GNU.format("General Public License", 2), 110),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation", 2900),
    ("GPL-3.0", _GNU.format("General Public License", 3), 110),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation", 5600),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", 115),
    ("LGPL-2.1", _GNU.format("Lesser General Public License", "2.1"), 110),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation", 4300),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", 3), 110),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation", 1150),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", 160),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file", 0),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity", 2700),
)


def _named(templates: dict[str, str] | None) -> list[tuple[str, str, int]]:
    """Name, text and least terms of every template, in order of names; by default those of HEADERS and PASSAGES."""
    own = [(name, text, 0) for name, text in (HEADERS if templates is None else templates).items()]
    return sorted(own + list(PASSAGES if templates is None else ()), key=lambda t: t[0])


def _terms(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def document_frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of files, and of those that hold each term of the vocabulary; partial counts are made before the shuffle."""
    held = F.array_intersect(F.split(F.lower("text"), r"[^a-z0-9]+"), F.array(*map(F.lit, vocabulary)))
    rows = files.select(F.explode(F.array_append(F.coalesce(held, F.array().cast("array<string>")), "")).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()  # at most TERMS + 1 rows
    counts = {r["term"]: r["n"] for r in rows}
    return counts.pop("", 0), counts


def weights(files: DataFrame, templates: list[tuple[str, str, int]]) -> tuple[dict[str, float], float, list[dict[str, float]]]:
    """Inverse document frequencies, that of terms outside the templates, and the templates' unit vectors."""
    vocabulary = sorted({t for _, text, _ in templates for t in _terms(text)})
    if len(templates) > TEMPLATES or len(vocabulary) > TERMS:
        raise ValueError(f"over {TEMPLATES} templates or {TERMS} terms")
    total, counts = document_frequencies(files, vocabulary)
    idf = {t: log((1 + total) / (1 + counts.get(t, 0))) + 1 for t in vocabulary}
    vectors = []
    for _, text, _ in templates:
        terms = _terms(text)
        raw = {t: terms.count(t) * idf[t] for t in sorted(set(terms))}
        norm = sum(w * w for w in raw.values()) ** 0.5
        vectors.append({t: w / norm for t, w in raw.items()})
    return idf, sum(idf.values()) / len(idf), vectors


def mentions(text: Column) -> Column:
    """Whether FILE_HINT is in a text; the pattern is slow, so it's tried only where a plain word of it (HINT_WORDS) is."""
    low = F.lower(text)
    return reduce(Column.__or__, (low.contains(w) for w in HINT_WORDS)) & text.rlike(FILE_HINT)


def units(text: Column) -> Column:
    """Arrays of terms: every line that mentions licensing, long ones in windows."""
    lines = F.filter(F.array_distinct(F.split(text, "\n")), lambda line: line.rlike(HINT))
    bags = F.transform(lines, lambda line: F.regexp_extract_all(F.lower(line), F.lit("[a-z0-9]+"), F.lit(0)))
    cutting = F.transform(bags, lambda bag: F.when(F.size(bag) <= WINDOW, F.array(bag)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(bag) - STRIDE, F.lit(1)), F.lit(STRIDE)), lambda i: F.slice(bag, i, WINDOW))))
    return F.filter(F.flatten(cutting), lambda bag: F.exists(bag, lambda t: t.rlike(HINT_TERM)))


def windows(text: Column, templates: list[tuple[str, str, int]], idf: dict[str, float]) -> Column:
    """Arrays of terms: windows as long as each template, where one of its two rarest terms stands as it does in the template."""
    laid: dict[str, set[tuple[int, int]]] = {}
    for _, own, _ in templates:
        terms = _terms(own)
        for t in sorted(set(terms), key=lambda t: (-idf[t], t))[:2]:
            laid.setdefault(t, set()).update((i, len(terms)) for i, u in enumerate(terms) if u == t)
    at = _lookup({t: F.array(*(F.struct(F.lit(i).alias("before"), F.lit(n).alias("n")) for i, n in sorted(places))) for t, places in sorted(laid.items())})
    longest = max(n for places in laid.values() for _, n in places) + 1
    bag = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))

    def cuts(bag: Column) -> Column:
        found = F.filter(F.transform(bag, lambda t, i: F.struct(i.alias("i"), at(t).alias("places"))), lambda x: x["places"].isNotNull())
        # a window is one number, and later one text, as only plain values are told apart by hashing
        spans = F.flatten(F.transform(found, lambda x: F.transform(F.filter(x["places"], lambda p: (x["i"] >= p["before"]) & (x["i"] - p["before"] + p["n"] <= F.size(bag))), lambda p: (x["i"] - p["before"]).cast("long") * longest + p["n"])))
        return F.transform(F.array_distinct(spans), lambda s: F.array_join(F.slice(bag, F.floor(s / longest).cast("int") + 1, (s % longest).cast("int")), " "))

    return F.transform(F.array_distinct(_once(bag, cuts)), lambda window: F.split(window, " "))


def declared(text: Column, names: list[str]) -> Column:
    """Structs as of `best` for the known identifiers of SPDX lines, the first of each line."""
    known = {n.lower() + end: i for i, n in reversed(list(enumerate(names))) for end in ("", "+", "-only", "-or-later")}
    at, name = _lookup({k: F.lit(i) for k, i in sorted(known.items())}), F.array(*map(F.lit, names))
    lines = F.regexp_extract_all(text, F.lit(SPDX), F.lit(1))
    first = F.transform(lines, lambda line: F.try_element_at(F.filter(F.transform(F.regexp_extract_all(F.lower(line), F.lit("[a-z0-9.+-]+"), F.lit(0)), at), lambda i: i.isNotNull()), F.lit(1)))
    return F.transform(F.filter(first, lambda i: i.isNotNull()), lambda i: F.struct(F.lit(1).alias("special"), F.lit(1.0).alias("score"), (-i).alias("order"), F.element_at(name, i + 1).alias("template"), F.lit(4).alias("n_terms")))


def _lookup(rows: dict[str, Column]) -> Callable[[Column], Column]:
    """Value of a term, or null: literal maps of a few terms each, picked by the term's checksum, as a lookup in a map reads all of it."""
    size = 2 * len(rows)
    maps: list[dict[str, Column]] = [{} for _ in range(size)]
    for term, value in rows.items():
        maps[crc32(term.encode()) % size][term] = value
    blank = {"": next(iter(rows.values()))}  # no term is empty
    table = F.array(*(F.create_map(*[x for term, value in (m or blank).items() for x in (F.lit(term), value)]) for m in maps))
    return lambda term: F.try_element_at(F.element_at(table, (F.crc32(term) % size).cast("int") + 1), term)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, as the only element of an array; a column used twice inside a lambda is computed twice."""
    return F.element_at(F.transform(F.array(value), use), 1)


def best(bag: Column, idf: dict[str, float], other: float, vectors: list[dict[str, float]], templates: list[tuple[str, str, int]]) -> Column:
    """Struct of the highest cosine of a bag of terms with a template (6 decimals), the template and the size of the bag or of what it stands for."""
    names = [name for name, _, _ in templates]
    own = _lookup({t: F.lit(w) for t, w in idf.items()})
    toward = _lookup({t: F.expr("array(" + ", ".join(f"{v.get(t, 0.0) * w!r}D" for v in vectors) + ")") for t, w in idf.items()})
    # equal terms stand together after sorting, so one pass gives the squared norm
    zero = F.struct(F.lit("").alias("term"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def step(s: Column, x: Column) -> Column:
        before = F.when(x["term"] == s["term"], s["run"]).otherwise(0.0)
        return F.struct(x["term"].alias("term"), (before + x["w"]).alias("run"), (s["sum"] + (2 * before + x["w"]) * x["w"]).alias("sum"))

    weighed = F.transform(F.sort_array(bag), lambda t: F.struct(t.alias("term"), F.coalesce(own(t), F.lit(other)).alias("w")))
    norm = F.sqrt(F.aggregate(weighed, zero, step, lambda s: s["sum"]))
    known = F.filter(F.transform(bag, toward), lambda row: row.isNotNull())
    dots = F.aggregate(known, F.array_repeat(F.lit(0.0), len(names)), lambda s, row: F.zip_with(s, row, lambda x, y: x + y))
    top = _once(norm, lambda norm: F.array_max(F.transform(dots, lambda d, i: F.struct(F.round(d / norm, 6).alias("score"), (-i).alias("order")))))

    def told(top: Column) -> Column:
        template = F.element_at(F.array(*map(F.lit, names)), 1 - top["order"])
        # what a passage stands for counts only where the passage itself is there
        stands = F.when(top["score"] >= CLOSE, F.element_at(F.array(*(F.lit(n) for _, _, n in templates)), 1 - top["order"])).otherwise(0)
        special = ((top["score"] >= THRESHOLD) & ~template.isin(*GENERAL)).cast("int")
        return F.struct(special.alias("special"), top["score"].alias("score"), top["order"].alias("order"), template.alias("template"), F.greatest(F.size(bag), stands).alias("n_terms"))

    return _once(top, told)


def own_licenses(files: DataFrame, templates: list[tuple[str, str, int]]) -> DataFrame:
    """(doc_id, dir, own_license, score, is_file) of every row of (doc_id, dir, text)."""
    idf, other, vectors = weights(files, templates)
    text = F.col("text")
    lines = F.transform(units(text), lambda bag: best(bag, idf, other, vectors, templates))
    near = F.filter(F.transform(windows(text, templates, idf), lambda bag: best(bag, idf, other, vectors, templates)), lambda x: x["score"] >= CLOSE)
    best_unit = F.array_max(F.concat(lines, near, declared(text, [name for name, _, _ in templates])))
    terms = F.size(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))
    found = F.when(mentions(text), F.struct(best_unit.alias("best"), terms.alias("terms")))
    scored = files.select("doc_id", F.coalesce("dir", F.lit("/")).alias("dir"), found.alias("found")).select("doc_id", "dir", "found.best", "found.terms")
    sure = F.col("best.score") >= THRESHOLD
    return scored.select(
        "doc_id",
        "dir",
        F.when(sure, F.col("best.template")).alias("own_license"),
        F.coalesce("best.score", F.lit(0.0)).alias("score"),
        F.coalesce(sure & (F.col("best.n_terms") >= FILE_SHARE * F.col("terms")), F.lit(False)).alias("is_file"),
    )


def scan(files: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, dir, own_license, score, is_file, license, inherited_from) of every row of (doc_id, dir, text)."""
    own = cut(own_licenses(pick(files, doc_id="long", dir="string", text="string"), _named(templates or None)))
    stated = own.filter("is_file").groupBy("dir").agg(F.max(F.struct("score", "own_license")).alias("best")).select(F.col("dir").alias("above"), F.col("best.own_license").alias("stated"))
    steps = F.split("dir", "/")  # "/a/b" has the ancestors "/a/b", "/a" and "/"
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.struct(F.concat_ws("/", F.slice(steps, 1, n)).alias("above"), n.alias("depth")))
    near = own.groupBy("dir").agg(F.lit(1).alias("one")).select("dir", F.explode(above).alias("a")).select("dir", F.when(F.col("a.above") == "", "/").otherwise(F.col("a.above")).alias("above"), F.col("a.depth").alias("depth"))
    near = near.join(stated, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "stated")).alias("near"))
    out = own.join(near, "dir", "left")
    takes = F.col("own_license").isNull()
    return out.select("doc_id", "dir", "own_license", "score", "is_file", F.coalesce("own_license", F.col("near.stated")).alias("license"), F.when(takes, F.col("near.above")).alias("inherited_from"))


def sharded_dir(id_col: Column, source: Column) -> Column:
    """Directory of a document in a tree of its source and its id's leading digits: 12345 of s lies in /s/1/2/3/4."""
    digits = id_col.cast("string")
    return F.concat_ws("/", F.lit(""), F.coalesce(source, F.lit("none")), F.when(F.length(digits) > 1, F.concat_ws("/", F.split(F.substring(digits, 1, F.length(digits) - 1), ""))))
