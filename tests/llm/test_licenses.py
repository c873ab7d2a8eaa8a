"""The license scan against a sequential form of TF-IDF cosines and of the walk up the directories; long texts."""

import os
import re
import time
from collections import Counter
from math import log, sqrt

from stratalake.llm import licenses as li


def _words(text):
    return re.findall(r"[a-z0-9]+", text.lower())


class Plain:
    def __init__(self, texts):
        self.templates = li._named(None)
        own = [_words(t) for _, t, _ in self.templates]
        vocabulary = {w for t in own for w in t}
        held = Counter(w for t in texts for w in vocabulary & set(_words(t or "")))
        self.idf = {w: log((1 + len(texts)) / (1 + held[w])) + 1 for w in vocabulary}
        self.other = sum(self.idf[w] for w in sorted(vocabulary)) / len(vocabulary)
        self.own = own
        self.vectors = [self.vector(t) for t in own]

    def vector(self, terms):
        raw = {w: n * self.idf.get(w, self.other) for w, n in Counter(terms).items()}
        norm = sqrt(sum(x * x for x in raw.values()))
        return {w: x / norm for w, x in raw.items()}

    def best(self, terms):
        v = self.vector(terms)
        scores = [round(sum(x * v.get(w, 0) for w, x in t.items()), 6) for t in self.vectors]
        i = max(range(len(scores)), key=lambda i: (scores[i], -i))
        name, _, stands = self.templates[i]
        special = int(scores[i] >= li.THRESHOLD and name not in li.GENERAL)
        return special, scores[i], -i, name, max(len(terms), stands if scores[i] >= li.CLOSE else 0)

    def of(self, text):
        """(license, score, is_file) of a text."""
        if not text or not re.search(li.FILE_HINT, text):
            return None, 0.0, False
        found = []
        for line in text.split("\n"):
            if re.search(li.HINT, line):
                bag = _words(line)
                bags = [bag] if len(bag) <= li.WINDOW else [bag[i : i + li.WINDOW] for i in range(0, len(bag) - li.STRIDE, li.STRIDE)]
                found += [self.best(b) for b in bags if any(re.search(li.HINT_TERM, w) for w in b)]
        bag = _words(text)
        for own in self.own:
            for rare in sorted(set(own), key=lambda w: (-self.idf[w], w))[:2]:
                for before in (i for i, w in enumerate(own) if w == rare):
                    for at in (i for i, w in enumerate(bag) if w == rare):
                        if 0 <= at - before and at - before + len(own) <= len(bag):
                            b = self.best(bag[at - before : at - before + len(own)])
                            found += [b] if b[1] >= li.CLOSE else []
        names = [n for n, _, _ in self.templates]
        for line in re.findall(li.SPDX, text):
            ids = [re.sub(r"(\+|-only|-or-later)$", "", w) for w in re.findall(r"[a-z0-9.+-]+", line.lower())]
            known = [n for w in ids for n in names if n.lower() == w]
            found += [(1, 1.0, -names.index(known[0]), known[0], 4)] if known else []
        if not found:
            return None, 0.0, False
        _, score, _, name, n = max(found)
        return (name, score, n >= li.FILE_SHARE * len(bag)) if score >= li.THRESHOLD else (None, score, False)


def test_scan_equals_a_sequential_form(spark, sf_dir):
    rows = [(r.doc_id, f"/{r.source}/{r.doc_id % 7}/{r.doc_id % 3}", r.text) for r in spark.read.parquet(f"{os.path.dirname(sf_dir)}/sf0.01/documents.parquet").collect()]
    rows += [(-1, "/solo/a", "Released under the\nMIT License.\n"), (-2, "/solo/a/b/c", "no words of that kind"), (-3, "/solo", "SPDX-License-Identifier: (GPL-2.0-or-later OR MIT)"), (-4, None, None), (-5, "/", "")]
    plain = Plain([t for _, _, t in rows])
    own = {i: (d or "/", *plain.of(t)) for i, d, t in rows}
    stated = {}
    for d, name, score, is_file in own.values():
        if is_file:
            stated[d] = max(stated.get(d, (0.0, "")), (score, name))
    got = {r.doc_id: r for r in li.scan(spark.createDataFrame(rows, "doc_id long, dir string, text string")).collect()}
    assert len(got) == len(rows) and sum(o[1] is not None for o in own.values()) > 10
    for i, (d, name, score, is_file) in own.items():
        r = got[i]
        # sums in another order may differ in the sixth decimal
        assert (r.dir, r.own_license, r.is_file) == (d, name, is_file) and abs(r.score - score) < 2e-6, (i, r, own[i])
        above = d
        while name is None and above not in stated and above != "/":
            above = above.rsplit("/", 1)[0] or "/"
        takes = name is None and above in stated
        assert (r.license, r.inherited_from) == (stated[above][1] if takes else name, above if takes else None), (i, r)


def test_long_and_repetitive_texts_take_linear_time(spark):
    texts = ["Released under the MIT License.\n" * 30_000, "license " * 120_000, " ".join(f"licensed w{i}" for i in range(30_000)), "x" * 1_000_000 + " license"]
    start = time.time()
    got = {r.doc_id: r for r in li.scan(spark.createDataFrame([(i, "/", t) for i, t in enumerate(texts)], "doc_id long, dir string, text string")).collect()}
    assert time.time() - start < 100 and got[0].own_license == "MIT" and len(got) == 4
