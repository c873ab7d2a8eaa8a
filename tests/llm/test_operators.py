"""The ten operators against brute force, planted cases and broken rows."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratalake.llm import decontaminate, fingerprints, html_text, licenses, mixing, near_dedup, personal_data, quality, queries, token_counts, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def prose(n, start=0):
    return " ".join(f"w{(i * i + start) % 9973}x{i}" for i in range(start, start + n))


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def by_brute_force(texts, percent):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_near_dedup_matches_brute_force(spark, sf_dir, texts):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op5_near_dedup(spark, sf_dir).collect()}
    assert found == by_brute_force(texts, 85)


def test_near_dedup_of_a_large_group_of_copies(spark):
    base = prose(60).split()
    rows = {i: " ".join([*base[:-1], f"end{i}"]) for i in range(300)} | {1000 + i: prose(50, 5000 * (i + 1)) for i in range(20)}
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_dedup.classes(frame, 85).collect()}
    assert found == {i: 0 if i < 300 else i for i in rows}


def test_near_dedup_of_a_large_group_of_edits(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 24)
    base, rng = prose(120).split(), random.Random(7)
    rows = {}
    for i in range(260):
        own = list(base)
        for _ in range(rng.choice([1, 2, 4, 6, 9])):
            own[rng.randrange(len(own))] = f"e{rng.randrange(40)}"
        rows[i] = " ".join(own)
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.classes(frame, 85).collect()}
    assert found == by_brute_force(rows, 85)
    assert 2 < len({c for _, c in found.values()}) < 260


def test_token_counts_match_the_library(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op2_token_counts(spark, sf_dir).collect()}
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    assert found == {i: (len(t.encode()), want[i], want[i] > 1024) for i, t in texts.items()}


def base_spans(text):
    def luhn(d):
        return sum((x * 2 - 9 if x * 2 > 9 else x * 2) if k % 2 else x for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = [("email", m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.span()))
    out += [("phone", m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def test_personal_data_base_matches_brute_force(spark, sf_dir, texts):
    for r in queries.op4_personal_data(spark, sf_dir).collect():
        base = [f"{k}:{a}:{b}" for k, (a, b) in base_spans(texts[r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(base) <= set(spans)


def test_mix_respects_targets_and_repetition(spark, sf_dir, texts):
    rows = queries.op8_mix_sources(spark, sf_dir).collect()
    assert {r.doc_id: r["size"] for r in rows} == {i: len(WORD.findall(t)) for i, t in texts.items()}
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    groups = defaultdict(list)
    for r in rows:
        groups[r.source_size, r.target].append(r)
    for (size, target), own in groups.items():
        assert target <= 3 * size * (1 + 1e-9)
        assert abs(sum(r.taken for r in own) - target) <= max(r["size"] for r in own)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op8_mix_sources(spark, sf_dir).collect()))


def test_fingerprints_edit_and_likeness(spark, sf_dir, texts):
    ids = sorted(texts)
    same = {}
    for r in queries.op9_fingerprints(spark, sf_dir).collect():
        t, nxt = texts[r.doc_id], texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        n = len(t) // 4
        edited = t[: len(t) - n] + nxt[:n]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert same.setdefault(t, r.fingerprint) == r.fingerprint


def test_quality_beats_the_majority_on_held_out_rows(spark, sf_dir):
    big = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    scored = queries.op7_quality_classifier(spark, big).join(labels.select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    good = [r.score for r in scored if r.quality == 1]
    bad = [r.score for r in scored if r.quality == 0]
    area = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert area > 0.7
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in scored)


def test_decontamination_finds_reordered_passages(spark):
    passage = prose(60, 100)
    w = passage.split()
    moved = prose(30) + " " + " ".join(w[40:]) + " " + prose(9, 700) + " " + " ".join(w[:40])
    rows = [(1, moved), (2, prose(300, 3000)), (3, passage.upper()), (4, None), (5, "")]
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, passage), (10, None)], "item_id long, text string")).collect()}
    assert found == {(1, 9), (3, 9)}


def test_urls_follow_rules_and_lists(spark):
    urls = [(1, "http://A.Example.Net/en/x?q"), (2, "http://a.example.net/de"), (3, "http://x.org/fr/y"), (4, None), (5, "no-host"), (6, "ftp://example.com/de/#f")]
    frame = spark.createDataFrame(urls, "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(frame, url_filter.entries(spark)).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("a.example.net", "/de", "net/", "block")
    assert got[3][2:] == ("org/fr/", "allow")
    assert got[4][:3] == ("", "", None) and got[5][:3] == ("", "", None)
    assert got[6] == ("example.com", "/de/", "example.com/de/", "block")


def test_main_text_leaves_boilerplate_out(spark, sf_dir):
    for r in queries.op10_html_text(spark, sf_dir).collect():
        assert r.n_chars == len(r.text) and "<script" not in r.text
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<nav><a href=x>Home</a></nav><article><p>One &amp; two   are " + "long words here " * 20 + "</p></article>")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == "" and got[3].startswith("One & two are long") and "Home" not in got[3]


def calls(spark, sf_dir):
    item = spark.createDataFrame([(1, prose(40))], "item_id long, text string")
    model = quality.fit([prose(80, i * 100) for i in range(20)] + ["zz " * 50] * 20, [1] * 20 + [0] * 20)
    return {
        "token_counts": lambda d: token_counts.token_counts(d, queries.tokenizer_path()),
        "decontaminate": lambda d: decontaminate.clean(d, item),
        "personal_data": personal_data.detect,
        "masked": personal_data.mask,
        "near_dedup": near_dedup.classes,
        "deduplicated": near_dedup.dedup,
        "licenses": lambda d: licenses.scan(d.select("doc_id", licenses.sharded_dir(d.doc_id, d.source).alias("dir"), "text")),
        "quality": lambda d: quality.quality_scores(d, model),
        "kept": lambda d: quality.keep_good(d, model),
        "mix": mixing.mix,
        "fingerprints": fingerprints.edited_pairs,
    }


BROKEN = [(1, None, None, None, None), (None, "a b c d e f", "en", "s", 11), (2, "", "en", "s", 0), (3, "x " * 200_000, "en", None, 400_000), (4, "same text of some words here", "en", "s", 28), (5, "same text of some words here", None, "s", 28)]


@pytest.mark.parametrize("name", ["token_counts", "decontaminate", "personal_data", "masked", "near_dedup", "deduplicated", "licenses", "quality", "kept", "mix", "fingerprints"])
def test_broken_rows_empty_tables_and_clashing_columns(spark, sf_dir, name):
    call = calls(spark, sf_dir)[name]
    assert call(spark.createDataFrame([], DOC)).count() == 0
    rows = spark.createDataFrame(BROKEN, DOC)
    plain = call(rows).count()
    if name not in ("deduplicated", "kept"):
        assert plain == len(BROKEN)
    clashing = rows
    for extra in ("size", "score", "node", "rep", "key", "text_a", "spans", "target", "bucket"):
        clashing = clashing.withColumn(extra, F.lit("x"))
    assert call(clashing).count() == plain


def test_pipeline_keeps_one_document_of_each_group(spark, sf_dir, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "personal_data", "mix"]
    out = corpus_pipeline.run(spark, sf_dir)
    kept = {r.doc_id: r.text for r in out.select("doc_id", "text").collect()}
    assert len(kept) == out.count() and set(kept) <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert not any(k == "email" for t in kept.values() for k, _ in base_spans(t or ""))
