"""Each method against a plain form of itself, and on long or repetitive inputs."""

import html
import random
import re
import resource
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalake.llm import decontaminate, fingerprints, html_text, kernels, mixing, near_dedup, personal_data, quality, stats, tables


# --- tiling


def plain_tiles(a, b, k):
    """The longest common free run again and again; of equal ones the first in a, then in b."""
    in_a, in_b, out = [False] * len(a), [False] * len(b), []
    while True:
        best, place = 0, None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and not in_a[i + n] and not in_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best:
                    best, place = n, (i, j)
        if best < k:
            return out
        out.append((*place, best))
        for x in range(best):
            in_a[place[0] + x] = in_b[place[1] + x] = True


def test_tiles_match_a_plain_search_ties_included():
    r, names = random.Random(3), kernels.constants(32, 5)
    for _ in range(200):
        v = r.choice([2, 3, 6, 20])
        a, b = ([r.randrange(v) for _ in range(r.randrange(1, n))] for n in (40, 30))
        k = r.choice([1, 2, 3, 5])
        assert decontaminate.tiles(names[np.array(a)], names[np.array(b)], k) == plain_tiles(a, b, k)


def test_leaks_match_plain_tiling_of_every_pair(spark):
    r = random.Random(8)
    word = lambda: f"w{r.randrange(30)}"
    items = [[word() for _ in range(r.randrange(5, 30))] for _ in range(12)]
    docs = []
    for i in range(60):
        own = [word() for _ in range(r.randrange(0, 40))]
        for item in r.sample(items, r.choice([0, 1, 2])):
            cut = r.randrange(len(item))
            own += item[cut:] + [word()] + item[:cut] if r.random() < 0.5 else item[: len(item) // 2]
        docs.append((i, " ".join(own)))
    want = {}
    for i, text in docs:
        for j, item in enumerate(items):
            covered = sum(n for _, _, n in plain_tiles(text.split(), item, decontaminate.K))
            if covered >= 0.5 * len(item):
                want[i, j] = covered
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string")
    assert {(x.doc_id, x.item_id): x.covered for x in decontaminate.leaks(frame, bench).collect()} == want and len(want) > 20
    kept = {x.doc_id for x in decontaminate.clean(frame, bench).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}


def test_items_without_id_and_short_items(spark):
    long_word = "これは十分に長い一つの文です"
    bench = spark.createDataFrame([(None, "one two three four five six"), (2, long_word), (3, "the"), (4, None), (5, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x one two three four five six y"), (2, f"a {long_word} b"), (3, "the end"), (1, "x one two three four five six y")], "doc_id long, text string")
    assert sorted((x.doc_id, str(x.item_id)) for x in decontaminate.leaks(docs, bench).collect()) == [(1, "None"), (1, "None"), (2, "2")]
    assert [x.doc_id for x in decontaminate.clean(docs, bench).collect()] == [3]
    assert decontaminate.clean(docs, bench.limit(0)).count() == 4


def test_repetitive_texts_cost_little():
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    start = time.time()
    item = decontaminate.Items.of([1, 2], ["x " * 600, "x " * 599 + "y " + "x " * 300])
    found = list(decontaminate._leaks(pa.array(["x " * 500_000, "y x " * 250_000]), item, 0.5))
    assert {(r, i) for r, i, *_ in found} == {(0, 0), (0, 1)} and time.time() - start < 30
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10 < 300


# --- words and sets


def test_words_of_any_length_and_place_hash_alike():
    r = random.Random(1)
    texts = [" ".join(r.choice(["abc", "De", "x" * r.randrange(1, 9), "é"]) for _ in range(r.randrange(0, 3000))) for _ in range(200)] + ["y" * 700_000 + " z " + "y" * 700_000, None, ""]
    seen = {}
    for part in kernels.slices(pa.array(texts)):
        found = kernels.words(part)
        for i in range(len(part)):
            words = (texts[part.first + i] or "").lower().split(" ")
            words = [w for w in words if w]
            hashes = found.hashes[found.bounds[i] : found.bounds[i + 1]].tolist()
            assert len(words) == len(hashes) and all(seen.setdefault(w, h) == h for w, h in zip(words, hashes, strict=True))
    assert len(set(seen.values())) == len(seen)


def test_dedup_of_rows_without_or_with_shared_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (None, a), (None, a), (None, b), (None, b), (5, "x y z"), (5, "x y z"), (5, "other words"), (None, None), (None, ""), (7, None), (8, a + " end")]
    out = near_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = Counter((r.doc_id, r.text) for r in out)
    assert found == Counter([(1, a), (None, b), (5, "x y z"), (5, "other words"), (None, None), (None, ""), (7, None)])


def test_odd_sketches_estimate_high_similarities():
    r = np.random.default_rng(2)
    off = []
    for share in (0.8, 0.85, 0.9, 0.95, 1.0):
        for _ in range(40):
            n = 600
            both = int(2 * n * share / (1 + share))
            pool = kernels.mix(r.integers(0, 1 << 62, 2 * n - both).astype(np.uint64))
            x, y = np.sort(pool[:n]), np.sort(pool[n - both :])
            true = both / (2 * n - both)
            samples = near_dedup.minhashes(np.concatenate([x, y]), np.array([0, n]))
            sketch = near_dedup.odd_sketches(samples)
            bits = int(np.bitwise_count(sketch[0] ^ sketch[1]).sum())
            guess = 1 + near_dedup.BITS / (4 * near_dedup.SAMPLES) * np.log(max(1e-9, 1 - 2 * bits / near_dedup.BITS))
            off.append(abs(guess - true))
            assert bits <= near_dedup.most_bits(int(100 * true))
    assert np.mean(off) < 0.05


# --- personal data


def mixed_secrets(n, r):
    hexes = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    good = [f'set token = "{hexes()}" there' for _ in range(n)] + [f"the password: {''.join(r.choice('abcdefghkmXYZ23456789') for _ in range(14))} ok" for _ in range(n // 2)]
    bad = [f"see commit {hexes()} for it" for _ in range(n)] + [f"read the-long-{r.randrange(99)}-way-to-the-old-mill now" for _ in range(n)] + [f"file path /usr/lib/some2/of/those/{r.choice('ab')}things here" for _ in range(n // 2)]
    return good, bad


def test_secrets_are_found_and_checksums_and_names_are_not(spark):
    good, bad = mixed_secrets(60, random.Random(5))
    rows = [(i, t) for i, t in enumerate(good + bad)]
    got = {r.doc_id: r for r in personal_data.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = sum(got[i].n_secret == 1 for i in range(len(good)))
    wrong = sum(got[i].n_spans > 0 for i in range(len(good), len(rows)))
    assert caught >= 0.9 * len(good) and wrong <= 0.05 * len(bad)
    masked = {r.doc_id: r.text for r in personal_data.mask(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("[SECRET]" in masked[i] for i in range(len(good))) == caught


def test_reliabilities_separate_two_classes_of_voters():
    r = np.random.default_rng(7)
    truth = r.random(4000) < 0.4
    hit = np.array([0.95, 0.9, 0.8, 0.7, 0.55])
    marks = np.where(r.random((4000, 5)) < hit, truth[:, None], ~truth[:, None]).astype(int)
    keys, counts = np.unique(marks, axis=0, return_counts=True)
    sure = dict(zip(map(tuple, keys.tolist()), personal_data.reliabilities(keys, counts.astype(float)) > 0.5, strict=True))
    # at least as good as the votes of the best labeler alone
    assert np.mean([sure[tuple(m)] == t for m, t in zip(marks.tolist(), truth, strict=True)]) >= 0.94


# --- quality


def test_fit_is_sound_at_every_size_and_calibrated(spark):
    big = "/root/testdata/sf0.1"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text").collect()}
    rows = [(r.doc_id, docs[r.doc_id], r.quality) for r in spark.read.parquet(f"{big}/labels.parquet").collect() if r.quality in (0, 1) and r.doc_id in docs]
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    train = sorted((r for r in rows if zlib.crc32(str(r[0]).encode()) % 5), key=lambda r: zlib.crc32(str(r[0]).encode()))
    y = np.array([r[2] for r in held])
    for n in (200, 500, 1000, 2000, len(train)):
        model = quality.fit([r[1] for r in train[:n]], [r[2] for r in train[:n]])
        score = quality.Scorer(model).scores([r[1].encode() for r in held])
        good, bad = score[y == 1], score[y == 0]
        area = ((good[:, None] > bad) + 0.5 * (good[:, None] == bad)).mean()
        assert np.abs(model.weights).max() < 30 and area > 0.93
    for low, high in ((0, 0.1), (0.1, 0.5), (0.5, 0.9), (0.9, 1.01)):
        some = (score >= low) & (score < high)
        if some.sum() >= 20:
            assert abs(score[some].mean() - y[some].mean()) < 0.12


def test_damped_solver_stays_bounded_where_classes_are_apart():
    x = np.column_stack([np.ones(40), np.r_[np.linspace(-9, -1, 20), np.linspace(1, 9, 20)]])
    w = stats.logistic(x, np.r_[np.zeros(20), np.ones(20)], np.ones(40), 0.01)
    assert np.isfinite(w).all() and 0 < w[1] < 50


# --- mixing


def plain_flow(sizes, members, quotas, repeats):
    """Word by word: the cheapest augmenting path by Bellman-Ford over the whole network."""
    n, m = len(sizes), len(quotas)
    taken, routed, left, cost = [0] * n, Counter(), list(quotas), 0
    while True:
        dist, back = {}, {}
        for p in range(n):
            if sizes[p] and taken[p] < repeats * sizes[p]:
                k = taken[p] // sizes[p]
                dist["p", p], back["p", p] = k * (k + 1) // 2, None
        changed = True
        while changed:
            changed = False
            for kind, x in list(dist):
                for node in [("s", s) for s in members[x]] if kind == "p" else [("p", p) for p in range(n) if routed[p, x]]:
                    if dist[kind, x] < dist.get(node, 1 << 60):
                        dist[node], back[node], changed = dist[kind, x], (kind, x), True
        ends = [(dist["s", s], s) for s in range(m) if ("s", s) in dist and left[s]]
        if not ends:
            return sum(taken), cost
        d, s = min(ends)
        cost, node = cost + d, ("s", s)
        left[s] -= 1
        while back[node] is not None:
            before = back[node]
            routed[(before[1], node[1]) if before[0] == "p" else (node[1], before[1])] += 1 if before[0] == "p" else -1
            node = before
        taken[node[1]] += 1


def test_flow_takes_most_words_at_least_cost_over_overlapping_sources():
    r = random.Random(6)
    for _ in range(150):
        n, m = r.randrange(1, 6), r.randrange(1, 4)
        sizes = [r.randrange(0, 8) for _ in range(n)]
        members = [sorted(r.sample(range(m), r.randrange(1, m + 1))) for _ in range(n)]
        quotas = [r.randrange(0, 20) for _ in range(m)]
        flow = mixing.min_cost_flow(sizes, members, quotas, 3)
        cost = sum(k * (k + 1) // 2 * min(s, max(0, t - k * s)) for s, t in zip(sizes, flow.taken, strict=True) for k in range(3))
        assert (sum(flow.taken), cost) == plain_flow(sizes, members, quotas, 3)


def test_mix_of_overlapping_sources(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 5)), "abc"[i % 3]) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    own = F.when(F.col("doc_id") % 4 == 0, F.array("source", F.lit("d"))).otherwise(F.array("source"))
    out = mixing.mix(frame, weights={"a": 1, "b": 1, "c": 1, "d": 3}, sources=own).collect()
    assert len(out) == 300 and all(0 <= r.copies <= 3 and r.taken == r.copies * r["size"] for r in out)
    words = sum(r["size"] for r in out)
    assert abs(sum(r.taken for r in out) - words) <= 0.05 * words
    both = [r for r in out if r.doc_id % 4 == 0]
    assert sum(r.taken for r in both) / sum(r["size"] for r in both) > sum(r.taken for r in out) / words


# --- fingerprints


def test_containment_and_merging_of_unequal_texts():
    words = [f"w{i}" for i in range(2000)]
    whole, part, other = " ".join(words), " ".join(words[100:200]), " ".join(f"v{i}" for i in range(300))
    x, y, z = fingerprints.sketches(pa.array([whole, part, other]))
    assert fingerprints.containment(y, x) == 1 and fingerprints.containment(z, x) == 0
    assert abs(fingerprints.containment(x, y) - 96 / 1996) < 1e-9
    assert set(fingerprints.merged(x, z).tolist()) == set(x[2].tolist()) | set(z[2].tolist())
    assert fingerprints.containment(fingerprints.sketches(pa.array([""]))[0], x) == 0


# --- main text


def article(page):
    """What lies between the article's tags, cut at block tags by other means than html_text's."""
    m = re.search(r"<article>(.*?)</article>", page, re.S)
    parts = re.split(r"</?(?:p|h1)[^>]*>", m[1])
    texts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in parts]
    return "\n".join(t for t in texts if t)


def test_main_text_is_the_article_with_names_and_without(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if r.html and "<article>" in r.html]
    assert len(pages) > 100
    for page in pages:
        assert html_text.main_text(page) == html_text.main_text(html_text.nameless(page)) == article(page)


def test_words_and_density_decide():
    """Without words, density and neighbours the tree errs often; without names hardly, where names aren't all there is."""
    pages = [(html_text.nameless(p), m) for p, m in html_text.labelled()[::3]]
    x = np.vstack([html_text.features(html_text.blocks(p)) for p, _ in pages])
    y = np.array([c == "+" for _, m in pages for c in m], float)
    halves = np.arange(len(y)) % 2 == 0

    def right(columns):
        node = stats.grow(x[halves][:, columns], y[halves], depth=8, least=3)
        return ((stats.shares(node, x[~halves][:, columns]) >= 0.5) == y[~halves]).mean()

    assert right(list(range(9))) > 0.97 and right([8, 9]) < 0.93


@pytest.mark.parametrize("piece", ["<div>", "<object>", '<a "', "<", "&", "<p>x", "</div>", "<ul><li>a", "<svg>", '<div class="nav article">', "<!--", "<a href='"])
def test_a_megabyte_of_tags_takes_seconds(piece):
    start = time.time()
    html_text.main_text(piece * (1_000_000 // len(piece)))
    assert time.time() - start < 12


def test_main_text_of_broken_rows(spark):
    kind = "page_id long, url string, html string"
    assert html_text.extract(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, "u", "<p>One &amp; two words of a text here</p>")] * 2 + [(None, None, None), (3, "v", "<p>cut <b>off <a href=")]
    frame = spark.createDataFrame(rows, kind)
    for extra in ("text", "n_chars", "words"):
        frame = frame.withColumn(extra, F.lit("x"))
    got = sorted((str(r.page_id), r.text) for r in html_text.extract(frame).collect())
    assert got == [("1", "One & two words of a text here")] * 2 + [("3", "cut off"), ("None", "")]


# --- places


def test_shared_folder_must_be_named_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)
            set = staticmethod(lambda key, value: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(Session())
