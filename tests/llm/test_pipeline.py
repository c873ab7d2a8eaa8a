"""The pipeline against plain forms of its stages, and its stages on broken rows."""

import pyarrow as pa
import pytest

import corpus_pipeline
from stratalake.llm import decontaminate, mixing, personal_data, quality
from tests.llm.test_operators import BROKEN, DOC, by_brute_force


def test_pipeline_matches_plain_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    score = quality.Scorer(model).scores([t.encode() for t in texts.values()])
    texts = {i: t for (i, t), s in zip(texts.items(), score, strict=True) if s >= 0.3}
    texts = {i: texts[i] for i, (_, component) in by_brute_force(texts, 80).items() if component == i}
    items = decontaminate.Items.of(*map(list, zip(*((r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if r.text is not None), strict=True)))
    texts = {i: t for i, t in texts.items() if not list(decontaminate._leaks(pa.array([t]), items, decontaminate.THRESHOLD))}
    table = {}
    for t in texts.values():
        for code in personal_data._found(t)[2]:
            table[code] = table.get(code, 0) + 1
    yes = frozenset(personal_data.accepted(table))
    rows = {r.doc_id: r for r in docs.collect()}
    left = [(i, personal_data.masked(t, yes), rows[i].source) for i, t in texts.items()]
    mixed = mixing.mix(spark.createDataFrame(left, "doc_id long, text string, source string"), keep=True).filter("copies > 0")
    want = sorted((r.doc_id, r.text, r.copies) for r in mixed.collect())
    assert sorted((r.doc_id, r.text or "", r.copies) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want and len(want) > 50


@pytest.mark.parametrize("name, stage", [s for s in corpus_pipeline.STAGES if s[0] != "near_dedup"])
def test_stages_on_broken_rows(spark, sf_dir, name, stage):
    for rows in ([], BROKEN):
        out = stage(spark, spark.createDataFrame(rows, DOC), sf_dir)
        assert out.count() <= len(rows)
        if name != "mix":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
