"""The pipeline stage by stage, each against what it must do with its own input."""

import os
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from crowdlake.llm import mixing, pii, toxicity
from crowdlake.llm.queries import QUERIES, VOCABULARY
from tests.llm.test_operators import brute_components, brute_fingerprint, brute_spans


@pytest.fixture(scope="module")
def sf():
    return os.environ.get("SF_DIR", "/root/testdata/sf0.01")  # the smallest has too few toxic labels to learn from


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf).persist()
        out.append((name, docs, after))
        docs = after
    return out


def test_names_and_columns(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "simhash_near_dedup", "pii", "mixing", "sentencepiece"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.schema == before.schema


def test_toxicity_stage_drops_what_the_model_rejects(spark, sf, stages):
    _, before, after = stages[0]
    model = toxicity.fit(before, spark.read.parquet(f"{sf}/labels.parquet"))
    rejected = {r.doc_id for r in before.collect() if model.score(r.text) >= 0.5}
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == rejected != set()


def test_dedup_stage_keeps_one_of_each_group(stages):
    _, before, after = stages[1]
    rows = sorted((r.doc_id, r.text or "") for r in before.collect())
    groups = brute_components([brute_fingerprint(t) for _, t in rows])
    assert sorted(r.doc_id for r in after.collect()) == sorted({rows[g][0] for g in groups})


def test_pii_stage_masks_every_strict_match(stages):
    _, before, after = stages[2]
    texts = {r.doc_id: r.text for r in before.collect()}
    masked = {r.doc_id: r.text for r in after.collect()}
    assert texts.keys() == masked.keys()
    for i, t in texts.items():
        assert brute_spans(masked[i] or "") == []
        if not pii.candidates(t):
            assert masked[i] == t
    assert any("[EMAIL]" in (t or "") for t in masked.values())


def test_mixing_stage_repeats_documents(stages):
    _, before, after = stages[3]
    want = {r.doc_id: r.copies for r in mixing.mix(before).collect()}
    got = Counter(r.doc_id for r in after.collect())
    assert all(got[i] == n for i, n in want.items())
    size = mixing.word_count(F.col("text"))
    total = before.agg(F.sum(size)).first()[0]
    assert total * 0.8 <= after.agg(F.sum(size)).first()[0] <= total


def test_encoding_stage_equals_the_library(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    for r in stages[4][2].collect():
        assert r.tokens == library.encode(r.text or "")


def test_registered(spark, sf):
    names = entry.queries()
    assert {*QUERIES, "pipeline"} <= set(names) and sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
