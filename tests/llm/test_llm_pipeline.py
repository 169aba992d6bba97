"""The pipeline, stage by stage, against plain versions."""

import os

import pytest

import corpus_pipeline
from exprstudy.llm import quality
from test_llm_texts import FOLDER, TEXTS, check_packing, plain_deletions, plain_groups, texts_of, words

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "line_dedup", "near_dedup", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = texts_of(docs)
        out = stage(spark, docs, FOLDER).cache()
        assert out.columns == columns
        after = dict(texts_of(out))
        if name == "quality_rules":
            good = {r.doc_id for r in quality.verdicts(docs).where("kept").collect()}
            assert set(after) == good
        elif name == "language_id":
            assert 0.95 * len(before) <= len(after)
        elif name == "line_dedup":
            cut = plain_deletions(before)
            assert after == {i: t for i, t in cut.items() if words(t) or t == dict(before)[i]}
        else:
            assert set(after) == {i for i, _, _, kept in plain_groups(before) if kept}
        docs = out
    n, total = check_packing(texts_of(docs), corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect())
    assert n <= 1.03 * -(-total // 1024) + 1


def test_odd_and_empty_tables(spark):
    rows = [(i, t, "en" if i and i % 2 else None, "s", len(t or "")) for i, t in TEXTS if i != 8]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for frame in (docs, docs.where("doc_id > 1000")):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, FOLDER)
            assert out.count() >= 0
