"""The pipeline: each stage on its predecessor's rows, and every registered query on the sample tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from ledgerlight.llm.queries import ORACLES, QUERIES  # noqa: E402
from ledgerlight.session import cut_lineage  # noqa: E402


def test_stages_keep_columns_and_take_effect(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        after = cut_lineage(stage(spark, docs, sample))
        if name == corpus_pipeline.STAGES[-1][0]:
            assert after.count() > 0 and after.columns == ["shard", "source", "block", "n_words", "text"]
        else:
            assert after.columns == columns and 0 < after.count() <= before
            assert after.filter("n_chars != length(text)").isEmpty()
            docs, before = after, after.count()


def test_stages_take_awkward_rows(spark, sample):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "a", 0), (2, "a b c\nd", None, "a", 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = cut_lineage(stage(spark, docs, sample))


def test_result_tells_its_documents(spark, sample):
    rows = corpus_pipeline.run(spark, sample).collect()
    known = {r["doc_id"] for r in spark.read.parquet(f"{sample}/documents.parquet").select("doc_id").collect()}
    assert rows and all(sum(d["n_words"] for d in r["doc_ids"]) == r["n_words"] and r["doc_ids"] for r in rows)
    assert {d["doc_id"] for r in rows for d in r["doc_ids"]} <= known


def test_a_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, sample, name):
    assert QUERIES[name](spark, sample).count() > 0
