"""Queries against their SQL, and the pipeline stage by stage."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import corpus_pipeline  # noqa: E402
from check_oracles import compare, connect  # noqa: E402

from plumbscore.llm import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, folder, name):
    assert compare(QUERIES[name](spark, folder), connect(folder), ORACLES[name]) is None


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, folder)
        assert after.columns == docs.columns
        path = corpus_pipeline.materialize(after, "test")
        assert path.select("doc_id").subtract(before.select("doc_id")).isEmpty()
        left[name], before = path.count(), path
    assert 0 < left["benchmark"] <= left["near_copies"] < left["toxicity"] < left["quality"] < docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, before, folder)
    assert packed.select("doc_id").distinct().count() == before.where("length(trim(text)) > 0").count()
    assert duckdb.__version__
