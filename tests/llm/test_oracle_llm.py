"""Registered queries of the subpackage against their SQL twins, and the pipeline's stages."""

import duckdb
import pytest
from check import compare, connect

import __spark_entry__
import corpus_pipeline
from kelvingrid.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    ok, note = compare(spark, connect(SF), SF, QUERIES[name], ORACLES[name])
    assert ok is True, note


def test_all_operators_and_the_pipeline_are_registered():
    names = set(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert duckdb is not None


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] > counts[4] == counts[5]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_take_messy_and_empty_tables(spark, messy, no_docs, k):
    stage = corpus_pipeline.STAGES[k][1]
    assert stage(spark, messy, SF).count() > 0 and stage(spark, no_docs, SF).count() == 0
