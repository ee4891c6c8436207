"""Registered queries of the subpackage on the smallest tables."""

import corpus_pipeline
import pytest

from check import compare, connect
from txtrail.llm import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_check_sql(spark, name):
    assert compare(spark, connect(SMALL), SMALL, name).startswith("ok")


def test_every_dealt_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))


def test_pipeline_keeps_what_it_should(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns
        assert 0 < after.count() <= docs.count()
        docs = spark.createDataFrame(after.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
