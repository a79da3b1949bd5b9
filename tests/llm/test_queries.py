"""Queries against their SQL, and the pipeline against what its stages should leave."""

import pytest

import corpus_pipeline
from spindlewise.llm.oracles import ORACLES
from spindlewise.llm.queries import QUERIES
from tests.compare import duckdb_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, FOLDER)) == duckdb_rows(ORACLES[name], FOLDER)


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    for (name, stage), query in zip(corpus_pipeline.STAGES, ("toxic", "good", "copies", "near", "packed")):
        left = stage(spark, docs, FOLDER).cache()
        before, after = ({r.doc_id: r.text for r in d.select("doc_id", *(["text"] if "text" in d.columns else [d.columns[0]])).toDF("doc_id", "text").collect()} for d in (docs, left))
        assert before.keys() >= after.keys() and after
        if name == "exact_dedup":
            assert len(after) == len({t.lower() for t in before.values()}) == len({t.lower() for t in after.values()})
        if name == "packing":
            assert before.keys() == after.keys()
        else:
            assert left.columns == docs.columns
        docs = left
