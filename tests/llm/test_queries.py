"""Registered queries against their SQL, and the pipeline against its operators applied by hand."""

import pytest

import corpus_pipeline
from assayloom.llm import op06_quality, queries
from tests.test_twins import rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_twin(name, spark, duck, small):
    assert rows(queries.QUERIES[name](spark, small).toPandas()) == rows(duck.sql(queries.ORACLE_SQL[name]).df())


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, small)
        assert kept.columns == docs.columns and kept.count() <= before.count(), name
    scores = op06_quality.score_documents(docs, spark.read.parquet(f"{small}/labels.parquet").where(~queries.held_out()))
    good = {r.doc_id for r in scores.where("predicted = 1").collect()}
    stage = dict(corpus_pipeline.STAGES)
    after = stage["quality"](spark, docs, small)
    assert {r.doc_id for r in after.select("doc_id").collect()} == good
    components = {r.doc_id: r.component_id for r in queries.op10_jaccard.jaccard_components(after).collect()}
    single = stage["near_duplicates"](spark, after, small)
    assert {r.doc_id for r in single.select("doc_id").collect()} == {d for d, c in components.items() if d == c}
    got = corpus_pipeline.run(spark, small)
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
