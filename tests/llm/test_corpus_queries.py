"""Registered queries against their SQL, the pipeline on the smallest tables, and the lists the contracts ask for."""

import oracle
import pytest

import __spark_entry__
import corpus_pipeline
from alarmlens.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert oracle.spark_rows(queries.QUERIES[name](spark, SF)) == oracle.duck_rows(SF, queries.ORACLES[name])


def test_all_are_registered():
    known = __spark_entry__.queries()
    assert {n.split("_")[0] for n in known if n[2:3].isdigit() and n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in known


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("n_chars", "n_chars").selectExpr("*", "'x' AS _row", "1 AS copies")
    extra = spark.createDataFrame([(None, None, None, None, None, "y", 2), (10**6, "", "en", None, 0, "y", 2)], docs.schema)
    docs = docs.unionByName(extra)
    before = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        if k < 3:
            assert out.count() <= before
        docs = out
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(docs.columns)
    assert docs.groupBy("sequence_id").agg({"length": "sum"}).agg({"sum(length)": "max"}).first()[0] <= 2048


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs.write.parquet(str(tmp_path / str(k)))
        docs = stage(spark, spark.read.parquet(str(tmp_path / str(k))), SF)
    assert docs.count() == 0
