"""Registered queries against their SQL, and the pipeline's stages against what they should do."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cmdspark.llm.common import materialize
from cmdspark.llm.queries import QUERIES, SQL
from tests.compare import assert_same


@pytest.mark.parametrize("name", SQL)
def test_query_against_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), SQL[name], sf_dir)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_query_has_every_row(spark, sf_dir, name):
    table, key = ("pages", "page_id") if "url" in name else ("documents", "doc_id")
    ids = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key)
    assert QUERIES[name](spark, sf_dir).select(key).distinct().count() == ids.distinct().count()


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    # the case of null ids, nulls elsewhere and repeated rows goes through every stage
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumns({"doc_id": F.lit(None).cast("long"), "source": F.lit(None).cast("string"), "text": F.lit(None).cast("string")}))
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == columns, name
        counts.append(docs.count())
        if name in ("exact dedup", "near dedup"):
            assert docs.groupBy("text").count().filter("count > 1").isEmpty()
    assert counts[0] > counts[1] > counts[2] >= counts[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.filter("piece = 0").count() == counts[4]


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    assert docs.count() == 0
