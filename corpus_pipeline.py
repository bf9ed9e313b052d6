"""A training corpus from raw documents: five operators of the llm subpackage, one after the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cmdspark.functions.storage import drop_tables, noted_tables
from cmdspark.llm.common import materialize, words_count
from cmdspark.llm.exact_dedup import exact_dedup, normalise, sha256
from cmdspark.llm.minhash import near_duplicates
from cmdspark.llm.mixing import mix
from cmdspark.llm.packing import pack_documents
from cmdspark.llm.toxicity import drop_toxic, learn_lexicon


#: Name of the row numbers, and of what else stages add for a while: no column of the documents begins with it.
OWN = "__corpus_pipeline_"
ROW = OWN + "row"


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def _with_row(docs: DataFrame) -> DataFrame:
    """``docs`` with a unique number of each row, written once, so that every reader sees the same."""
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def _only(rows: DataFrame, kept: DataFrame, docs: DataFrame) -> DataFrame:
    """The numbered rows whose number is in ``kept``, with the columns of ``docs``. Numbers are unique, so no key is hot."""
    return rows.join(kept.select(ROW), ROW, "left_semi").select(*_columns(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from this corpus's labels, doesn't call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, learn_lexicon(docs, labels))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the least id.

    Rows are found by id and digest again, which saves writing the documents with numbers; only a table that
    repeats ids can have two such rows, of which one stays.
    """
    kept = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias(OWN + "id"), F.unhex("digest").alias(OWN + "digest"))
    wide = docs.withColumn(OWN + "key", sha256(normalise(F.col("text"))))
    out = wide.join(kept, wide["doc_id"].eqNullSafe(kept[OWN + "id"]) & (wide[OWN + "key"] == kept[OWN + "digest"]), "left_semi")
    if not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        out = out.withColumn(OWN + "text", normalise(F.col("text"))).dropDuplicates(["doc_id", OWN + "text"])
    return out.select(*_columns(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least id."""
    rows = _with_row(docs)
    return _only(rows, near_duplicates(rows, row_col=ROW).filter("kept"), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it."""
    rows = _with_row(docs)
    mixed = mix(rows, words_count(F.col("text")), row_col=ROW).filter("copies > 0").select(F.col("rid").alias(ROW), F.sequence(F.lit(1), F.col("copies").cast("int")).alias(OWN + "turns"))
    return rows.join(mixed, ROW).withColumn(OWN + "turn", F.explode(OWN + "turns")).select(*_columns(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("mixing", mixing), ("packing", packing)]

#: SQL cannot express the learned lexicon, the signatures or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Once a stage's result is written, the tables that led to it are deleted, the stage's input among them."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with noted_tables() as tables:
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_tables(spark, [*before, *tables[:-1]])
        before = tables[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
