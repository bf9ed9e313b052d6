"""Retrieval jobs: nearest vectors, contexts, hashed terms of documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cmdspark.operators import retrieval

from .mining_jobs import table


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def _top(spark, sf_dir, **blocks):
    """Every twentieth vector asks all vectors."""
    docs = _vectors(spark, sf_dir)
    queries = docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    return retrieval.top_documents(docs, queries, k=3, **blocks)


def q3_top_documents(spark, sf_dir):
    return _top(spark, sf_dir).select("query_id", "rank", "doc_id", F.round("similarity", 6).alias("similarity"))


def q3_cells(spark, sf_dir):
    """Q3 and Q4 as for many queries: dealt to the cells of documents that can hold one of their nearest."""
    return _top(spark, sf_dir, query_block=16, doc_block=256).select("query_id", "rank", "doc_id", F.round("similarity", 6).alias("similarity"))


def q5_context(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return retrieval.context(_top(spark, sf_dir), texts).select("query_id", F.md5("context").alias("context_md5"))


def q2_hashed_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hashed = retrieval.hashed_terms(docs, "doc_id", "text")
    return hashed.select("doc_id", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).cast("long").alias("terms"), F.md5(F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",")).alias("vector_md5"))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts(texts: list[str]) -> np.ndarray:
    """An encoder without a model: how often each letter occurs."""
    return np.array([[t.count(c) for c in LETTERS] for t in texts], dtype=np.float32).reshape(len(texts), len(LETTERS))


def q2_embedded(spark, sf_dir):
    """Q1 and Q2 with a given encoder."""
    vectors = retrieval.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), letter_counts)
    return vectors.select("doc_id", F.md5(F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",")).alias("vector_md5"))


def q1_normalised_queries(spark, sf_dir):
    """Q1, Q6: each document's whole text with its source as a hint."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(retrieval.normalise(retrieval.expand(F.col("text"), F.concat(F.lit("From_"), F.col("source"))))).alias("query_md5"))


QUERIES = {f.__name__: f for f in (q1_normalised_queries, q2_hashed_terms, q2_embedded, q3_top_documents, q3_cells, q5_context)}

_TOP = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_cosine_similarity(q.e, d.e) AS similarity FROM v q, v d WHERE q.vec_id % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id)::INT AS rank FROM s QUALIFY rank <= 3)
"""
SQL = {
    "q1_normalised_queries": "SELECT doc_id, md5(replace(lower(concat_ws(' ', text, 'From_' || source)), '_', ' ')) AS query_md5 FROM documents",
    "q2_hashed_terms": r"""
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(replace(lower(text), '_', ' '), '\s+'), lambda x: x <> '')) AS word FROM documents),
c AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 2))::INT AS slot, count(*) AS n FROM w GROUP BY 1, 2)
SELECT d.doc_id, coalesce(sum(c.n), 0)::BIGINT AS terms, md5(string_agg(coalesce(c.n, 0)::VARCHAR, ',' ORDER BY i)) AS vector_md5
FROM (SELECT doc_id, unnest(range(256)) AS i FROM documents) d LEFT JOIN c ON c.doc_id = d.doc_id AND c.slot = d.i GROUP BY 1""",
    "q2_embedded": "SELECT doc_id, md5(array_to_string(list_transform(string_split('"
    + LETTERS
    + "', ''), lambda c: length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), c, ''))), ',')) AS vector_md5 FROM documents",
    "q3_top_documents": _TOP + "SELECT query_id, rank, doc_id, round(similarity, 6) AS similarity FROM t",
    "q3_cells": _TOP + "SELECT query_id, rank, doc_id, round(similarity, 6) AS similarity FROM t",
    "q5_context": _TOP + "SELECT query_id, md5(string_agg(text, chr(10) ORDER BY rank)) AS context_md5 FROM t JOIN documents USING (doc_id) GROUP BY 1",
}
