"""Nearest documents against brute force: many queries, small blocks, ties, nulls, other widths."""

import hashlib

import numpy as np
import pyarrow as pa

from cmdspark.operators import retrieval


def brute_top(docs, queries, k):
    docs = [(d, np.array(v, float)) for d, v in docs if v is not None and None not in v and any(v)]
    out = set()
    for q, v in queries:
        if v is None or not any(v):
            continue
        v = np.array(v, float)
        ranked = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9), d) for d, w in docs if len(w) == len(v))
        out |= {(q, n + 1, d) for n, (_, d) in enumerate(ranked[:k])}
    return out


def ranked(spark, docs, queries, **blocks):
    d = spark.createDataFrame(docs, "doc_id long, embedding array<float>")
    q = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    return [(r["query_id"], r["rank"], r["doc_id"]) for r in retrieval.top_documents(d, q, 3, **blocks).collect()]


def vectors(rng, n):
    return [(i, [float(x) for x in rng.integers(-9, 10, 4)]) for i in range(n)]


def test_more_queries_than_one_set_held(spark):
    rng = np.random.default_rng(8)
    docs, queries = vectors(rng, 40), vectors(rng, 10_050)
    queries = [(i, v) for i, v in queries if any(v)]
    got = ranked(spark, docs, queries)
    assert len(got) == 3 * len(queries)
    assert {q for q, _, _ in got} == {i for i, _ in queries}
    some = {i for i, _ in queries[::50]}
    # parallel vectors are tied but for the last bits of their products, so those documents are compared by similarity
    by_id, asked = dict(docs), dict(queries)
    cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)
    want = {(q, n): cos(asked[q], by_id[d]) for q, n, d in brute_top(docs, [(i, asked[i]) for i in some], 3)}
    assert {(q, n): cos(asked[q], by_id[d]) for q, n, d in got if q in some} == want


def test_blocks_do_not_change_the_result(spark):
    docs = [(i, [1.0, float(i % 7), 0.0]) for i in range(50)] + [(90, None), (91, [0.0, 0.0, 0.0]), (92, [1.0, None, 2.0]), (93, [1.0, 2.0])]
    queries = [(i, [1.0, float(i), 0.0]) for i in range(7)] + [(20, None), (21, [0.0, 0.0, 0.0]), (22, [1.0, 2.0])]
    want = brute_top(docs, queries, 3)
    for blocks in ({}, {"query_block": 2, "doc_block": 5}, {"query_block": 2, "doc_block": 5, "pivots": 3}, {"query_block": 4, "doc_block": 50, "pivots": 1}):
        got = ranked(spark, docs, queries, **blocks)
        assert len(got) == len(set(got))
        assert set(got) == want


def test_hashed_terms_of_repeated_and_null_ids(spark):
    rows = [(1, "a_b b"), (1, "c"), (None, "a"), (None, None), (2, " "), (3, "x " * 5000)]
    got = sorted((repr(r["id"]), int(sum(r["embedding"]))) for r in retrieval.hashed_terms(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect())
    assert got == sorted([("1", 3), ("1", 1), ("None", 1), ("None", 0), ("2", 0), ("3", 5000)])


def test_cells_leave_out_what_cannot_be_near(spark):
    """Clustered vectors, a third of them equal: the rows of brute force from a small part of the blocks."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    docs = [(i, (centres[i % 40] + 0.05 * rng.normal(size=16)).tolist()) for i in range(1200)] + [(5000 + i, centres[7].tolist()) for i in range(600)]
    queries = [(i, (centres[i % 40] + 0.05 * rng.normal(size=16)).tolist()) for i in range(150)]
    d = spark.createDataFrame(docs, "doc_id long, embedding array<double>")
    q = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"], r["doc_id"]) for r in retrieval.top_documents(d, q, 3, query_block=20, doc_block=25, pivots=200).collect()}
    assert got == brute_top(docs, queries, 3)
    cells, _ = retrieval.build_cells(d, 200, 25)
    looked = retrieval.deal_queries(q, cells, 3).count()
    assert looked < 0.3 * len(queries) * int(cells.parts[16].sum())


def test_few_queries_leave_documents_in_place(spark):
    d = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [3.0, 1.0])], "query_id long, embedding array<double>")
    plan = retrieval.top_documents(d, q)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # of the ranked rows
    assert retrieval.top_documents(d, q.limit(0)).count() == 0
    assert retrieval.top_documents(d.limit(0), q, query_block=0).count() == 0


def test_places_do_not_grow_in_number(spark):
    """Far from each other, so that bounds spare nothing: a query is sent to few places, whose documents have few copies."""
    rng = np.random.default_rng(5)
    docs, queries = [(i, rng.normal(size=24).tolist()) for i in range(3000)], [(i, rng.normal(size=24).tolist()) for i in range(60)]
    d = spark.createDataFrame(docs, "doc_id long, embedding array<double>")
    q = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    cells, dealt = retrieval.build_cells(d, 512, 2)
    assert dealt.count() == 3000
    assert retrieval.deal_queries(q, cells, 3).groupBy("query_id").count().agg({"count": "max"}).first()[0] <= 2 * retrieval.PLACES + 1
    got = {(r["query_id"], r["rank"], r["doc_id"]) for r in retrieval.top_documents(d, q, 3, query_block=2, doc_block=2).collect()}
    assert got == brute_top(docs, queries, 3)


def test_the_best_of_a_block_with_ties():
    docs = pa.table({"doc_id": [5, 3, 9, 1, 7, 8], "embedding": [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [1.0, 1.0], [1.0, 0.0]]})
    queries = pa.table({"query_id": [0, 1], "embedding": [[2.0, 0.0], [0.0, 1.0]]})
    got = [(r["query_id"], r["doc_id"]) for r in retrieval._pair_top(docs, queries, 3).to_pylist()]
    assert got == [(0, 1), (0, 3), (0, 5), (1, 9), (1, 7), (1, 1)]


def test_hashed_terms_stay_where_the_texts_are(spark):
    df = spark.createDataFrame([(1, "a\x1cb \u2003a_B\x85c\x0bd\u3000d"), (2, None)], "id long, text string")
    out = retrieval.hashed_terms(df, "id", "text")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = np.zeros(256)
    for word in ("a\x1cb", "a", "b", "c", "d", "d"):
        want[hashlib.md5(word.encode()).digest()[0]] += 1
    assert {r["id"]: r["embedding"] for r in out.collect()} == {1: want.tolist(), 2: [0.0] * 256}
