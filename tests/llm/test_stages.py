"""The pipeline's near and mixing stages decide by row, whatever ids the rows have."""

import os
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from cmdspark.functions.storage import noted_tables
from cmdspark.llm import packing, toxicity
from cmdspark.llm.common import materialize
from tests.llm.test_operators import brute_classes, water_fill


def test_one_row_of_each_class_stays_with_shared_and_null_ids(spark, sf_dir):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(8):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
        texts += [" ".join(base), " ".join([*base[:-1], "other"])]
    ids = [None if i % 4 else i % 8 for i in range(16)]  # shared by rows of different texts
    docs = materialize(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string"), "stage")
    kept = [r["text"] for r in corpus_pipeline.near(spark, docs, sf_dir).collect()]
    classes = brute_classes(list(enumerate(texts)))
    assert Counter(classes[texts.index(t)] for t in kept) == Counter(set(classes.values()))


def test_one_row_of_each_text_stays_with_shared_and_null_ids(spark, sf_dir):
    rows = [(1, "a"), (2, "a"), (2, "b"), (2, "b"), (None, "b"), (None, "c"), (None, "c"), (3, None), (3, "")]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "stage")
    kept = sorted(((r["doc_id"], r["text"] or "") for r in corpus_pipeline.exact(spark, docs, sf_dir).collect()), key=repr)
    assert kept == sorted([(1, "a"), (2, "b"), (None, "c"), (3, "")], key=repr)


def test_columns_named_like_those_of_the_stages_pass_through(spark, sf_dir):
    names = ["__row", "rid", "id", "key", "norm", "m_words", "m_copies", "m_turn", "copies", "size", "keep_id", "kept", "node", "bands", "a.b", "class_id", "digest", "weight", "score"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = materialize(docs.select("*", *[F.concat(F.lit(n + " "), F.col("doc_id").cast("string")).alias(n) for n in names]), "stage")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == columns, name
        for r in docs.collect():
            assert all(r[n] == f"{n} {r['doc_id']}" for n in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).filter("piece = 0").count() == docs.count()


def test_mix_meets_its_target_with_shared_and_null_ids(spark, sf_dir):
    for id_ in (None, 7):
        rows = [(id_, " ".join([f"t{i}"] * 10), "s") for i in range(11)]
        docs = materialize(spark.createDataFrame(rows, "doc_id long, text string, source string"), "stage")
        mixed = Counter(r["text"] for r in corpus_pipeline.mixing(spark, docs, sf_dir).collect())
        assert set(mixed) == {t for _, t, _ in rows}
        assert abs(10 * sum(mixed.values()) - 1.5 * 110) < 10


def test_stages_against_brute_force(spark, sf_dir):
    """Each stage by its definition on its own input: what goes, what stays, how often, and where it is packed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) < 6000").limit(120)
    docs = materialize(docs.unionByName(docs.limit(5)).unionByName(docs.limit(2).withColumns({"doc_id": F.col("doc_id") + 10**6, "text": F.lit(None).cast("string")})), "stage")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    matcher = toxicity.Matcher(toxicity.learn_lexicon(docs, labels))
    stages = dict(corpus_pipeline.STAGES)

    def apply(name, docs):
        out = materialize(stages[name](spark, docs, sf_dir), "stage")
        return out, [r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()]

    key = lambda r: repr(sorted(r.items()))
    docs, before, after = apply("toxicity", docs)
    clean = [r for r in before if toxicity.score_from(matcher.weight(r["text"] or ""), len(r["text"] or "")) < toxicity.THRESHOLD]
    assert sorted(map(key, after)) == sorted(map(key, clean))

    docs, before, after = apply("exact dedup", docs)
    first = {}
    for r in sorted(before, key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r)
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in first.values())

    docs, before, after = apply("near dedup", docs)
    classes = brute_classes([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(set(classes.values()))

    docs, before, after = apply("mixing", docs)
    sizes = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in before}
    by_source = Counter()
    for r in before:
        by_source[r["source"]] += sizes[r["doc_id"]]
    order = sorted(by_source, key=lambda s: (s is None, (s or "").encode()))
    want = water_fill(by_source, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5, 2.0)
    taken, shortest = Counter(), min(n for n in sizes.values() if n)
    for r in after:
        taken[r["source"]] += sizes[r["doc_id"]]
    assert max(Counter(r["doc_id"] for r in after).values()) <= 2
    for s in order:
        longest = max(sizes[r["doc_id"]] for r in before if r["source"] == s)
        assert abs(taken[s] - want[s]) <= max(shortest, longest / 2), s

    rows = corpus_pipeline.packing(spark, docs, sf_dir).collect()
    total = sum(len(packing.token_ids(r["text"] or "", packing.tokenizer_folder())) for r in after)
    assert sum(r["length"] for r in rows) == total
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert len(sequences) <= packing.lower_bound(np.array([r["length"] for r in rows]), 2048) + 1


def test_a_run_leaves_only_the_tables_of_its_last_stages(spark, sf_dir):
    with noted_tables() as tables:
        out = corpus_pipeline.run(spark, sf_dir)
    left = [p.rsplit("/", 1)[-1].rsplit("-", 1)[0] for p in tables if os.path.exists(p.removeprefix("file://"))]
    assert "mixing" in left
    assert not {"toxicity", "exact-dedup", "near-dedup", "signatures", "shingle-sets", "numbered", "mix-sizes"} & set(left)
    assert out.filter("piece = 0").count() > 0
