"""Clustering, runs and quality rules: hard cases, and results against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cmdspark.llm import clustering, quality, runs
from cmdspark.llm.words import split_words

SCHEMA = "doc_id long, text string, id string, runs string, collapsed string, kept string, n_words string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "x", "x", "x", "x", "x") for d, t in rows], SCHEMA)


# runs


def brute_runs(words, least):
    """(start, length, period) by trying each period from each place."""
    found, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i : i + length]
            if length >= max(least, 2 * q) and not any(all(part[k] == part[k + r] for k in range(length - r)) for r in range(1, q)):
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def some_text(rng):
    n, kinds = rng.choice([0, 1, 5, 20, 60, 120]), rng.choice([1, 2, 2, 3, 10])
    words = [str(rng.randrange(kinds)) for _ in range(n)]
    if n and rng.random() < 0.5:
        a, p = rng.randrange(n), 1 + n // rng.randint(3, 10)
        words = [words[i] if i < a else words[a + (i - a) % min(p, n - a)] for i in range(n)]
    return rng.choice(["", " "]) + " ".join(words) + rng.choice(["", "\n"])


@pytest.mark.parametrize("few", [0, 5, 48])
def test_runs_against_brute_force(monkeypatch, few):
    """Whether positions are refined by arrays or one by one, and with gaps kept in either form."""
    monkeypatch.setattr(runs.Refinement, "FEW", few)
    monkeypatch.setattr(runs._Gaps, "MANY", few)
    rng = random.Random(few)
    for _ in range(60):
        texts = [some_text(rng) for _ in range(rng.randint(1, 12))]
        least = rng.choice([1, 2, 12])
        found = runs.runs_of(split_words(pa.array(texts)), least)
        assert list(zip(*[x.tolist() for x in found], strict=True)) == [(d, *r) for d, t in enumerate(texts) for r in brute_runs(t.split(), least)]


def test_wide_numbers_sort_alike(monkeypatch):
    """Without packed keys, as for texts of millions of words."""
    texts = [some_text(random.Random(k)) for k in range(20)]
    packed = runs.runs_of(split_words(pa.array(texts)))
    monkeypatch.setattr(runs.Refinement, "FEW", 0)
    monkeypatch.setattr(runs.Refinement, "_sorted", lambda self, i: (lambda j: (j, self.label[j], self.label[j + 1]))(i[np.lexsort((i, self.label[i + 1], self.label[i]))]))
    assert all((a == b).all() for a, b in zip(packed, runs.runs_of(split_words(pa.array(texts))), strict=True))


def test_runs_of_hard_rows(spark):
    long = "a b c " * 40_000
    found = runs.find_runs(table(spark, [(1, None), (2, ""), (None, " \n"), (3, "x " * 12), (3, "x " * 12), (4, long), (5, "p\x1cq " * 12)]).repartition(3))
    rows = sorted(((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found.collect()), key=repr)
    assert rows == sorted([(1, 0, [], ""), (2, 0, [], ""), (0, 0, [], ""), (3, 12, [(0, 12, 1)], "x"), (3, 12, [(0, 12, 1)], "x"), (4, 120_000, [(0, 120_000, 3)], "a b c"), (5, 12, [(0, 12, 1)], "p\x1cq")], key=repr)
    assert runs.find_runs(table(spark, [])).count() == 0


def op12_row(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words, 12)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (
        doc_id, len(found), start, length, period, length and 1000 * length // period, hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest(),
    )


def test_op12_against_brute_force(spark, sf_dir):
    found = {r["doc_id"]: tuple(r)[:8] for r in runs.op12_periodic_runs(spark, sf_dir).collect()}
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert set(found) == {d for d, _ in docs}
    short = [(d, t) for d, t in docs if len(t or "") < 6_000]
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in short) > 5
    for d, t in short:
        assert found[d] == op12_row(d, t)


# quality


def test_quality_of_hard_rows(spark):
    good = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)} is" if k % 5 == 0 else f"thing{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)) + "."
    rows = {1: (None, True, False), 2: ("", True, False), 3: (good, False, True), 4: (good.upper(), False, False), 5: ("a b c d e f g h i j " * 60_000, True, False), 6: ("too short", True, False)}
    rows |= {7: (good.replace(" ", " ### "), False, False), 8: ("\n".join(["- " + w for w in good.split()]), False, False), 9: ("1 2 3 4 5 6 7 8 9 " + " ".join(map(str, range(100, 140))), False, False)}
    table_rows = [(d, t) for d, (t, *_) in rows.items()] + [(None, good), (3, good)]
    df = table(spark, table_rows).repartition(3)
    for order in (None, [r.name for r in quality.RULES], [r.name for r in reversed(quality.RULES)]):
        found = sorted((r["doc_id"] or 0, r["base_failed"], r["kept"]) for r in quality.judge_quality(df, order).collect())
        assert found == sorted([(d, *v[1:]) for d, v in rows.items()] + [(0, False, True), (3, False, True)])
    assert quality.judge_quality(table(spark, [])).count() == 0


def test_repeated_windows_against_brute_force():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc" if k % 2 else "abcdefghijklm") for _ in range(rng.choice([0, 7, 8, 9, 40, 300]))) for k in range(60)]
    texts += [t + " " + t for t in texts] + ["a " * 30, None]
    for text, n in zip(texts, quality.Texts(pa.array(texts)).n_repeat_words.tolist(), strict=True):
        words = (text or "").split()
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        assert n == len({j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)})


def test_rules_are_ordered_by_rejections_for_their_cost(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def slow(t):
        sum(range(300_000))
        return t.n_words % 2 == 0

    rules = (quality.Rule("slow", slow), quality.Rule("none", lambda t: t.n_words < 0), quality.Rule("fast", lambda t: t.n_words % 2 == 0))
    found = quality.order_rules(docs, rules=rules)
    assert [e.name for e in found] == ["fast", "slow", "none"]
    assert found[0].rejected == found[1].rejected > 0 and found[0].docs == found[2].docs


# clustering


def brute_clusters(rows, dim=64, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept)[:k]]

    def assign():
        out = []
        for _, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        given = assign()
        for c in range(len(centroids)):
            own = [v for (_, v), (g, _) in zip(kept, given, strict=True) if g == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    given = assign()
    each = {c: sum(d for g, d in given if g == c) for c in range(len(centroids))}
    return sorted((i, c, d, each[c], sum(each.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), (c, d) in zip(kept, given, strict=True))


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster long, distance string")


@pytest.mark.parametrize("spread", [0.01, 1.0, 3_000.0])
def test_clusters_against_brute_force(spark, monkeypatch, spread):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 64)) * 4 * spread
    rows = [(i, (centres[i % 6] + rng.normal(size=64) * spread * (i % 3)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(90)] + [(2000, [1.0] * 63), (2001, [1.0] * 63 + [None]), (2002, [float("nan")] * 64), (2003, None), (2004, [float("inf")] * 64), (2005, [])]
    monkeypatch.setattr(clustering, "TREE", 70)
    found = clustering.cluster(vectors(spark, rows).repartition(3))
    assert sorted(tuple(r) for r in found.collect()) == brute_clusters(rows)


def test_balls_spare_most_looks(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(16, 64)) * 10
    rows = [(i, (centres[i % 16] + rng.normal(size=64)).tolist()) for i in range(3000)]
    tally = clustering.fit(vectors(spark, rows)).tally
    assert tally["n"].sum() == 3000 and tally["looked"].sum() < 1500 and 0 < tally["balls"].sum() < 400


def test_clusters_of_few_tied_and_no_vectors(spark):
    few = [(1, [0.5] * 64), (2, [0.5] * 64), (2, [0.5] * 64), (3, [-0.5] * 64)]
    found = sorted(tuple(r) for r in clustering.cluster(vectors(spark, few, "float")).collect())
    assert found == brute_clusters(few)
    none = clustering.cluster(vectors(spark, [(None, [0.25] * 64), (None, [2e7] * 64)])).collect()  # a null id, and a component that is too large
    assert [(r["vec_id"], r["cluster"], r["distance"]) for r in none] == [(None, 0, 0)]
    assert clustering.cluster(vectors(spark, []).filter(F.lit(False))).count() == 0
