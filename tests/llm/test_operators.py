"""Small cases of each operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from cmdspark.llm import chat, exact_dedup, langid, media, minhash, mixing, packing, toxicity, url_filter, warc
from cmdspark.llm.common import fresh_path, words_count

SCHEMA = "doc_id long, text string, lang string, source string, keep_id string, kept string, size string, id string, node string, key string"


def table(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, None, s, "x", "x", "x", "x", "x", "x") for d, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def hard(spark):
    long = "word " * 60_000
    return table(spark, [(1, "a  b", "s"), (2, "a b", "s"), (2, "a b", "s"), (3, None, None), (4, "", "s"), (None, "a b", "t"), (None, None, "t"), (5, long, "s"), (6, "A b", "s"), (7, "a b ", None)]).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, []).filter(F.lit(False))


# exact dedup


def test_exact_dedup(hard):
    rows = exact_dedup.exact_dedup(hard).collect()
    assert len(rows) == 10
    groups = defaultdict(list)
    for r in rows:
        groups[r["digest"]].append(r)
    ab = groups[hashlib.sha256(b"a b").hexdigest()]
    assert sorted((r["doc_id"] or 99, r["keep_id"], r["group_size"]) for r in ab) == [(1, 1, 4), (2, 1, 4), (2, 1, 4), (99, 1, 4)]
    none = groups[hashlib.sha256(b"").hexdigest()]
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in none} == {(3, 3, True), (4, 3, False), (None, 3, False)}
    assert all(sum(r["kept"] for r in g) == 1 for g in groups.values())


def test_one_of_repeated_rows_stays(spark):
    rows = exact_dedup.exact_dedup(table(spark, [(7, "x", "s"), (7, "x", "s"), (7, "x", "s")])).collect()
    assert sorted(r["kept"] for r in rows) == [False, False, True]


def test_digest_collisions_are_told_apart_by_text(hard):
    """With a digest that has few values every group is still that of equal texts."""
    weak = exact_dedup.exact_dedup(hard, digest=lambda t: F.substring(t, 1, 1).cast("binary")).collect()
    strong = exact_dedup.exact_dedup(hard).collect()
    assert sorted(((r["doc_id"] or 99, r["keep_id"], r["group_size"], r["kept"]) for r in weak), key=repr) == sorted(((r["doc_id"] or 99, r["keep_id"], r["group_size"], r["kept"]) for r in strong), key=repr)


def test_exact_dedup_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0


# media


def test_media_round_trip(spark, hard):
    path = fresh_path(spark, "media-test")
    media.store_media(hard, path)
    rows = media.describe_media(spark, path).collect()
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in hard.collect()]
    want = Counter((d, len(b), hashlib.sha256(p := b + bytes(max(1, -(-len(b) // 64)) * 64 - len(b))).hexdigest(), zlib.crc32(p[-64:])) for d, b in texts)
    stored = {hashlib.sha256(p := b + bytes(max(1, -(-len(b) // 64)) * 64 - len(b))).hexdigest(): (media.encode_image(p, len(b)), p) for _, b in texts}
    for r in rows:
        image, payload = stored[r["payload_sha256"]]
        assert (r["media_bytes"], r["media_sha256"]) == (len(image), hashlib.sha256(image).hexdigest())
        n, mean, deviation, entropy, edge = r["feature"].split(";")
        share = [c / len(payload) for c in Counter(payload).values()]
        assert int(n) * 64 == len(payload)
        assert float(mean) == pytest.approx(sum(payload) / len(payload), abs=1e-3)
        assert float(deviation) == pytest.approx(np.std(list(payload)), abs=1e-3)
        assert float(entropy) == pytest.approx(-sum(s * np.log2(s) for s in share), abs=1e-3)
        assert float(edge) == pytest.approx(np.mean([abs(a - b) for a, b in zip(payload, payload[1:], strict=False)]), abs=1e-3)
    assert Counter((r["id"], r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
    assert all(r["error"] is None for r in rows)


def test_small_ranges_read_every_member_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = fresh_path(spark, "media-test")
    media.store_media(docs, path)
    got = spark.read.format("media_archive").option("range", 700).load(path).select("id").collect()
    assert sorted(r["id"] for r in got) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def test_damaged_member_is_reported_and_others_are_read(spark):
    path = fresh_path(spark, "media-test")
    docs = table(spark, [(i, f"text {i} " * 50, "s") for i in range(5)]).coalesce(1)
    media.store_media(docs, path)
    at = spark.read.format("media_archive").load(path).orderBy("at").collect()[2]
    name = path.removeprefix("file://") + "/" + at["archive"]
    with open(name, "r+b") as f:
        f.seek(at["at"] + 512 + 60)
        f.write(b"\xff\x00\xff")
    rows = {r["id"]: r["error"] for r in media.describe_media(spark, path).collect()}
    assert len(rows) == 5
    assert [i for i, e in rows.items() if e] == [at["id"]]


@pytest.mark.parametrize("size", [700, 4096, 32 << 20])
@pytest.mark.parametrize(("place", "bytes_"), [(0, b"\x00"), (40, b"zz"), (124, b"7"), (130, b"\xff\xff"), (148, b"x"), (512, b"x"), (560, b"\xff\x00\xff")])
def test_damage_anywhere_in_a_member_costs_that_member_only(spark, place, bytes_, size):
    """The first byte, the name, the size field, the header's sum, the image's signature and its content."""
    path = fresh_path(spark, "media-test")
    media.store_media(table(spark, [(i, f"text {i} " * (5 + 40 * (i % 4)), "s") for i in range(40)]).coalesce(1), path)
    members = spark.read.format("media_archive").load(path).orderBy("at").collect()
    for hit in (members[0], members[17], members[39]):
        with open(f"{path.removeprefix('file://')}/{hit['archive']}", "r+b") as f:
            f.seek(hit["at"] + place)
            old = f.read(len(bytes_))
            assert old != bytes_
            f.seek(hit["at"] + place)
            f.write(bytes_)
    rows = spark.read.format("media_archive").option("range", size).option("tries", 1).load(path).collect()
    damaged = {0, 17, 39}
    assert sorted(r["id"] for r in rows if not r["error"]) == sorted(m["id"] for k, m in enumerate(members) if k not in damaged)
    assert sorted(r["at"] for r in rows if r["error"]) == sorted(members[k]["at"] for k in damaged)


def test_a_cut_archive_is_reported(spark):
    path = fresh_path(spark, "media-test")
    media.store_media(table(spark, [(i, "text " * 300, "s") for i in range(6)]).coalesce(1), path)
    members = spark.read.format("media_archive").load(path).orderBy("at").collect()
    with open(f"{path.removeprefix('file://')}/{members[4]['archive']}", "r+b") as f:
        f.truncate(members[4]["at"])
    rows = media.describe_media(spark, path).collect()
    assert sum(r["error"] is None for r in rows) == 4
    assert sum(r["error"] is not None for r in rows) == 1


def test_media_empty(spark, empty):
    path = fresh_path(spark, "media-test")
    media.store_media(empty, path)
    assert media.describe_media(spark, path).count() == 0


def test_payload_that_holds_an_archive_is_one_member(spark):
    inner = media._header("x/1.png", 10).decode("latin-1")
    path = fresh_path(spark, "media-test")
    media.store_media(table(spark, [(1, inner * 20, "s"), (2, "b", "s")]), path)
    assert spark.read.format("media_archive").option("range", 512).load(path).count() == 2


# packing


@pytest.mark.parametrize("group_pieces", [50_000, 60])
def test_packing_is_whole_and_gapless(spark, sf_dir, group_pieces):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack_documents(docs, group_pieces=group_pieces).collect()
    folder = packing.tokenizer_folder()
    ids = {r["doc_id"]: packing.token_ids(r["text"] or "", folder) for r in docs.collect()}
    sequences = defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    bound = packing.lower_bound(np.array([r["length"] for r in rows]), 2048)
    assert bound <= len(sequences) <= bound * 1.05 + 2


def test_certificates_can_be_read_from_the_result(spark):
    """Groups name their bins and bound; bins of certified groups are as many as said, and exchange never costs bins."""
    rng = np.random.default_rng(14)
    lengths = rng.integers(1, 21, 3000)
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "key long, length long")
    rows = packing.pack(pieces, capacity=20, group_pieces=150).collect()
    assert len(rows) == 3000
    bins, groups = defaultdict(int), defaultdict(set)
    for r in rows:
        bins[r["sequence_id"]] += int(lengths[r["key"]])
        groups[r["group_id"], r["group_bins"], r["group_bound"]].add(r["sequence_id"])
    assert max(bins.values()) <= 20
    assert len({g for g, _, _ in groups}) == len(groups)
    for (_, made, bound), own in groups.items():
        assert bound <= made
        assert len(own) == made if made == bound else len(own) <= made
    one = packing.pack(pieces, capacity=20, group_pieces=5000).select("sequence_id").distinct().count()
    first = sum(made for (g, made, _) in {(g, made, bound) for g, made, bound in groups} if g < 1 << 26)
    assert packing.lower_bound(lengths, 20) <= one <= len(bins) <= first


def test_ids_are_those_of_the_vocabulary_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("", "Hello  world's\n\n\t end", "Éçêñ 中文 1234 ...", " lead", "x" * 5000):
        assert packing.token_ids(text, packing.tokenizer_folder()).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("text", ["<|endoftext|>", "one<|endoftext|> two <|endoftext|>", "<|endoftext", "a" + " " * 1_000_000 + "b", "\n" * 1_000_000, "\u00a0" * 1_000_000 + " x", "a " * 500_000, "  x" * 300_000])
def test_special_tokens_and_long_runs_have_the_ids_of_the_vocabulary_file(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.token_ids(text, packing.tokenizer_folder()).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 0]


def test_packing_hard_rows(hard, empty):
    rows = packing.pack_documents(hard).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter({1: 1, 2: 2, 3: 1, 4: 1, None: 2, 5: 1, 6: 1, 7: 1})
    assert {r["length"] for r in rows if r["doc_id"] in (3, 4)} == {1}
    assert all(r["length"] == 2048 for r in rows if r["doc_id"] == 5 and r["piece"] > 0)
    assert packing.pack_documents(empty).count() == 0


def test_best_fit_and_bound_against_brute_force():
    rng = np.random.default_rng(0)

    def fewest(items, cap):
        best = [len(items)]

        def place(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= cap:
                    bins[k] += items[i]
                    place(i + 1, bins)
                    bins[k] -= items[i]
            place(i + 1, [*bins, items[i]])

        place(0, [])
        return best[0]

    for _ in range(30):
        items = rng.integers(1, 21, 8)
        bins, offsets = packing.best_fit_decreasing(items, 20)
        assert packing.lower_bound(items, 20) <= fewest(sorted(items.tolist(), reverse=True), 20) <= bins.max() + 1
        assert max(np.bincount(bins, weights=items)) <= 20
        assert len({(b, o) for b, o in zip(bins, offsets, strict=True)}) == 8


# chat


def chat_rows(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_folding_deltas_edits_and_regenerations(spark):
    log = spark.createDataFrame(
        [(1, 1, 1, "delta", "user", "He"), (1, 1, 2, "delta", None, "llo"), (1, 2, 3, "delta", "assistant", "bad"), (1, 2, 4, "regenerate", None, None), (1, 2, 5, "delta", None, "go"), (1, 2, 6, "delta", None, "od"), (1, 1, 7, "edit", None, "Hi"), (1, 1, 8, "delta", None, "!"), (1, 3, 9, "other", "user", "x")],
        "conv_id long, message long, seq long, kind string, role string, text string",
    )
    got = {r["message"]: (r["role"], r["text"]) for r in chat.reconstruct(log).collect()}
    assert got == {1: ("user", "Hi!"), 2: ("assistant", "good")}


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "</s>[INST] <|im_start|>x<\\ [\\[ \\ <|im_end|>\n"), (1, 1, "assistant", "<"), (1, 2, "assistant", None), (1, 2, "assistant", None), (2, None, None, ""), (None, 0, "<|im_end|>", "é" * 9000), (3, 0, "assistant", "[" * 500)]
    rendered = chat.render(chat.reconstruct(chat.message_log(chat_rows(spark, rows))))
    back = {r["conv_id"]: r for r in chat.read_back(rendered).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [("user", rows[0][3]), ("assistant", "<"), ("assistant", ""), ("assistant", "")]
    assert back[1]["trained"] == "<"
    assert back[None]["turns"][0]["text"] == "é" * 9000
    assert back[None]["turns"][0]["role"] == "<|im_end|>"
    assert back[3]["trained"] == "[" * 500
    for control in ("</s>", "[INST]", "[/INST]"):
        assert control not in back[1]["formatted"]
    spans = {r["conv_id"]: r for r in rendered.collect()}
    s = spans[3]["loss_spans"][0]
    assert spans[3]["formatted"][s["start"] : s["start"] + s["length"]].replace("[\\", "[") == "[" * 500


def test_a_long_conversation(spark):
    """Spans over thousands of turns, in time that grows with their number."""
    times = {}
    for n in (500, 4000, 16000):
        rows = chat_rows(spark, [(1, i, "assistant" if i % 2 else "user", f"t{i}[") for i in range(n)])
        began = time.perf_counter()
        r = chat.render(rows.withColumnRenamed("turn", "message")).collect()[0]
        times[n] = time.perf_counter() - began
        assert r["n_turns"] == n
        assert [s["turn"] for s in r["loss_spans"]] == list(range(1, n, 2))
        for s in (r["loss_spans"][0], r["loss_spans"][n // 4], r["loss_spans"][-1]):
            assert r["formatted"][s["start"] : s["start"] + s["length"]] == f"t{s['turn']}[\\"
    assert times[16000] < 20 * max(times[4000], 0.5)


def test_chat_empty(spark):
    assert chat.render(chat.reconstruct(chat.message_log(chat_rows(spark, []).filter(F.lit(False))))).count() == 0


def test_ranges_grow_with_the_archives():
    assert media.range_bytes(0) == media.range_bytes(1 << 40) == media.RANGE_BYTES
    assert (100 << 40) / media.range_bytes(100 << 40) <= media.MOST_RANGES


# language ID


def test_language_accuracy_on_held_out_rows(spark, sf_dir):
    rows = langid.op5_language_id(spark, sf_dir).filter("held_out").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_hard_rows(spark, hard, empty, sf_dir):
    model = langid.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = langid.identify(table(spark, [(1, None, "s"), (2, "", "s"), (3, "12 !? 9", "s"), (None, "the of and " * 9, "s")]), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in rows} == {1: "und", 2: "und", 3: "und", None: "en"}
    assert langid.identify(hard, model).count() == 10
    assert langid.identify(empty, model).count() == 0
    nothing = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.identify(hard, nothing).collect()} == {"und"}


@pytest.mark.parametrize("n", [1, 2, 4, 6, 7, 9, 20, 128, 129, 1000])
def test_codewords_differ(n):
    code = langid.codewords(n).astype(int)
    assert len({tuple(r) for r in code.tolist()}) == n or n == 1
    if n > 2:
        apart = (code.shape[1] - code @ code.T) // 2 + code.shape[1] * np.eye(n, dtype=int)
        assert apart.min() >= (2 if n <= 6 else 4 if n <= 8 else 8 if n <= 128 else 30)
    assert code.shape[1] <= 128


def test_a_thousand_languages_are_fitted_in_seconds(spark):
    rows = [(k, f"w{k}x " * 20 + "".join(chr(97 + (k >> 3 * i) % 8) for i in range(4)) * 8, f"l{k}") for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    began = time.perf_counter()
    model = langid.fit(docs)
    assert time.perf_counter() - began < 60
    assert len(model["languages"]) == 1000 and model["weights"].shape[0] <= 128


def test_fit_is_that_of_whole_counts(spark, sf_dir):
    """Weights and trust from the languages' counts in one table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs, per_language=10**9)
    table_ = np.zeros((len(model["languages"]), langid.FEATURES))
    for r in docs.filter("lang is not null").select("lang", "text").collect():
        f = langid.ngram_features(np.frombuffer(r["text"].encode(), np.uint8)).ravel()
        table_[model["languages"].index(r["lang"])] += np.bincount(f[f >= 0], minlength=langid.FEATURES)
    chance = (table_ + 0.5) / (table_.sum(axis=1, keepdims=True) + 0.5 * langid.FEATURES)
    code = model["code"]
    want = np.array([np.log(chance[code[:, k] == 1].mean(axis=0)) - np.log(chance[code[:, k] == -1].mean(axis=0)) for k in range(code.shape[1])])
    assert np.allclose(model["weights"], want, atol=1e-4)
    margins = ((table_ @ want.T) / table_.sum(axis=1, keepdims=True) * code).min(axis=0)
    assert np.allclose(model["trust"], np.maximum(margins, 1e-3) / np.maximum(margins, 1e-3).sum(), atol=1e-4)


def test_rows_without_an_id_and_with_a_repeated_one_are_sampled_like_others(spark):
    rows = [(None, f"the of and word{i}", "en") for i in range(3000)] + [(7, f"der die das wort{i}", "de") for i in range(3000)] + [(i, f"le la les mot{i}", "fr") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taken = {}
    real = langid.materialize
    langid.materialize = lambda df, tag: taken.setdefault(tag, real(df, tag))
    try:
        model = langid.fit(docs, per_language=300)
    finally:
        langid.materialize = real
    assert model["languages"] == ["de", "en", "fr"]
    words = {r["lang"]: r["n"] for r in taken["lang-counts"].groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    assert 200 * 40 < words["en"] < 400 * 63 and 200 * 40 < words["de"] < 400 * 66


def brute_language(text, model):
    """Every n-gram of the text looked up by itself, every codeword's loss summed bit by bit."""
    data = text.encode("utf-8", "surrogatepass").lower() if text.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode("utf-8", "surrogatepass"))
    grams, margins = 0, [0.0] * model["code"].shape[1]
    for i in range(len(data)):
        for n in (1, 2, 3):
            if i + 1 >= n:
                feature = int(langid.ngram_features(np.frombuffer(data[i + 1 - n : i + 1], np.uint8))[n - 1, -1])
                grams += 1
                for k in range(len(margins)):
                    margins[k] += float(model["weights"][k, feature])
    losses = {}
    for name, word in zip(model["languages"], model["code"].tolist(), strict=True):
        losses[name] = sum(t * np.log1p(np.exp(-c * 2.0 * m / grams**0.5)) for t, c, m in zip(model["trust"], word, margins, strict=True))
    best = min(losses, key=losses.get)
    return best, 1.0 / sum(np.exp(-4.0 * (x - losses[best])) for x in losses.values())


def test_decoding_against_brute_force(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fitted = langid.fit(docs)
    texts = [r["text"][:400] for r in docs.filter("length(text) > 50").limit(12).collect()] + ["a", "Ü", "ab é", "THE OF"]
    rng = np.random.default_rng(15)
    code = langid.codewords(9)
    weights = rng.normal(0, 0.05, (code.shape[1], langid.FEATURES)).astype(np.float32)
    many = {"languages": [f"l{i}" for i in range(9)], "weights": weights, "code": code, "trust": rng.dirichlet(np.ones(code.shape[1]))}
    for model in (fitted, many):
        for piece in (1 << 21, 17):  # pieces of long texts overlap, so that no n-gram is lost
            monkeypatch.setattr(langid, "PIECE", piece)
            got = next(langid._predict(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])]), model)).to_pylist()
            for text, r in zip(texts, got, strict=True):
                lang, score = brute_language(text, model)
                assert (r["lang_pred"], r["score"]) == (lang, pytest.approx(score, abs=1e-6))
                assert r["ambiguous"] == (score < 0.6)


def test_nine_languages_are_fitted(spark):
    rng = np.random.default_rng(16)
    vocabulary = {f"l{k}": ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(30)] for k in range(9)}
    rows = [(i, " ".join(rng.choice(vocabulary[f"l{i % 9}"], 40)), f"l{i % 9}") for i in range(540)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.filter("doc_id < 360"))
    got = langid.identify(docs.filter("doc_id >= 360"), model).collect()
    assert np.mean([r["lang_pred"] == f"l{r['doc_id'] % 9}" for r in got]) > 0.95


# WARC


def test_pages_of_any_scheme_are_responses(spark):
    urls = ["dns:a.org", "http://a/", "WHOIS://x", "ftp://f/g", "", None, "whois:HTTP/1.1"]
    pages = spark.createDataFrame([(k, u, f"HTTP/1.1 hello {k}\r\n\r\n" * 60) for k, u in enumerate(urls)] + [(100, "dns:b.org", "HTTP/1.1 hello 0\r\n\r\n" * 60)], "page_id long, url string, html string")
    arcs, warcs = fresh_path(spark, "arc-test"), fresh_path(spark, "warc-test")
    rows = {r["id"]: r for r in warc.read_warc(warc.convert_arc(warc.write_arc(pages, arcs), arcs, warcs), warcs).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in rows.items()} == {0: ("revisit", 100), 100: ("response", None)} | {k: ("response", None) for k in range(1, len(urls))}
    for r in pages.collect():
        assert (rows[r["page_id"]]["payload_bytes"], rows[r["page_id"]]["payload_digest"]) == (len(r["html"]), hashlib.sha1(r["html"].encode()).hexdigest())


def test_arc_to_warc_against_brute_force(spark):
    big, small = "<p>é</p>" * 200, "<p>s</p>"
    pages = spark.createDataFrame([(1, "http://a/ b", big, 0), (2, None, big, 0), (3, "http://c", small, 0), (4, "http://d", small, 0), (5, "http://e", None, 0), (None, "http://f", big, 0), (9, "http://g\nx", "\r\n\r\n" + big, 0)], "page_id long, url string, html string, archive int").repartition(2)
    arcs, warcs = fresh_path(spark, "arc-test"), fresh_path(spark, "warc-test")
    files = warc.convert_arc(warc.write_arc(pages, arcs), arcs, warcs)
    rows = {r["id"]: r for r in warc.read_warc(files, warcs).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in rows.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), None: ("revisit", 2), 9: ("response", None)}
    for r in pages.collect():
        payload = (r["html"] or "").encode()
        assert rows[r["page_id"]]["payload_bytes"] == len(payload)
        assert rows[r["page_id"]]["payload_digest"] == hashlib.sha1(payload).hexdigest()
    assert rows[1]["warc_date"] == "2000-01-01T00:00:00Z"
    assert len({r["record_id"] for r in rows.values()}) == 7


def test_arc_versions():
    for version, line in (("1", "http://a 1.2.3.4 20010101000000 text/html 5"), ("2", "http://a 1.2.3.4 20010101000000 text/html 200 - - 0 f.arc 5")):
        fields = warc.arc_fields(f"filedesc://f 0.0.0.0 2001 text/plain 9\n{version} 0 x\n".encode())
        record, block = warc.parse_arc(f"{line}\nhello\nrest".encode(), fields)
        assert (record["URL"], block) == ("http://a", b"hello")
    with pytest.raises(ValueError, match="declared"):
        warc.parse_arc(b"http://a 1.2.3.4 2001 text/html 50\nshort", warc.ARC_FIELDS["1"].split(" "))


def test_version_2_fields_name_the_file_and_place_of_the_record(monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ROLL", 400)  # a file holds a record or two
    pages = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array([f"http://a/{i}" for i in range(12)]), pa.array(["x" * 90 * i for i in range(12)])], ["id", "url", "html"])
    files = [r for b in warc._write_arc(iter([pages]), str(tmp_path), "20000101000000") for r in b.to_pylist()]
    seen = 0
    for f in files:
        with open(tmp_path / f["archive"], "rb") as stream:
            members = list(warc.gzip_members(stream))
        fields = warc.arc_fields(members[0][2])
        for at, _, content in members[1:]:
            record, block = warc.parse_arc(content, fields)
            seen += 1
            if "Offset" in record:
                assert (int(record["Offset"]), record["Filename"]) == (at, f["archive"])
                assert record["Checksum"] == hashlib.md5(block).hexdigest()
    assert seen == 12
    assert len(files) > 4


@pytest.mark.parametrize(("date", "want"), [("20010203040506", "2001-02-03T04:05:06Z"), ("199609231205", "1996-09-23T12:05:00Z"), ("19960923", "1996-09-23T00:00:00Z"), ("1996", "1996-01-01T00:00:00Z"), ("19961399", None), ("x", None), ("199", None)])
def test_arc_dates_by_their_length(date, want):
    assert warc.warc_date(date) == want


def test_hand_written_records_get_their_types(spark):
    """dns, ftp, text without HTTP, a URL with a blank, short dates, and the version block."""
    folder, out = fresh_path(spark, "arc-test"), fresh_path(spark, "warc-test")
    warc.make_folder(folder)
    http = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\npage"
    records = [
        ("http://a/b c", "199609231205", "text/html", http), ("dns:a.org", "19960923", "text/dns", b"HTTP/1 is a name"), ("ftp://a/f", "bad", "image/gif", b"GIF\r\n\r\n89a"),
        ("http://a/old", "19960923010203", "no-type", b"plain\r\n\r\nold"), ("https://b/", "20010101000000", "text/html", http),
    ]
    version = b"1 0 hand\n" + warc.ARC_FIELDS["1"].encode() + b"\n"
    data = warc._gz(b"filedesc://h.arc 0.0.0.0 19960101000000 text/plain %d\n" % len(version) + version + b"\n")
    for url, date, kind, block in records:
        data += warc._gz(f"{url} 1.2.3.4 {date} {kind} {len(block)}\n".encode() + block + b"\n")
    with open(folder.removeprefix("file://") + "/h.arc.gz", "wb") as f:
        f.write(data)
    files = warc.convert_arc(spark.createDataFrame([("h.arc.gz", len(data))], "archive string, bytes long"), folder, out)
    rows = {r["url"]: r for r in warc.read_warc(files, out, infos=True).collect()}
    assert {u: (r["record_type"], r["warc_date"], r["payload_bytes"]) for u, r in rows.items()} == {
        None: ("warcinfo", "1996-01-01T00:00:00Z", None), "http://a/b c": ("response", "1996-09-23T12:05:00Z", 4), "dns:a.org": ("resource", "1996-09-23T00:00:00Z", 16),
        "ftp://a/f": ("resource", "1996-01-01T00:00:00Z", 10), "http://a/old": ("resource", "1996-09-23T01:02:03Z", 12), "https://b/": ("response", "2001-01-01T00:00:00Z", 4),
    }
    kinds, infos = {}, set()
    for f in files.collect():
        with open(f"{out.removeprefix('file://')}/{f['archive']}", "rb") as stream:
            for _, _, content in warc.gzip_members(stream):
                fields, block = warc.parse_warc(content)
                kinds[fields.get("WARC-Target-URI")] = fields["Content-Type"]
                infos.add(fields.get("WARC-Warcinfo-ID"))
                if fields["WARC-Type"] == "warcinfo":
                    assert fields["WARC-Record-ID"] == warc.record_id("h.arc.gz", 0)
                    assert b"ARC version 1\r\n" in block
    assert kinds == {None: "application/warc-fields", "http://a/b c": "application/http; msgtype=response", "dns:a.org": "text/dns", "ftp://a/f": "image/gif", "http://a/old": "application/octet-stream", "https://b/": "application/http; msgtype=response"}
    assert infos == {None, warc.record_id("h.arc.gz", 0)}


def test_warc_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    arcs, warcs = fresh_path(spark, "arc-test"), fresh_path(spark, "warc-test")
    assert warc.read_warc(warc.convert_arc(warc.write_arc(pages, arcs), arcs, warcs), warcs).count() == 0


# near duplicates


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(docs):
    """Least id of each connected component at similarity 0.8."""
    label = {d: d for d, _ in docs}
    sets = {d: shingles(t or "") for d, t in docs}
    words = {d: (t or "").split() for d, t in docs}
    while True:
        old = dict(label)
        for a in label:
            for b in label:
                both = len(sets[a] & sets[b])
                if words[a] == words[b] or both and both / len(sets[a] | sets[b]) >= 0.8:
                    label[a] = label[b] = min(label[a], label[b])
        if old == label:
            return label


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(4)
    docs = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 900, 200)]
        docs.append(" ".join(base))
        for edits in (1, 2, 3, 4, 5, 8, 12, 20):
            copy = list(base)
            for at in rng.integers(0, 200, edits):
                copy[at] = f"e{rng.integers(0, 10**6)}"
            docs.append(" ".join(copy))
    docs += ["one two", "one  two", "", None, "a b c d e", "a b c d f"]
    rows = list(enumerate(docs))
    want = brute_classes(rows)
    for block in (512, 3):  # small blocks split every bucket
        got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(table(spark, [(d, t, "s") for d, t in rows]), block=block).collect()}
        assert got == want


def test_near_duplicates_with_repeated_lines(spark):
    rng = np.random.default_rng(6)
    docs = []
    for _ in range(16):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
        docs.append(" ".join(base))
        for edits in (0, 3):  # set Jaccard 0.98 and about 0.86 with the base, however often the lines are repeated
            copy = list(base)
            for at in rng.integers(0, 160, edits):
                copy[at] = f"e{rng.integers(0, 10**6)}"
            docs.append(" ".join(copy + base[-40:] * 200))
    rows = list(enumerate(docs))
    want = brute_classes(rows)
    assert len(set(want.values())) == 16
    for block in (512, 2):
        got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(table(spark, [(d, t, "s") for d, t in rows]), block=block).collect()}
        assert got == want


def test_recall_near_the_threshold(spark):
    """Pairs at a set Jaccard of 0.80 to 0.85, half of them with a passage that one side repeats: at least 0.95 are found, and no pair under 0.8."""
    rng = np.random.default_rng(12)
    docs, pairs, far = [], [], []
    while len(pairs) < 150 or len(far) < 50:
        base = [f"w{x}" for x in rng.integers(0, 10**7, 300)]
        copy = list(base)
        for at in rng.choice(250, int(rng.integers(5, 11)), replace=False):
            copy[at] = f"e{rng.integers(0, 10**7)}"
        if len(docs) % 4:
            copy += base[-30:] * 50
        a, b = " ".join(base), " ".join(copy)
        same = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        if 0.8 <= same <= 0.85 and len(pairs) < 150:
            pairs.append(len(docs))
        elif 0.7 <= same < 0.8 and len(far) < 50:
            far.append(len(docs))
        else:
            continue
        docs += [a, b]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(table(spark, [(d, t, "s") for d, t in enumerate(docs)])).collect()}
    recall = np.mean([got[i] == got[i + 1] for i in pairs])
    print(f"recall {recall:.3f}")
    assert recall >= 0.95
    assert not any(got[i] == got[i + 1] for i in far)


def test_a_bucket_with_one_large_class_and_others(spark):
    """A class of many near copies shares its buckets with texts that are no copies; blocks are small, so the class has many."""
    rng = np.random.default_rng(13)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
    docs = []
    for i in range(60):
        copy = list(base)
        copy[i] = f"e{i}"
        docs.append(" ".join(copy))
    for i in range(12):  # half of the words are the class's
        docs.append(" ".join(base[:95] + [f"o{i // 3}x{k}" for k in range(25)] + [f"t{i}"]))
    rows = list(enumerate(docs))
    want = brute_classes(rows)
    for block in (512, 7):
        got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(table(spark, [(d, t, "s") for d, t in rows]), block=block).collect()}
        assert got == want


def test_near_duplicates_hard_rows(hard, empty):
    rows = minhash.near_duplicates(hard).collect()
    assert len(rows) == 10
    by = defaultdict(list)
    for r in rows:
        by[r["class_id"]].append(r)
    assert all(sum(r["kept"] for r in g) == 1 for g in by.values())
    assert len(by[1]) == 5
    assert minhash.near_duplicates(empty).count() == 0


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    m, n = 2048, 300
    e = rng.integers(0, 1 << 44, n).astype(np.uint64)
    w1, w2 = rng.integers(1, 5, n).astype(float), rng.integers(1, 5, n).astype(float)
    w1[:40] = 0
    w2[-40:] = 0
    a, b = w1 > 0, w2 > 0
    sig = minhash.prob_minhash(np.concatenate([e[a], e[b]]), np.repeat([0, 1], [a.sum(), b.sum()]), np.concatenate([w1[a], w2[b]]), 2, m)
    exact = sum(1 / np.maximum(w1 / w1[i], w2 / w2[i]).sum() for i in range(n) if w1[i] and w2[i])
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.04


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    text = "  alpha\tbeta  gamma\n" * 50 + "x" * 300
    data = np.frombuffer(text.encode(), np.uint8)
    bounds = np.array([0, 7, 7, 400, len(data)])
    whole = minhash.word_hashes(data, bounds)
    monkeypatch.setattr(minhash, "PIECE", 16)
    parts = minhash.word_hashes(data, bounds)
    assert (whole[0] == parts[0]).all()
    assert (whole[1] == parts[1]).all()


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(60)] + [(b"\xf0", b"\xf1")], "left binary, right binary")
    got = {bytes(r["node"]): bytes(r["comp"]) for r in minhash.components(links).collect()}
    assert {got[bytes([i])] for i in range(61)} == {b"\x00"}
    assert got[b"\xf1"] == b"\xf0"


# toxicity


def test_matching_folds_and_excepts():
    m = toxicity.Matcher({"idiot": 3.0, "clown": 2.0, "lowei*": 4.0})
    assert m.weight("You IDIOT!") == 3.0
    assert m.weight("you 1d10t") == 3.0
    assert m.weight("you іdiоt") == 3.0  # Cyrillic letters
    assert m.weight("a clown fish") == 0.0
    assert m.weight("a clown fish, a clown") == 2.0
    assert m.weight("idiotic") == 0.0
    assert m.weight("loweischaft slowei") == 4.0
    assert m.weight("10 101 3.14") == 0.0
    assert toxicity.Matcher({}, ()).weight("idiot") == 0.0


def test_styled_letters_and_invisible_characters_fold(spark):
    m = toxicity.Matcher({"idiot": 3.0})
    for text in ("ｉｄｉｏｔ", "𝐢𝐝𝐢𝐨𝐭", "ⓘⓓⓘⓞⓣ", "id\u200biot", "i\u00addio\u2060t", "ＩＤＩＯＴ"):
        assert m.weight(text) == 3.0, text
        folded = spark.createDataFrame([(text,)], "t string").select(toxicity.fold_column(F.col("t")).alias("f")).first()["f"]
        assert folded == toxicity.fold(text) == "idiot"


def brute_weight(text, lexicon, exceptions):
    """Every entry tried at every place, every hit held against every exception."""

    def scan(t):
        edge = lambda i: not 0 <= i < len(t) or not t[i].isalnum()
        best = {}
        for word, weight in lexicon.items():
            w = word.rstrip("*")
            for i in range(len(t)):
                if t.startswith(w, i) and edge(i - 1) and (word.endswith("*") or edge(i + len(w))) and (i not in best or best[i][1] < weight):
                    best[i] = (i + len(w) - 1, weight)
        spans = [(i, i + len(x) - 1) for x in exceptions for i in range(len(t)) if t.startswith(x, i) and edge(i - 1) and edge(i + len(x))]
        return {i: (e, w) for i, (e, w) in best.items() if not any(a <= i and e <= b for a, b in spans)}

    plain = toxicity.fold(text)
    hits = scan(plain)
    for i, (e, w) in scan("".join(toxicity.DIGITS.get(c, c) for c in plain)).items():
        if i not in hits and any(c.isalpha() for c in plain[i : e + 1]):
            hits[i] = (e, w)
    return sum(w for _, w in hits.values())


def test_matching_against_brute_force():
    lexicon = {"clown": 2.0, "fish": 1.0, "trash": 3.0, "tra*": 0.5, "can": 0.25, "trash can*": 8.0}
    exceptions = ("clown fish", "trash can", "a trash can do", "fish can")
    m = toxicity.Matcher(lexicon, exceptions)
    rng = np.random.default_rng(9)
    words = ["clown", "fish", "trash", "can", "do", "a", "cl0wn", "tr4sh", "trashy", "canny", "$", "f1sh,", "10"]
    for _ in range(300):
        text = " ".join(rng.choice(words, int(rng.integers(1, 12))))
        assert m.weight(text) == pytest.approx(brute_weight(text, lexicon, exceptions)), text


def test_many_exceptions_take_linear_time():
    m = toxicity.Matcher(toxicity.SEED_LEXICON)
    began = time.perf_counter()
    assert m.weight("trash can " * 200_000) == 0.0
    assert time.perf_counter() - began < 15


def test_scores():
    assert toxicity.score_from(0, 10) < 0.1
    assert toxicity.score_from(3.0, 200) > 0.7
    assert toxicity.score_from(3.0, 200) > toxicity.score_from(3.0, 2000)


def test_toxicity_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = toxicity.op8_toxicity(spark, sf_dir).filter("held_out").join(labels, "doc_id").collect()
    bad = [r["predicted"] for r in rows if r["toxic"]]
    good = [r["predicted"] for r in rows if not r["toxic"]]
    assert np.mean(bad) > 0.6
    assert np.mean(good) < 0.05


def test_toxicity_hard_rows(spark, hard, empty):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    lexicon = toxicity.learn_lexicon(hard, labels)
    assert lexicon == toxicity.SEED_LEXICON
    assert toxicity.score_toxicity(hard, lexicon).filter("score >= 0.7").count() == 0
    assert toxicity.score_toxicity(empty, lexicon).count() == 0
    assert toxicity.drop_toxic(hard, lexicon).columns == hard.columns


def test_learned_stem(spark):
    rows = [(i, f"plain words number{i} here" + (f" zorgex{i % 5} now" if i % 4 == 0 else ""), "s") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    lexicon = toxicity.learn_lexicon(table(spark, rows), labels, seed={})
    assert list(lexicon) == ["zorgex*"]


def brute_lexicon(docs, labels, share=0.75):
    """Stems and weights counted document by document: the ties to toxic ones that chance would hardly make."""
    bags = {}
    for d, text in docs:
        if d in labels:
            bag = frozenset(regex.findall(toxicity.WORD, toxicity.fold(text or "")))
            bags[bag] = max(bags.get(bag, 0), labels[d])
    total, bad = len(bags), sum(bags.values())
    counts = defaultdict(lambda: [0, 0])
    for bag, label in bags.items():
        for stem in {w[:n] for w in bag for n in range(4, min(12, len(w)) + 1)}:
            counts[stem][0] += label
            counts[stem][1] += 1
    base, needed, strong = bad / total, math.log(100.0 * len(counts)), {}
    for stem, (b, n) in counts.items():
        rate = b / n
        strength = n * (rate * math.log(rate / base) + ((1 - rate) * math.log((1 - rate) / (1 - base)) if rate < 1 else 0.0)) if b else 0.0
        if rate >= share and strength >= needed:
            strong[stem] = strength
    kept = []
    for stem in sorted(strong, key=lambda x: (-strong[x], -len(x), x)):
        begins_kept = any(stem.startswith(k) for k in kept)
        covered = max((counts[k][0] for k in kept if k.startswith(stem)), default=0)
        if not begins_kept and covered < 0.5 * counts[stem][0]:
            kept.append(stem)
    weight = lambda b, n: math.log((b + 0.5) / (bad + 1)) - math.log((n - b + 0.5) / (total - bad + 1))
    return {f"{k}*": pytest.approx(weight(*counts[k])) for k in kept}


def test_lexicon_against_brute_force(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 14))) for _ in range(150)]
    docs, labels = [], {}
    for d in range(500):
        text = rng.choices(words, k=rng.randint(1, 30))
        toxic = rng.random() < 0.2
        if toxic:
            text += rng.sample(["xylobad", "xylobadly", "xylobar", "qwordness"], 2)
        elif rng.random() < 0.02:
            text.append("qwordness")
        docs.append((d, " ".join(rng.sample(text, len(text)))))
        if d % 7:
            labels[d] = int(toxic)
    docs += [(1000, docs[1][1]), (1001, None)]
    labels |= {1000: 1, 1001: 0}
    rows = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    found = toxicity.learn_lexicon(spark.createDataFrame(docs, "doc_id long, text string"), rows, seed={})
    want = brute_lexicon(docs, labels)
    assert found == want and len(want) > 1


# mixing


def water_fill(sizes, weights, share, cap):
    """Targets by repeated sharing of what is over the limits."""
    target, left, open_ = dict.fromkeys(sizes, 0.0), share * sum(sizes.values()), set(sizes)
    while open_ and left > 1e-9:
        total = sum(weights[s] for s in open_)
        given = {s: left * weights[s] / total for s in open_}
        left = 0.0
        for s, g in given.items():
            target[s] += g
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


def test_mixing_targets(spark):
    rng = np.random.default_rng(2)
    names = ["b", "a", "Z", "é", None, "c"]
    rows = [(i, "w " * int(rng.integers(0, 60)), names[min(5, int(rng.integers(0, 9)))]) for i in range(600)]
    docs = table(spark, rows)
    got = mixing.mix(docs, words_count(F.col("text")), buckets=8).collect()
    assert len(got) == 600
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    order = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None]
    want = water_fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5, 2.0)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["size"] * r["copies"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix(docs.repartition(5), words_count(F.col("text")), buckets=8).collect()
    assert Counter((r["doc_id"], r["copies"]) for r in again) == Counter((r["doc_id"], r["copies"]) for r in got)


def test_mixing_hard_rows(hard, empty):
    rows = mixing.mix(hard, words_count(F.col("text"))).collect()
    assert len(rows) == 10
    assert {r["size"] for r in rows if r["doc_id"] in (3, 4)} == {0}
    assert mixing.mix(empty, words_count(F.col("text"))).count() == 0


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(40):
        lengths = np.unique(rng.integers(1, 30, 5))
        counts = rng.integers(1, 3, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 3))
        sums = {0}
        for length, count in zip(lengths, counts, strict=True):
            sums = {s + k * length for s in sums for k in range(count + 1)}
        taken = mixing.choose_counts(lengths, counts, budget)
        assert (taken <= counts).all()
        got = int((taken * lengths).sum())
        assert abs(got - budget) <= budget - max(s for s in sums if s <= budget)


@pytest.mark.parametrize("budget", [20_000, 60_000, 99_000, 101_000, 400_000])
def test_every_length_gets_its_share_of_any_budget(budget):
    rng = np.random.default_rng(7)
    lengths, counts = np.unique(rng.integers(1, 1001, 2000), return_counts=True)
    taken = mixing.choose_counts(lengths, counts, budget)
    assert (taken * lengths).sum() == budget
    assert (taken <= counts).all()
    share = budget / (lengths * counts).sum()
    for low in range(0, 1000, 250):
        here = (lengths > low) & (lengths <= low + 250)
        assert (taken * lengths)[here].sum() == pytest.approx(share * (lengths * counts)[here].sum(), rel=0.15, abs=1000)


def test_a_million_documents_of_one_length():
    began = time.perf_counter()
    taken = mixing.choose_counts(np.array([1, 7]), np.array([1_000_000, 1_000_000]), 99_001)
    assert taken @ [1, 7] == 99_001
    assert mixing.knapsack(np.array([1]), np.array([1_000_000]), 99_000).tolist() == [99_000]
    assert time.perf_counter() - began < 2


def test_lengths_without_a_common_sum_come_near():
    taken = mixing.choose_counts(np.array([70_000, 200_000]), np.array([50, 50]), 1_234_567)
    assert 0 <= 1_234_567 - taken @ [70_000, 200_000] < 70_000


# URL filters


def test_rules_of_the_longest_fit(spark):
    urls = ["http://a.net/x", "https://EXAMPLE.net/en/1", "http://www.example.net/fr/", "http://x.example.com/de/?q", "http://a.org/fr/", "http://a.org/fr", "http://net", "notnet://mynet/", "example.net/en/", None, "", "http://b.com:80/de/#f", "a://b://c/d", "http://xnet/"]
    rows = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(rows).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block")
    assert got[1] == ("example.net", "/en/1", "example.net/en/", "allow")
    assert got[2][2:] == ("net/", "block")
    assert got[3] == ("x.example.com", "/de/", "example.com/de/", "block")
    assert got[4][2:] == ("org/fr/", "allow")
    assert got[5][2] is None
    assert got[6] == ("net", "", None, "allow")
    assert got[8][:3] == ("", "", None)
    assert got[9] == ("", "", None, "allow")
    assert got[11][:2] == ("b.com:80", "/de/")
    assert got[12][:2] == ("b:", "//c/d")
    assert got[13][2] is None


def test_rows_without_an_id_are_drawn_like_others(spark):
    docs = spark.createDataFrame([(None, "a b c", "s")] * 1000 + [(k, "d e f", "t") for k in range(1000)], "doc_id long, text string, source string").repartition(3)
    mixed = mixing.mix(docs, words_count(F.col("text")), buckets=64)
    first = sorted((r["source"], r["copies"]) for r in mixed.collect())
    assert first == sorted((r["source"], r["copies"]) for r in mixing.mix(docs.repartition(5), words_count(F.col("text")), buckets=64).collect())
    assert abs(sum(3 * c for s, c in first if s == "s") - mixed.filter("source = 's'").first()["target"]) < 3
    assert len({r["copies"] for r in mixed.filter("source = 's'").collect()}) <= 2


@pytest.mark.parametrize("top", [30, 5_000, 400_000])
def test_no_choice_of_documents_comes_nearer(top):
    """Lengths of any size, also beyond the table's reach."""
    rng = random.Random(top)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, top), rng.randint(1, 6)))
        counts = [rng.randint(1, 4) for _ in lengths]
        sums = {0}
        for length, count in zip(lengths, counts, strict=True):
            sums = {s + k * length for s in sums for k in range(count + 1)}
        budget = rng.randint(0, max(sums))
        taken = mixing.choose_counts(np.array(lengths), np.array(counts), budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        step = math.gcd(*lengths)
        miss, least = abs(budget - int((taken * lengths).sum())), min(abs(budget - s) for s in sums)
        assert miss == least or miss <= max(mixing.NEAR * budget, step / 2, budget % step)
    assert 1_140_003 - int((mixing.choose_counts(np.array([150_000, 190_001]), np.array([5, 5]), 1_140_003) * [150_000, 190_001]).sum()) == 10_001


def test_many_long_documents_fill_a_budget():
    rng = np.random.default_rng(3)
    lengths, counts = np.unique(rng.integers(100_000, 3_000_000, 60)), 2
    budget = int(lengths.sum() * counts * 0.37)
    taken = mixing.choose_counts(lengths, np.full(len(lengths), counts), budget)
    assert abs(budget - int((taken * lengths).sum())) <= mixing.NEAR * budget


def test_mined_rules_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        tokens = [f"t{k}" for k in range(6) if rng.random() < 0.4]
        label = "block" if {"t0", "t1"} <= set(tokens) else ("allow" if "t2" in tokens and rng.random() < 0.5 else None)
        rows.append((i, tokens, label))
    df = spark.createDataFrame(rows, "key long, tokens array<string>, label string")
    rules = url_filter.mine_rules(df, 0.02, 0.9)
    found = {tuple(r["antecedent"]): r for r in rules.collect() if r["verdict"] == "block"}
    assert list(found) == [("t0", "t1")]
    with_both = [r for r in rows if {"t0", "t1"} <= set(r[1])]
    assert found["t0", "t1"]["support"] == pytest.approx(len(with_both) / len([r for r in rows if r[1] or r[2]]))
    hits = {r["key"]: r["verdict"] for r in url_filter.match_rules(df, rules).collect()}
    assert {k for k, v in hits.items() if v == "block"} == {r[0] for r in with_both}


def test_every_mined_rule_against_all_subsets_of_tokens(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(300):
        tokens = [f"t{k}" for k in range(5) if rng.random() < 0.5]
        label = rng.choice(["block", "allow"], p=[0.9, 0.1]) if "t0" in tokens and rng.random() < 0.7 else ("allow" if "t1" in tokens and rng.random() < 0.4 else None)
        rows.append((i, tokens, label))
    support, confidence, coverage = 0.03, 0.8, 0.5
    total = sum(1 for r in rows if r[1] or r[2])
    want = {}
    for mask in range(1, 32):
        need = {f"t{k}" for k in range(5) if mask >> k & 1}
        having = [r[2] for r in rows if need <= set(r[1])]
        labelled = [x for x in having if x is not None]
        for verdict in ("block", "allow"):
            n = labelled.count(verdict)
            if n >= support * total and n >= confidence * len(labelled) and len(labelled) >= coverage * len(having):
                want[frozenset(need), verdict] = (n / len(labelled), n / total, len(labelled) / len(having))
    kept = {k: v for k, v in want.items() if not any(o[1] == k[1] and o[0] < k[0] and w[0] >= v[0] for o, w in want.items())}
    assert kept and len(kept) < len(want)
    df = spark.createDataFrame(rows, "key long, tokens array<string>, label string")
    got = {(frozenset(r["antecedent"]), r["verdict"]): (r["confidence"], r["support"], r["coverage"]) for r in url_filter.mine_rules(df, support, confidence, coverage).collect()}
    assert got.keys() == kept.keys()
    for k, v in got.items():
        assert v == pytest.approx(kept[k])


def test_a_mined_rule_judges_urls_without_a_rule(spark):
    urls = [f"http://{h}/de/{i}" for i in range(10) for h in ("a.net", "b.example.com", "c.org")] + [f"http://c.org/en/{i}" for i in range(100, 110)]
    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    for r in got:
        assert (r["rule"] is None) == (r["host"] == "c.org")
        assert r["verdict"] == ("allow" if r["path"].startswith("/en/") else "block")
        assert (r["mined_rule"] is not None) == (r["host"] == "c.org" and r["path"].startswith("/de/"))


@pytest.mark.parametrize("segments", [18, 30])
def test_deep_urls_repeated(spark, segments):
    """Copies of one URL, labelled or not or both, and a chain of ever deeper ones: combinations don't grow with depth."""
    path = "/".join(f"s{i}" for i in range(segments))
    urls = [f"http://a.net/{path}"] * 50 + [f"http://b.org/{path}"] * 50 + [f"http://{h}/x/" + "/".join(f"c{k}" for k in range(i)) for i in range(segments) for h in ("a.net", "b.org") for _ in range(5)]
    began = time.perf_counter()
    rows = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert time.perf_counter() - began < 60
    assert len(rows) == len(urls)
    assert {r["verdict"] for r in rows if r["host"] == "a.net"} == {"block"}


def rule_table(rules):
    return {(tuple(r["antecedent"]), r["verdict"]): tuple(round(r[c], 9) for c in ("confidence", "support", "coverage")) for r in rules.collect()}


@pytest.mark.parametrize(("tokens", "share", "bounds"), [(8, 0.6, (0.03, 0.7, 0.3)), (6, 0.5, (0.02, 0.4, 0.2)), (7, 0.7, (0.03, 0.65, 0.4))])
def test_rules_by_levels_are_those_of_fp_growth(spark, tokens, share, bounds):
    rng = np.random.default_rng(11)
    rows = [(i, [f"t{k}" for k in range(tokens) if rng.random() < share], rng.choice(["block", "allow", None], p=[0.6, 0.2, 0.2])) for i in range(300)]
    rows += [(1000 + i, [f"t{k}" for k in range(i % 5)], "block" if i % 5 == 4 else "allow") for i in range(60)]
    df = spark.createDataFrame([(k, t, v and str(v)) for k, t, v in rows], "key long, tokens array<string>, label string")
    whole, levels = (rule_table(url_filter.mine_rules(df, *bounds, width=w)) for w in (20, 1))
    assert whole == levels
    assert any(len(k[0]) > 1 for k in whole)


def test_a_deep_url_changes_no_rule_of_others(spark):
    rows = [(i, ["t1", "t2"] if i % 2 else ["t1", "u"] if i % 4 else ["t2", "v"], "A" if i % 2 else "B") for i in range(160)]
    deep = (999, ["t1", "t2"] + [f"d{k}" for k in range(12)], None)
    # the deep URL's tokens are useful ones: others have them too, now with one label, now with the other
    rest = [(200 + i, [f"d{i % 12}"], "AB"[i // 12 % 2]) for i in range(96)]
    for extra in ([], [deep]):
        df = spark.createDataFrame([*rows, *rest, *extra], "key long, tokens array<string>, label string")
        for width in (3, 10, 20):
            assert (("t1", "t2"), "A") in rule_table(url_filter.mine_rules(df, 0.01, 0.9, 0.5, width=width))


def test_urls_empty(spark):
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
