"""Language identification by error-correcting output codes over character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, crc_fold, materialize

#: Labelled rows per language, whole texts, that the classifiers are fitted on (expected number).
SAMPLE_PER_LANGUAGE = 2000
#: n-grams of 1 to 3 bytes are hashed to this many features.
FEATURES = 1 << 14
PIECE = 1 << 21
_LETTER = re.compile(r"[^\W\d_]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def codewords(languages: int) -> np.ndarray:
    """One row of +1 and -1 for each language, made by rule.

    Up to 6 languages have every split in two. Up to 128 have the rows of a Hadamard matrix, any two of
    which differ in half of their bits. More have words of the Reed-Muller code of order 2 over 128 places,
    for 2^28 languages, any two of which differ in a quarter of their bits at least. A bit that all
    languages share says nothing and is left out.
    """
    if languages <= 6:
        bits = [[1 if (c >> i) & 1 else -1 for i in range(languages)] for c in range(1, 1 << (languages - 1))]
        return np.array(bits, dtype=np.int8).T.reshape(languages, -1)
    m = 7 if languages > 128 else max(3, (languages - 1).bit_length())
    place = np.arange(1 << m)
    single = [(place >> i) & 1 for i in range(m)]
    terms = np.array(single if languages <= 128 else single + [a & b for i, a in enumerate(single) for b in single[:i]])
    number = np.arange(languages)
    chosen = (number[:, None] >> np.arange(len(terms))) & 1
    code = np.where(chosen @ terms % 2, -1, 1).astype(np.int8)
    return code[:, np.abs(code.sum(axis=0, dtype=np.int64)) < languages]


def ngram_features(data: np.ndarray) -> np.ndarray:
    """Hashed features of every byte n-gram of 1 to 3 in lower-cased UTF-8 ``data``: a row for each byte, -1 where none ends."""
    b = _LOWER[data].astype(np.int64)
    out = np.full((3, len(b)), -1, dtype=np.int64)
    out[0] = b
    if len(b) > 1:
        out[1, 1:] = (b[:-1] * 1_000_003 + b[1:] * 7_919 + 101) * 2_654_435_761 >> 7 & (FEATURES - 1)
    if len(b) > 2:
        out[2, 2:] = (b[:-2] * 15_485_863 + b[1:-1] * 1_000_003 + b[2:] * 7_919 + 211) * 2_654_435_761 >> 7 & (FEATURES - 1)
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and language the number of each feature."""
    for batch in batches:
        total: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            f = ngram_features(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)).ravel()
            total[lang] = total.get(lang, 0) + np.bincount(f[f >= 0], minlength=FEATURES)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int64)), pa.array(counts[at].astype(np.int64))], ["lang", "feature", "n"])


def _sides(batches: Iterator[pa.RecordBatch], names: dict[str, int], totals: np.ndarray, code: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of features whose counts (lang, feature, n) are all in the task, the sum of chances on the plus side of each bit and on the minus side."""
    sums = np.zeros((FEATURES, 2, code.shape[1]))
    for batch in batches:
        at = np.array([names[x] for x in batch.column("lang").to_pylist()], np.int64)
        chance = batch.column("n").to_numpy() / totals[at]
        feature = batch.column("feature").to_numpy()
        for side, sign in enumerate((1, -1)):
            np.add.at(sums[:, side], feature, chance[:, None] * (code[at] == sign))
    used = np.flatnonzero(sums.any(axis=(1, 2)))
    flat = sums[used].reshape(len(used), -1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
    yield pa.RecordBatch.from_arrays([pa.array(used), lists], ["feature", "sums"])


def _least_margins(batches: Iterator[pa.RecordBatch], names: dict[str, int], totals: np.ndarray, weights: np.ndarray, code: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The least margin of each bit, from its own side, over languages whose counts are all in the task."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        langs = np.array([names[x] for x in batch.column("lang").to_pylist()], np.int64)
        n, feature = batch.column("n").to_numpy(), batch.column("feature").to_numpy()
        for lang in np.unique(langs).tolist():
            own = langs == lang
            sums[lang] = sums.get(lang, 0.0) + weights[:, feature[own]] @ n[own] / totals[lang]
    if sums:
        least = np.min([code[lang] * m for lang, m in sums.items()], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(least)), pa.int64()), pa.array(least)], ["bit", "margin"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> dict:
    """Binary classifiers for the bits of the languages' codewords, from about ``per_language`` rows of each language, or all if there are fewer.

    Rows are taken by a hash of their id and text, so a fit is repeatable and rows without an id or with
    a repeated one are taken like others. Features are counted by Spark, and so are the sums over
    languages that a bit's classifier needs: it weighs a feature by the log odds of the languages on either side
    of the bit, each language counting alike. The driver gets bits x FEATURES numbers, at most 128 bits
    whatever the languages, and a name, a total and a bit row for each language. Rows without a language, text or
    letter are left out. Without any row the model knows no language.
    """
    rows = bound_batches(docs).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null").filter(F.col("text").rlike(r"\p{L}"))
    rank = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "text", F.lit(5))
    # the bound is met by a threshold on the hash, from each language's count: no language is sorted whole
    space = F.lit(float(1 << 62))
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(per_language)) / F.count(F.lit(1))).alias("share"))
    # a row for each language, like the model, which goes to every task too
    sample = rows.join(F.broadcast(share), "lang").filter(F.abs(F.shiftright(rank, 1).cast("double")) / space < F.col("share")).select("lang", "text")
    counted = materialize(sample.mapInArrow(_counts, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")), "lang-counts")
    sizes = sorted((r["lang"], r["n"]) for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect())
    if not sizes:
        return {"languages": [], "weights": np.zeros((0, FEATURES), np.float32), "code": np.zeros((0, 0), np.int8), "trust": np.zeros(0)}
    names, code = {lang: at for at, (lang, _) in enumerate(sizes)}, codewords(len(sizes))
    n = np.array([n for _, n in sizes], float)
    totals = n + 0.5 * FEATURES
    # every feature counts half a time more than it occurs, in each language
    chance = np.stack([((code == sign) * (0.5 / totals)[:, None]).sum(axis=0) for sign in (1, -1)])
    chance = np.repeat(chance[None], FEATURES, axis=0)
    if code.shape[1]:
        sides = counted.repartition("feature").mapInArrow(lambda it: _sides(it, names, totals, code), "feature long, sums array<double>")
        for r in sides.collect():
            chance[r["feature"]] += np.array(r["sums"]).reshape(2, -1)
    languages = np.stack([(code == sign).sum(axis=0) for sign in (1, -1)])
    weights = (np.log(chance[:, 0] / languages[0]) - np.log(chance[:, 1] / languages[1])).T.astype(np.float32).reshape(-1, FEATURES)
    trust = np.zeros(code.shape[1])
    if code.shape[1]:
        # a bit is trusted by how well it tells the languages' own counts apart
        exact = weights.astype(float)
        margins = counted.repartition("lang").mapInArrow(lambda it: _least_margins(it, names, n, exact, code), "bit long, margin double")
        least = {r["bit"]: r["margin"] for r in margins.groupBy("bit").agg(F.min("margin").alias("margin")).collect()}
        trust = np.maximum([least[k] for k in range(code.shape[1])], 1e-3)
    return {"languages": list(names), "weights": weights, "code": code, "trust": trust / trust.sum() if len(trust) else trust}


def decode(margins: np.ndarray, grams: int, model: dict, doubt: float = 0.6) -> tuple[str, float, bool]:
    """The language whose codeword has the least loss, its score, and whether the next one is close.

    The loss of a bit is the logistic loss of its margin (mean log odds of the text's n-grams times the
    root of their number), weighted by the bit's trust.
    """
    names = model["languages"]
    if len(names) == 1:
        return names[0], 1.0, False
    scaled = margins / max(grams, 1) * np.sqrt(max(grams, 1)) * 2.0
    loss = (np.logaddexp(0.0, -model["code"] * scaled[None, :]) * model["trust"][None, :]).sum(axis=1)
    chance = np.exp(-4.0 * (loss - loss.min()))
    chance /= chance.sum()
    best = int(np.argmin(loss))
    return names[best], float(chance[best]), bool(chance[best] < doubt)


def _margins(data: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, int]:
    """Sum of weights over all n-grams of ``data``, in pieces that overlap by two bytes."""
    counts = np.zeros(FEATURES)
    for a in range(0, len(data), PIECE):
        lo = max(0, a - 2)
        f = ngram_features(data[lo : a + PIECE])[:, a - lo :].ravel()
        counts += np.bincount(f[f >= 0], minlength=FEATURES)
    return weights @ counts, int(counts.sum())


def _predict(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    bits = model["weights"].astype(np.float64)
    for batch in batches:
        langs, scores, doubts = [], [], []
        for item in batch.column("text"):
            text = item.as_py()
            if not text or not model["languages"] or not _LETTER.search(text):
                lang, score, doubt = "und", 0.0, True
            else:
                lang, score, doubt = decode(*_margins(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), bits), model)
            langs.append(lang)
            scores.append(score)
            doubts.append(doubt)
        at = batch.schema.get_field_index("text")
        yield batch.remove_column(at).append_column("lang_pred", pa.array(langs, pa.string())).append_column("score", pa.array(scores, pa.float64())).append_column("ambiguous", pa.array(doubts, pa.bool_()))


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score, ambiguous.

    The model is FEATURES x bits numbers, whatever the corpus, and goes to the tasks with the function.
    Texts that are null, empty or without a letter are ``und`` with score 0. Whole texts are read, long
    ones in pieces. Null and repeated ids are predicted each for itself; other columns are ignored. An
    empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = bound_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _predict(it, model), f"id {kind}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", id_col)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(crc_fold(F.col("doc_id"), 4) != 2))
    return identify(docs, model).select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
