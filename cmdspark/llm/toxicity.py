"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, with exception phrases, normalised by length."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, crc_fold, materialize

#: Fixed values. Look-alikes and digits as they stand for Latin letters; a digit counts only next to a letter.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "м": "m", "т": "t", "к": "k", "н": "h", "в": "b",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ⅰ": "i", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
}
#: Blocks of the code table in which letters stand for Latin ones (superscripts and letterlike signs, enclosed, full-width, mathematical), and characters that show nothing.
STYLED = ((0x2070, 0x2140), (0x2460, 0x2500), (0xFF21, 0xFF5B), (0x1D400, 0x1D800), (0x1F110, 0x1F190))
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
#: Fixed values. Plain insults with a prior weight, and phrases in which a listed word is none.
SEED_LEXICON = dict.fromkeys(
    ["idiot", "idiots", "moron", "morons", "stupid", "scum", "trash", "loser", "losers", "worthless", "pathetic", "disgusting", "clown", "imbecile", "cretin", "dumbass", "bastard", "asshole", "bitch", "whore", "slut", "retard", "vermin", "filth"], 3.0
)
EXCEPTIONS = ("clown fish", "class clown", "circus clown", "trash can", "trash bin", "trash bag", "pond scum", "sore loser", "stupid question")
#: Labelled documents (expected number) that weights are learned from, whole texts.
SAMPLE_DOCS = 20_000
#: Lengths of the stems (beginnings of words) that may enter the lexicon, and the share of toxic documents one needs among those that hold it.
STEM_LENGTHS, MIN_SHARE = (4, 12), 0.75

WORD = r"[\p{L}\p{N}@$]+"


def _letters() -> dict[str, str]:
    """HOMOGLYPHS and each styled letter with the plain one that it is compatible with."""
    found = dict(HOMOGLYPHS)
    for low, high in STYLED:
        for c in map(chr, range(low, high)):
            plain = unicodedata.normalize("NFKD", c).strip("()").lower()
            if len(plain) == 1 and "a" <= plain <= "z":
                found.setdefault(c, plain)
    return found


_LETTERS = _letters()
_TABLE = str.maketrans(_LETTERS) | str.maketrans("", "", INVISIBLE)
_DIGIT_TABLE = str.maketrans(DIGITS)


def fold_column(text: Column) -> Column:
    """Lower case, look-alikes and styled letters as plain Latin ones, without what shows nothing; the same as ``fold`` up to digits."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), "".join(_LETTERS) + INVISIBLE, "".join(_LETTERS.values()))


def fold(text: str) -> str:
    return text.lower().translate(_TABLE)


def learn_lexicon(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    seed: dict[str, float] = SEED_LEXICON,
    sample_docs: int = SAMPLE_DOCS,
) -> dict[str, float]:
    """Weights of words (the seed's, matched whole) and stems (written with a final ``*``), from labelled documents.

    About ``sample_docs`` labelled documents, taken by a hash of their id, are counted: for each stem the
    toxic and the other documents that hold it, one aggregation with map-side combining. A stem enters
    if it is so tied to toxic documents that chance would hardly make one such stem in the whole
    vocabulary (Chernoff bound against the share of toxic documents); its weight is its log odds. Only
    stems that pass leave the cluster. Of stems that extend each other the strongest stays. Null labels
    are left out; of several labels for a document the highest counts. Without labelled rows the seed is
    the lexicon.
    """
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .filter("label is not null and id is not null")
        .groupBy("id").agg((F.max("label") > 0).cast("int").alias("label"))
    )
    share = min(1.0, sample_docs / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(known, "id")
    # one document of each set of words: copies would make any of their words look significant
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(fold_column(F.col("text")), F.lit(WORD), F.lit(0))))
    bags = materialize(rows.select("label", words.alias("words")).withColumn("bag", F.xxhash64("words")).groupBy("bag").agg(F.max("label").alias("label"), F.first("words").alias("words")), "toxic-bags")
    total, bad = (int(x or 0) for x in bags.agg(F.count(F.lit(1)), F.sum("label")).first())
    if not 0 < bad < total:
        return dict(seed)
    low, high = STEM_LENGTHS
    stems = F.array_distinct(F.flatten(F.transform("words", lambda w: F.transform(F.sequence(F.lit(low), F.greatest(F.lit(low), F.least(F.lit(high), F.length(w)))), lambda n: F.when(n <= F.length(w), F.substring(w, F.lit(1), n))))))
    counts = materialize(
        bags.select("label", F.explode(stems).alias("stem")).filter("stem is not null").groupBy("stem").agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n")), "toxic-stems"
    )
    base = bad / total
    rate = F.col("bad") / F.col("n")
    other = F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - base))).otherwise(F.lit(0.0))
    strength = F.col("n") * (rate * F.log(rate / base) + other)
    needed = math.log(100.0 * max(1, counts.count()))
    found = counts.filter(F.col("bad") >= MIN_SHARE * F.col("n")).withColumn("strength", strength).filter(F.col("strength") >= needed).collect()
    kept: dict[str, tuple[int, float]] = {}
    longer: dict[str, int] = {}  # of each beginning of a kept stem, the most toxic documents that such a stem covers
    for r in sorted(found, key=lambda r: (-r["strength"], -len(r["stem"]), r["stem"])):
        stem = r["stem"]
        if any(stem[:k] in kept for k in range(low, len(stem))) or longer.get(stem, 0) >= 0.5 * r["bad"]:
            continue
        kept[stem] = (r["bad"], math.log((r["bad"] + 0.5) / (bad + 1)) - math.log((r["n"] - r["bad"] + 0.5) / (total - bad + 1)))
        for k in range(low, len(stem)):
            longer[stem[:k]] = max(longer.get(stem[:k], 0), r["bad"])
    seen = {r["stem"]: r for r in counts.filter(F.col("stem").isin([w[:high] for w in seed])).collect()}
    plain = {w: v for w, v in seed.items() if w[:high] not in seen or 2 * seen[w[:high]]["bad"] >= seen[w[:high]]["n"]}
    return plain | {f"{stem}*": weight for stem, (_, weight) in kept.items()}


class Matcher:
    """Aho-Corasick over lexicon words, stems and exception phrases; a hit inside a hit exception doesn't count.

    A word or phrase must stand between non-letters, a stem at the beginning of a word. Where several
    entries begin at one place the heaviest counts.
    """

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        entries: dict[str, list] = {}
        for word, weight in lexicon.items():
            entries.setdefault(fold(word.rstrip("*")), []).append((word.endswith("*"), float(weight)))
        for phrase in exceptions:
            entries.setdefault(fold(phrase), []).append((False, None))
        self.auto = ahocorasick.Automaton()
        for text, values in entries.items():
            self.auto.add_word(text, (len(text), tuple(values)))
        if entries:
            self.auto.make_automaton()

    def weight(self, text: str) -> float:
        """Sum of the weights of hits in ``text`` as folded, and of those that only appear with digits read as letters."""
        if not len(self.auto):
            return 0.0
        plain = fold(text)
        hits = self._scan(plain)
        if any(c in plain for c in DIGITS):
            for start, (end, weight) in self._scan(plain.translate(_DIGIT_TABLE)).items():
                if start not in hits and any(c.isalpha() for c in plain[start : end + 1]):
                    hits[start] = (end, weight)
        return sum(w for _, w in hits.values())

    def _scan(self, text: str) -> dict[int, tuple[int, float]]:
        hits: dict[int, tuple[int, float]] = {}
        excepted = []
        for end, (length, values) in self.auto.iter(text):
            start = end - length + 1
            if start and text[start - 1].isalnum():
                continue
            inside = end + 1 < len(text) and text[end + 1].isalnum()
            for stem, weight in values:
                if inside and not stem:
                    continue
                if weight is None:
                    excepted.append((start, end))
                elif start not in hits or hits[start][1] < weight:
                    hits[start] = (end, weight)
        if not excepted:
            return hits
        # one pass over both in order: a hit is inside an exception if the furthest end of those begun so far reaches over it
        excepted.sort()
        kept, k, furthest = {}, 0, -1
        for start in sorted(hits):
            while k < len(excepted) and excepted[k][0] <= start:
                furthest = max(furthest, excepted[k][1])
                k += 1
            if hits[start][0] > furthest:
                kept[start] = hits[start]
        return kept


#: Texts that score this or more are toxic.
THRESHOLD = 0.7
#: Weight that a text needs to be called toxic: this much, and this much more for each thousand characters.
NEEDED, NEEDED_PER_1000 = 2.5, 0.2


def score_from(weight: float, chars: int) -> float:
    """The logistic function of how far the hits' weight lies above what a text of this length needs, 0.7 at the mark."""
    needed = NEEDED + NEEDED_PER_1000 * chars / 1000.0
    return 1.0 / (1.0 + (3.0 / 7.0) * math.exp(min(50.0, 4.0 * (1.0 - weight / needed))))


def _score(batches: Iterator[pa.RecordBatch], lexicon: dict[str, float], exceptions: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    matcher = Matcher(lexicon, exceptions)
    for batch in batches:
        texts = batch.column("text")
        weights = np.zeros(len(texts))
        scores = np.zeros(len(texts))
        for i, item in enumerate(texts):
            text = item.as_py() or ""
            weights[i] = matcher.weight(text)
            scores[i] = score_from(weights[i], len(text))
        at = batch.schema.get_field_index("text")
        yield batch.remove_column(at).append_column("weight", pa.array(weights)).append_column("score", pa.array(scores))


def score_toxicity(
    docs: DataFrame,
    lexicon: dict[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> DataFrame:
    """One row per input row: id, weight of the hits, score from 0 to 1.

    The lexicon goes to the tasks with the function, as it is small by construction. Whole texts are
    scanned once for all words. Null and empty texts have no hit; null and repeated ids are scored each
    for itself. Other columns are ignored. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = bound_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _score(it, lexicon, exceptions), f"id {kind}, weight double, score double").withColumnRenamed("id", id_col)


def _drop_toxic(batches: Iterator[pa.RecordBatch], lexicon: dict[str, float], exceptions: tuple[str, ...], text_col: str, threshold: float) -> Iterator[pa.RecordBatch]:
    matcher = Matcher(lexicon, exceptions)
    for batch in batches:
        texts = (item.as_py() or "" for item in batch.column(text_col))
        yield batch.filter(pa.array([score_from(matcher.weight(t), len(t)) < threshold for t in texts], pa.bool_()))


def drop_toxic(docs: DataFrame, lexicon: dict[str, float], text_col: str = "text", exceptions: tuple[str, ...] = EXCEPTIONS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores under ``threshold``. One pass, no shuffle."""
    # under plain names, as mapInArrow can't take names with a dot
    plain = [f"c{i}" for i in range(len(docs.columns))]
    text = plain[docs.columns.index(text_col)]
    rows = bound_batches(docs).toDF(*plain)
    return rows.mapInArrow(lambda it: _drop_toxic(it, lexicon, exceptions, text, threshold), rows.schema).toDF(*docs.columns)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(crc_fold(F.col("doc_id"), 3) != 1)
    return score_toxicity(docs, learn_lexicon(docs, labels)).select(
        "doc_id",
        (crc_fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "weight",
    )
