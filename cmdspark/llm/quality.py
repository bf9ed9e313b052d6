"""Quality rules as a short-circuit cascade: what rejects most for its cost comes first, and later rules see only what is left."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches
from .words import Words, split_words

#: Documents (expected number) that costs and selectivities are estimated on. They decide the order of the rules, never a verdict.
SAMPLE_DOCS = 2_000
#: A text with fewer words fails, as does one with more than this percentage of its words in windows of so many words that it repeats.
MIN_WORDS, REPEATED_PERCENT, WINDOW = 20, 30, 8


class Texts:
    """Texts of a batch with what several rules need of them, each made when first asked for."""

    def __init__(self, texts: pa.Array):
        self.texts = texts.cast(pa.large_string()).fill_null("")

    def take(self, at: np.ndarray) -> Texts:
        """Some of the texts; what was counted for all of them comes along."""
        some = Texts(self.texts.take(pa.array(at)))
        for name in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"):
            if name in self.__dict__:
                some.__dict__[name] = self.__dict__[name][at]
        return some

    def count(self, pattern: str) -> np.ndarray:
        """Matches of a pattern in each text."""
        return pc.count_substring_regex(self.texts, pattern).to_numpy().astype(np.int64)

    @cached_property
    def words(self) -> Words:
        return split_words(self.texts)

    @cached_property
    def n_words(self) -> np.ndarray:
        return self.words.counts

    @cached_property
    def word_chars(self) -> np.ndarray:
        lengths = pc.utf8_length(self.words.vocabulary).to_numpy().astype(np.int64)
        return np.diff(np.concatenate([[0], np.cumsum(lengths[self.words.codes])])[self.words.offsets])

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.count(r"[#*$%&|<>]")

    @cached_property
    def lines(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Text and number of each line that has a word, and those lines; equal lines have one number."""
        lists = pc.split_pattern(self.texts, "\n")
        owner = pc.list_parent_indices(lists).to_numpy()
        flat = lists.flatten()
        full = pc.match_substring_regex(flat, r"[^\x20\x09-\x0D]")
        encoded = flat.filter(full).dictionary_encode()
        return owner[full.to_numpy(zero_copy_only=False)], encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self.lines[0], minlength=len(self.texts))

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        owner, distinct, number = self.lines
        each = np.unique(owner * (len(distinct) + 1) + number) // (len(distinct) + 1)
        return self.n_lines - np.bincount(each, minlength=len(self.texts))

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words in windows of ``WINDOW`` words that a text has twice or more.

        Windows are compared whole, by doubling: factors of 2, 4 and 8 words get the number of their
        two halves, and only where both halves are repeated a longer one can be.
        """
        words = self.words
        owner, number, total = words.owner, words.codes, len(words.codes)
        at = np.arange(total)  # where factors of the present size are repeated in their text
        size, label = 1, number
        while size < WINDOW:
            size *= 2
            here = np.zeros(total + size, bool)
            here[at] = True
            at = at[here[at + size // 2] & (at + size <= words.offsets[owner[at] + 1])]
            pair = label[at] * (int(label.max(initial=0)) + 1) + label[at + size // 2]
            # first the pairs' own numbers, then those with the text: each key fits, as there are fewer numbers than words
            _, pair = np.unique(pair, return_inverse=True)
            _, key, times = np.unique(owner[at] * (len(at) + 1) + pair, return_inverse=True, return_counts=True)
            repeated = times[key] > 1
            label = np.zeros(total, np.int64)
            label[at] = pair
            at = at[repeated]
        change = np.zeros(total + 1, np.int64)
        change[at] += 1
        np.add.at(change, at + WINDOW, -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(change)[:-1] > 0)])
        return np.diff(covered[words.offsets])

    def percent_of_lines(self, pattern: str) -> np.ndarray:
        """Per cent of the lines with a word that match, rounded down; 0 without lines."""
        owner, distinct, number = self.lines
        hit = pc.match_substring_regex(distinct, pattern).to_numpy(zero_copy_only=False)[number]
        return 100 * np.bincount(owner[hit], minlength=len(self.texts)) // np.maximum(self.n_lines, 1)


@dataclass(frozen=True)
class Rule:
    """Says of each text whether it rejects it, by whole numbers only, so that every engine agrees."""

    name: str
    rejects: Callable[[Texts], np.ndarray] = field(repr=False)


def _odd_words(t: Texts) -> np.ndarray:
    return (t.word_chars < 2 * t.n_words) | (t.word_chars > 15 * t.n_words)


def _symbols(t: Texts) -> np.ndarray:
    return 10 * t.n_symbols > t.n_words


def _repeated_lines(t: Texts) -> np.ndarray:
    return (t.n_dup_lines > 2) & (10 * t.n_dup_lines > 3 * t.n_lines)


def _no_letters(t: Texts) -> np.ndarray:
    lettered = pc.match_substring_regex(t.words.vocabulary, r"\p{L}").to_numpy(zero_copy_only=False)[t.words.codes]
    return 10 * np.diff(np.concatenate([[0], np.cumsum(lettered)])[t.words.offsets]) < 6 * t.n_words


def _shouting(t: Texts) -> np.ndarray:
    letters = pc.utf8_length(t.texts).to_numpy().astype(np.int64) - t.count(r"\P{L}")
    return 2 * t.count(r"\p{Lu}") > letters


def _one_word(t: Texts) -> np.ndarray:
    w = t.words
    key, times = np.unique(w.owner * (len(w.vocabulary) + 1) + w.codes, return_counts=True)
    most = np.zeros(len(t.texts), np.int64)
    np.maximum.at(most, key // (len(w.vocabulary) + 1), times)
    return 10 * most > 4 * t.n_words


def _stutter(t: Texts) -> np.ndarray:
    w = t.words
    same = np.zeros(len(w.codes) + 1, np.int64)
    same[1:-1] = (w.codes[1:] == w.codes[:-1]) & (w.owner[1:] == w.owner[:-1]) if len(w.codes) else 0
    return 10 * np.diff(np.concatenate([[0], np.cumsum(same[:-1])])[w.offsets]) > 3 * t.n_words


def _cut_lines(t: Texts) -> np.ndarray:
    return t.percent_of_lines(r"(\.\.\.|…)[\x20\x09-\x0D]*$") > 30


def _bullets(t: Texts) -> np.ndarray:
    return t.percent_of_lines(r"^[\x20\x09-\x0D]*[-*•‣·]") > 90


#: The cascade, in any order. Texts of common prose pass all of them.
RULES = (
    Rule("word_length", _odd_words), Rule("symbols", _symbols), Rule("repeated_lines", _repeated_lines), Rule("letters", _no_letters), Rule("shouting", _shouting),
    Rule("one_word", _one_word), Rule("stutter", _stutter), Rule("cut_lines", _cut_lines), Rule("bullets", _bullets),
)


@dataclass(frozen=True)
class Estimate:
    """What a rule costs and rejects by itself, on the sample."""

    name: str
    docs: int
    rejected: int
    seconds: float

    @property
    def worth(self) -> float:
        """Rejections for each second."""
        return self.rejected / max(self.seconds, 1e-9)


def _base_failed(t: Texts) -> np.ndarray:
    return (t.n_words < MIN_WORDS) | (100 * t.n_repeat_words > REPEATED_PERCENT * t.n_words)


def _try(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = Texts(batch.column("text"))
        texts = texts.take(np.flatnonzero(~_base_failed(texts)))
        if not len(texts.texts):
            continue
        out = []
        for rule in rules:
            some = texts.take(np.arange(len(texts.texts)))  # without what other rules have made
            began = time.thread_time()
            rejected = int(rule.rejects(some).sum())
            out.append((rule.name, len(texts.texts), rejected, time.thread_time() - began))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["name", "docs", "rejected", "seconds"])


def order_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_docs: int = SAMPLE_DOCS) -> list[Estimate]:
    """Estimates of all rules, most rejections for their cost first.

    Each rule runs by itself on about ``sample_docs`` documents that pass the base rules, taken by a hash of
    id and text; one row per rule comes back. Rules that reject none there come last, cheapest first.
    """
    total = docs.count()
    if not total:
        return [Estimate(r.name, 0, 0, 0.0) for r in rules]
    share = min(1.0, sample_docs / total)
    rows = bound_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    taken = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < int(share * (1 << 20))).select("text")
    tried = taken.mapInArrow(lambda batches: _try(batches, rules), "name string, docs long, rejected long, seconds double")
    sums = {r["name"]: r for r in tried.groupBy("name").agg(*[F.sum(c).alias(c) for c in ("docs", "rejected", "seconds")]).collect()}
    found = [Estimate(**sums[r.name].asDict()) if r.name in sums else Estimate(r.name, 0, 0, 0.0) for r in rules]
    return sorted(found, key=lambda e: (-e.worth, e.seconds, e.name))


def _judge(batches: Iterator[pa.RecordBatch], rules: list[Rule]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = Texts(batch.column("text"))
        counts = [texts.n_words, texts.word_chars, texts.n_symbols, texts.n_dup_lines, texts.n_repeat_words]
        failed = _base_failed(texts)
        left = np.flatnonzero(~failed)
        some = texts if len(left) == len(texts.texts) else texts.take(left)
        for rule in rules:
            if not len(left):
                break
            good = ~rule.rejects(some)
            if not good.all():
                left, some = left[good], some.take(np.flatnonzero(good))
        kept = np.zeros(len(failed), bool)
        kept[left] = True
        names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(failed), pa.array(kept)], names)


def judge_quality(docs: DataFrame, order: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A document stays if it has words enough, repeats itself little (the base rules) and no rule rejects
    it. Rules run by ``order`` (their names, best first; by ``order_rules`` if None), each on what those
    before it left; the order changes the work, never a verdict, for every rule looks at the text alone.

    One pass, no shuffle. Null and empty texts have no words and fail the base rules. Null and repeated
    ids are judged each for itself; other columns are ignored, so their names may clash. An empty table
    gives an empty result. Whole texts are judged; a text longer than an Arrow batch is a batch.
    """
    if order is None:
        order = [e.name for e in order_rules(docs, id_col, text_col, rules)]
    named = {r.name: r for r in rules}
    chosen = [named[n] for n in order]
    kind = docs.schema[id_col].dataType.simpleString()
    rows = bound_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return rows.mapInArrow(lambda batches: _judge(batches, chosen), schema).withColumnRenamed("id", id_col)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), windows AS (
    SELECT k, i, array_to_string(words[i:i + 7], ' ') AS w FROM (SELECT k, words, unnest(range(1, len(words) - 6)) AS i FROM d)
), covered AS (
    SELECT DISTINCT k, unnest(range(i, i + 8)) AS i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, w) AS times FROM windows) WHERE times > 1
), repeated AS (
    SELECT k, count(*) AS n FROM covered GROUP BY k
), most AS (
    SELECT k, max(n) AS n FROM (SELECT k, word, count(*) AS n FROM (SELECT k, unnest(words) AS word FROM d) GROUP BY k, word) GROUP BY k
), counted AS (
    SELECT d.*, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
           len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
           coalesce(repeated.n, 0) AS n_repeat_words, coalesce(most.n, 0) AS most,
           len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS lettered,
           len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS same,
           len(regexp_extract_all(text, '\p{L}')) AS letters, len(regexp_extract_all(text, '\p{Lu}')) AS capitals,
           len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS cut,
           len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣·]'))) AS bullets
    FROM d LEFT JOIN repeated ON repeated.k = d.k LEFT JOIN most ON most.k = d.k
), based AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 10 * n_symbols <= n_words AND (n_dup_lines <= 2 OR 10 * n_dup_lines <= 3 * n_lines) AND 10 * lettered >= 6 * n_words
       AND 2 * capitals <= letters AND 10 * most <= 4 * n_words AND 10 * same <= 3 * n_words AND 100 * cut // greatest(n_lines, 1) <= 30 AND 100 * bullets // greatest(n_lines, 1) <= 90 AS kept
FROM based
"""
