"""Periodic runs in texts, by Crochemore's partition refinement over the words of many documents at once."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches
from .words import Words, split_words

#: A run has this many words at least, and two periods.
MIN_LENGTH = 12

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


_NONE = np.empty(0, np.int64)


class _Gaps:
    """Positions by the gap to the next member of their class; an entry that doesn't hold any more is void.

    Entries that come in numbers are arrays sorted by gap, read from the smallest on; more than ``MOST``
    of these are merged. Single ones wait in a dictionary. A gap is asked for once, in ascending order.
    """

    MOST, MANY = 6, 64

    def __init__(self):
        self.sorted: list[list] = []  # array, place of the first entry that wasn't read, that entry
        self.single: dict[int, list[int]] = {}

    def add(self, at: np.ndarray, gap: np.ndarray) -> None:
        if len(at) > self.MANY:
            self._keep(np.sort((gap << 32) | at))
        else:
            for i, g in zip(at.tolist(), gap.tolist(), strict=True):
                self.single.setdefault(g, []).append(i)

    def _keep(self, keys: np.ndarray) -> None:
        if len(keys):
            self.sorted.append([keys, 0, int(keys[0])])

    def of(self, gap: int, following: np.ndarray) -> np.ndarray:
        """Positions whose gap is ``gap`` now, in order."""
        if len(self.sorted) > self.MOST:
            keys = np.sort(np.concatenate([x[k:] for x, k, _ in self.sorted]))
            at = keys & 0xFFFFFFFF
            self.sorted = []
            self._keep(keys[following[at] - at == keys >> 32])
        high, found = (gap + 1) << 32, []
        for entry in self.sorted:
            keys, k, first = entry
            if first < high:
                end = int(np.searchsorted(keys, high))
                found.append(keys[k:end] & 0xFFFFFFFF)
                entry[1:] = end, int(keys[end]) if end < len(keys) else 1 << 62
        if gap in self.single:
            found.append(np.array(self.single.pop(gap), np.int64))
        if not found:
            return _NONE
        at = np.concatenate(found)
        return np.unique(at[following[at] - at == gap])


class Refinement:
    """Classes of positions at which equal factors of one length begin, refined length by length.

    All documents of a batch lie in one sequence, each between two positions of its own that equal no
    other, so classes never cross documents. The members of a class have a stretch of ``order`` and are
    linked by place. When a class of length p falls apart, only its parts but the largest are ``small``:
    the classes of length p + 1 are split by them alone, the smaller-half strategy, so a position takes
    part in a logarithmic number of steps. A step is a fixed number of array operations, or for a few
    positions, as at the end of a long repetition, one loop over them.
    """

    FEW = 48

    def __init__(self, words: Words, min_length: int):
        counts = words.counts
        docs, total = len(counts), len(words.codes) + len(counts) + 1
        self.place = np.arange(len(words.codes)) + words.owner + 1  # of each word; place 0 and those after each document are the ends
        self.doc = np.full(total, -1, np.int64)
        self.doc[self.place] = words.owner
        symbols = np.arange(total) + len(words.vocabulary)  # ends equal nothing else
        symbols[self.place] = words.codes
        # a document is done with when no two factors of the length fit in it
        self.limit = np.zeros(total, np.int64)
        self.limit[self.place] = np.where(counts >= min_length, counts // 2, 0)[words.owner]

        self.bits = total.bit_length()
        at = np.sort((symbols << self.bits) | np.arange(total)) & ((1 << self.bits) - 1)
        new = np.ones(total, bool)
        new[1:] = (symbols[at[1:]] != symbols[at[:-1]]) | (self.doc[at[1:]] != self.doc[at[:-1]])
        first = np.flatnonzero(new)
        self.order, self.slot = at, np.empty(total, np.int64)
        self.slot[at] = np.arange(total)
        self.label = np.empty(total, np.int64)
        self.label[at] = np.cumsum(new) - 1
        self.classes = len(first)
        self.begin, self.size = np.zeros(total, np.int64), np.zeros(total, np.int64)
        self.begin[: len(first)], self.size[: len(first)] = first, np.diff(np.append(first, total))
        self.next, self.previous = np.full(total, -1, np.int64), np.full(total, -1, np.int64)
        follows = ~new[1:]
        self.next[at[:-1][follows]] = at[1:][follows]
        self.previous[at[1:][follows]] = at[:-1][follows]
        self.marked = np.zeros(total, bool)
        self.gaps = _Gaps()
        self.gaps.add(at[:-1][follows], (at[1:] - at[:-1])[follows])
        self.length, self.small = 1, np.arange(total)
        #: The same memory, faster to reach for single values.
        self.cells = [memoryview(x) for x in (self.label, self.size, self.begin, self.order, self.slot, self.next, self.previous, self.limit)]

    def squares(self) -> np.ndarray:
        """Positions at which a square of two factors of the present length begins: the next of their class is just that far.

        A member in between would give the factor a smaller period, and the square with it, so these are
        just the squares whose half isn't a repetition itself.
        """
        at = self.gaps.of(self.length, self.next)
        return at[self.limit[at] >= self.length]

    def refine(self) -> bool:
        """From factors of one length to the next; false if no class can split any more."""
        if len(self.small) <= self.FEW:
            return self._refine_few()
        p = self.length
        i = self.small - 1
        i = i[(self.size[self.label[i]] > 1) & (self.limit[i] > p)]  # place -1 is the last end, alone in its class
        self.length += 1
        if not len(i):
            self.small = i
            return False
        i, a, b = self._sorted(i)
        # groups: members of a class before the same small class; blocks: the groups of a class
        new = np.ones(len(i), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        group = np.flatnonzero(new)
        group_n = np.diff(np.append(group, len(i)))
        group_a = a[group]
        new = np.ones(len(group), bool)
        new[1:] = group_a[1:] != group_a[:-1]
        block = np.flatnonzero(new)
        of_group = np.cumsum(new) - 1
        largest = np.maximum.reduceat(group_n, block)
        rest = self.size[group_a[block]] - np.add.reduceat(group_n, block)
        # where no member stays, the largest group is what stays
        top = np.flatnonzero(group_n == largest[of_group])
        top = top[np.unique(of_group[top], return_index=True)[1]]
        moves = np.ones(len(group), bool)
        moves[top[rest == 0]] = False
        over = np.zeros(len(group), bool)  # groups larger than what stays, which is then small instead
        over[top[(rest > 0) & (largest > rest)]] = True
        at = i[np.repeat(moves, group_n)]
        if not len(at):
            self.small = at
            return False
        over, group_a, group_n = over[moves], group_a[moves], group_n[moves]
        swapped = group_a[over]
        self._move(at, group_a, group_n, p)
        kept = at[~np.repeat(over, group_n)]
        if len(swapped):
            kept = np.concatenate([kept, self.order[_spans(self.begin[swapped], self.size[swapped])]])
        self.small = kept
        return True

    def _refine_few(self) -> bool:
        """``refine`` for a few small classes, one position after the other."""
        label, size, begin, order, slot, following, previous, limit = self.cells
        p, single = self.length, self.gaps.single
        self.length += 1
        parts: dict[int, dict[int, list[int]]] = {}
        for i in sorted(self.small.tolist()):
            i -= 1
            if i >= 0 and limit[i] > p and size[label[i]] > 1:
                parts.setdefault(label[i], {}).setdefault(label[i + 1], []).append(i)
        small: list[int] = []
        for a, of in parts.items():
            groups = list(of.values())
            rest = size[a] - sum(map(len, groups))
            top = max(groups, key=len)
            if not rest:
                groups = [g for g in groups if g is not top]
            for group in groups:
                for i in group:
                    low, high = previous[i], following[i]
                    if low >= 0:
                        following[low] = high
                        if high - low > p:
                            single.setdefault(high - low, []).append(low)
                    if high >= 0:
                        previous[high] = low
                    size[a] -= 1
                    here, end = slot[i], begin[a] + size[a]
                    other = order[end]
                    order[here], order[end] = other, i
                    slot[other], slot[i] = here, end
                new, last = self.classes, -1
                self.classes += 1
                begin[new], size[new] = begin[a] + size[a], len(group)
                for i in group:
                    label[i], previous[i], following[i] = new, last, -1
                    if last >= 0:
                        following[last] = i
                        if i - last > p:
                            single.setdefault(i - last, []).append(last)
                    last = i
                if not rest or group is not top or len(top) <= rest:
                    small += group
                else:
                    top = None
            if top is None:
                small += order[begin[a] : begin[a] + size[a]].tolist()
        self.small = np.array(small, np.int64)
        return bool(small)

    def _sorted(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions by class, next position's class, place."""
        if 3 * self.bits < 64:
            mask = (1 << self.bits) - 1
            keys = np.sort((((self.label[i] << self.bits) | self.label[i + 1]) << self.bits) | i)
            return keys & mask, keys >> (2 * self.bits), (keys >> self.bits) & mask
        i = i[np.lexsort((i, self.label[i + 1], self.label[i]))]
        return i, self.label[i], self.label[i + 1]

    def _move(self, at: np.ndarray, group_a: np.ndarray, group_n: np.ndarray, p: int) -> None:
        """Make each group a class of its own; ``at`` has the groups one after the other, by the class that they leave."""
        N, groups = len(self.order), len(group_n)
        new = np.ones(groups, bool)
        new[1:] = group_a[1:] != group_a[:-1]
        left, moved = group_a[new], np.add.reduceat(group_n, np.flatnonzero(new))
        block = np.repeat(np.arange(len(left)), moved)
        self.marked[at] = True

        # what leaves a class goes to the end of its stretch, in exchange for what lies there and stays
        tail_of = self.begin[left] + self.size[left] - moved
        tail = _spans(tail_of, moved)
        there = self.order[tail]
        stay = there[~self.marked[there]]
        free = self.slot[at]
        free = free[free < tail_of[block]]
        self.order[free], self.slot[stay] = stay, free
        self.order[tail], self.slot[at] = at, tail

        # members that stay are linked over chains of those that leave
        before, after = self.previous[at], self.next[at]
        opens, closes = ~self.marked[before], ~self.marked[after]  # -1 is the last end, never marked
        first = np.sort(block[opens] * N + at[opens]) % N
        last = np.sort(block[closes] * N + at[closes]) % N
        low, high = self.previous[first], self.next[last]
        some = low >= 0
        self.next[low[some]] = high[some]
        some = high >= 0
        self.previous[high[some]] = low[some]
        some = (low >= 0) & (high - low > p)
        self.gaps.add(low[some], (high - low)[some])
        self.marked[at] = False

        # links inside the new classes
        ends = np.cumsum(group_n)
        follow = np.append(at[1:], -1)
        follow[ends - 1] = -1
        lead = np.append(-1, at[:-1])
        lead[ends - group_n] = -1
        some = (follow != after) & (follow - at > p)
        self.next[at], self.previous[at] = follow, lead
        self.gaps.add(at[some], (follow - at)[some])

        labels = self.classes + np.arange(groups)
        self.classes += groups
        self.size[left] -= moved
        self.label[at] = np.repeat(labels, group_n)
        self.begin[labels], self.size[labels] = tail[ends - group_n], group_n


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of each span, one span after the other."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


def runs_of(words: Words, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, ...]:
    """Document, start, length and period of each run, by document, start and period."""
    found: list[tuple[np.ndarray, ...]] = []
    state = Refinement(words, min_length)
    going = True
    while going:
        at, period = state.squares(), state.length
        if len(at):  # squares that begin one after the other are one run
            new = np.append(True, np.diff(at) != 1)
            first, last = at[new], at[np.append(new[1:], True)]
            length = last - first + 2 * period
            long = length >= min_length
            found.append((first[long], length[long], np.full(long.sum(), period)))
        going = state.refine()
    start, length, period = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(3))
    doc = state.doc[start]
    word = start - words.offsets[doc] - doc - 1
    by = np.lexsort((period, word, doc))
    return doc[by], word[by], length[by], period[by]


def _rearranged(words: Words, ids: list, order: Callable[[object, int], np.ndarray | None]) -> Words:
    codes = words.codes
    for k, (key, n) in enumerate(zip(ids, words.counts.tolist(), strict=True)):
        if (places := order(key, n)) is not None:
            if codes is words.codes:
                codes = codes.copy()
            low = words.offsets[k]
            codes[low : low + n] = words.codes[low + places]
    return Words(words.offsets, codes, words.vocabulary)


def _scan(batches: Iterator[pa.RecordBatch], min_length: int, order: Callable[[object, int], np.ndarray | None] | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = split_words(batch.column("text"))
        if order is not None:
            words = _rearranged(words, batch.column("id").to_pylist(), order)
        doc, start, length, period = runs_of(words, min_length)
        low = words.offsets[doc]
        change = np.zeros(len(words.codes) + 1, np.int64)
        np.add.at(change, low + start + period, 1)
        np.add.at(change, low + start + length, -1)
        kept = np.cumsum(change)[:-1] == 0
        lists = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(doc, np.arange(len(words.offsets))), pa.int32()),
            pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"]),
        )
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(words.counts, pa.int64()), lists, words.joined(kept).cast(pa.string())], ["id", "n_words", "runs", "collapsed"]
        )


def find_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    order: Callable[[object, int], np.ndarray | None] | None = None,
) -> DataFrame:
    """One row per input row: id, n_words, runs (start, length, period: ordered by start, then period), collapsed text.

    A run is a stretch of words with smallest period q, of at least ``min_length`` words and two periods,
    that no neighbouring word extends. The collapsed text leaves out what a run says after its first q
    words; other words are joined by one space. ``order(id, n)`` may give the numbers of the words to
    look at, in their order, n of them; None leaves the text as it is.

    No row leaves its partition. Null and empty texts have no words and no runs; null and repeated ids are
    looked at each for itself; other columns are ignored, so their names may clash. An empty table gives an
    empty result. Work grows with n log n for a text of n words, whatever repeats in it, and memory with
    an Arrow batch of texts; a text longer than a batch is a batch.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = bound_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(lambda batches: _scan(batches, min_length, order), f"id {kind}, n_words long, runs {RUNS}, collapsed string")
    return found.withColumnRenamed("id", id_col)


def longest_run(runs: Column) -> Column:
    """The run with the greatest length, ties by smallest start, then period; null if there is none."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract of op12: every tenth document by crc32 of its id ends in a repetition of its own words."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_runs(docs, order=planted_order).withColumn("best", longest_run(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length, period = F.col("best.length"), -F.col("best.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
