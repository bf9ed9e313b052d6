"""Nearest known word by the Ratcliff-Obershelp ratio, with bounds that spare most comparisons."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa

CUTOFF = 0.6


def _tokens(text: str) -> Iterator[tuple[str, int]]:
    """Each character with its turn among equal ones, so that shared tokens count shared characters."""
    seen: Counter = Counter()
    for c in text:
        seen[c] += 1
        yield c, seen[c]


def longest_common(masks: dict[str, int], length: int, other: str) -> int:
    """Length of the longest common subsequence of ``other`` and a text, of which ``masks`` has the places of each character."""
    rest = full = (1 << length) - 1
    for c in other:
        hit = rest & masks.get(c, 0)
        rest = ((rest + hit) | (rest - hit)) & full
    return length - rest.bit_count()


class NameIndex:
    """Names with an inverted index: for each character and turn, the names that have it.

    A ratio is twice the matched characters over both lengths. What two texts share of characters, and
    then the longest common subsequence, are upper bounds of the matched ones. Names are looked at with
    the best bound first, until no bound reaches the best ratio found, so the result is that of all pairs.
    """

    def __init__(self, names: list[str]):
        self.names = sorted(set(names))
        self.lengths = np.array([len(n) for n in self.names], np.int64)
        places: dict[tuple[str, int], list[int]] = {}
        for at, name in enumerate(self.names):
            for token in _tokens(name):
                places.setdefault(token, []).append(at)
        self.places = {token: np.array(at) for token, at in places.items()}
        self.compared = 0

    def best(self, word: str) -> tuple[float, str] | None:
        """The best ratio of ``CUTOFF`` or more and its name, ties to the larger name."""
        shared = np.zeros(len(self.names), np.int64)
        for token in _tokens(word):
            if token in self.places:
                shared[self.places[token]] += 1
        most = 2.0 * shared / np.maximum(self.lengths + len(word), 1)
        at = np.flatnonzero(most >= CUTOFF)
        found: tuple[float, str] | None = None
        matcher = SequenceMatcher(None, "", word)
        masks: dict[str, int] = {}
        for k, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << k
        for k in at[np.lexsort((-at, -most[at]))].tolist():
            name, least = self.names[k], found[0] if found else CUTOFF
            if most[k] < least:
                break
            if 2.0 * longest_common(masks, len(word), name) / (len(name) + len(word)) < least:
                continue
            matcher.set_seq1(name)
            self.compared += 1
            if (ratio := matcher.ratio()) >= CUTOFF and (found is None or (ratio, name) > found):
                found = ratio, name
        return found


def nearest(words: list[str | None], known: list[list[str] | None]) -> list[str | None]:
    """The best of each row's ``known`` words with a ratio of CUTOFF or more, ties to the larger; else null."""
    indexes: dict[tuple[str, ...], NameIndex] = {}
    out = []
    for word, names in zip(words, known, strict=True):
        found = None
        if word is not None and names:
            key = tuple(n for n in names if n is not None)
            if key not in indexes:
                indexes[key] = NameIndex(list(key))
            found = indexes[key].best(word)
        out.append(found[1] if found else None)
    return out


def nearest_of_block(words: pa.Table, names: pa.Table) -> pa.Table:
    """(word, ratio, name, compared): for each word of a block the best name of a block, if one has a ratio of CUTOFF or more, and how many were compared."""
    index = NameIndex([n for n in names.column("name").to_pylist() if n is not None])
    out = []
    for word in words.column("word").to_pylist():
        if word is not None:
            before = index.compared
            ratio, name = index.best(word) or (None, None)
            out.append((word, ratio, name, index.compared - before))
    kinds = {"word": pa.string(), "ratio": pa.float64(), "name": pa.string(), "compared": pa.int64()}
    return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds.values())], list(kinds))
