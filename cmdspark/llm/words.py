"""The words of many texts at once: one array of numbers for all of them, made and joined by Arrow."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Words:
    """Words ``codes[offsets[k]:offsets[k + 1]]`` of text k, as places in ``vocabulary``, whose entries all differ."""

    offsets: np.ndarray
    codes: np.ndarray
    vocabulary: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def joined(self, kept: np.ndarray) -> pa.Array:
        """Each text's words of which ``kept`` is true, joined by one space."""
        ends = np.concatenate([[0], np.cumsum(kept)])[self.offsets]
        words = self.vocabulary.take(pa.array(self.codes[kept]))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), words), pa.scalar(" ", words.type))


def split_words(texts: pa.Array) -> Words:
    """Runs of characters other than x20 and x09 to x0D, which is what Arrow takes for ASCII white space; null has none."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    flat = lists.flatten()  # with an empty string before white space at the beginning, after it at the end, and for an empty text
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    encoded = flat.filter(full).dictionary_encode()
    return Words(before[starts].astype(np.int64), encoded.indices.to_numpy().astype(np.int64), encoded.dictionary)
