"""Best-fit packing of token sequences, certified by lower bounds from dual feasible functions."""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, materialize

CAPACITY = 2048
#: Pieces that one task packs at once.
GROUP_PIECES = 50_000

#: The fast encoder's pattern matcher gives up on runs of about a million blanks; texts with runs this long don't reach it.
#: A run is entered at its start only, so that the search takes one pass.
_LONG_RUN = re.compile(r"(?<!\s)\s{50000}")

_encoders: dict[str, tuple] = {}


def tokenizer_folder() -> str:
    import public_tokenizers

    return os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


def _encoder(folder: str) -> tuple:
    """The tokenizer of byte_bpe_50k.json, a fast encoder with the same vocabulary, and a pattern of the special tokens, which only the former knows."""
    if folder not in _encoders:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(f"{folder}/byte_bpe_50k.json")
        with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        special = re.compile("|".join(re.escape(t.content) for t in exact.get_added_tokens_decoder().values()) or r"(?!)")
        _encoders[folder] = exact, fast, special
    return _encoders[folder]


def token_ids(text: str, folder: str) -> np.ndarray:
    """Ids of a text by byte_bpe_50k.json and the closing id 0, as little-endian 32-bit numbers."""
    exact, fast, special = _encoder(folder)
    if special.search(text) or _LONG_RUN.search(text):
        ids = exact.encode(text, add_special_tokens=False).ids
    else:
        ids = fast.encode_ordinary(text)
    return np.array([*ids, 0], dtype="<u4")


def _pieces(batches: Iterator[pa.RecordBatch], capacity: int, folder: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for id_, item in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
            ids = token_ids(item.as_py() or "", folder)
            at, n = 0, len(ids) % capacity or capacity  # the first piece takes what doesn't fill a sequence
            piece = 0
            while at < len(ids):
                part = ids[at : at + n]
                for column, value in zip(out, (id_, piece, at, len(part), zlib.crc32(part.tobytes())), strict=True):
                    column.append(value)
                at, n, piece = at + n, capacity, piece + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())],
            ["id", "piece", "start", "length", "ids_crc32"],
        )


def tokenise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    """Pieces of each document's ids: id, piece, start, length, ids_crc32. Only documents over ``capacity`` are cut."""
    folder = folder or tokenizer_folder()
    rows = bound_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _pieces(it, capacity, folder), "id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest bins that any packing needs, by dual feasible functions.

    Two families: lengths over capacity - k count as whole bins, those under k as nothing, for each k up
    to half; and lengths rounded to multiples of capacity / k, which stay if they are exact.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    below = np.concatenate([[0], np.cumsum(count * size)])  # below[x]: total of lengths under x
    many = np.concatenate([[0], np.cumsum(count)])
    best = -(-int(below[-1]) // capacity)
    for k in range(1, capacity // 2 + 1):
        large = int(many[-1] - many[capacity - k + 1])
        best = max(best, large + -(-int(below[capacity - k + 1] - below[k]) // capacity))
    for k in range(1, 40):
        scaled = size * (k + 1)
        worth = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((worth * count).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length: longest first, each into the fullest bin that has room.

    Bins wait by the room they have; a bit for each amount of room that some bin has makes the search
    for the least that suffices one operation on a number of ``capacity`` bits.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, 0
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        fit = rooms >> need
        if fit:
            room = need + (fit & -fit).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                rooms &= ~(1 << room)
        else:
            b, room, made = made, capacity, made + 1
        bins[i], offsets[i] = b, capacity - room
        if room > need:
            left = room - need
            if not waiting[left]:
                rooms |= 1 << left
            waiting[left].append(b)
    return bins, offsets


def _pack_group(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "key"], ascending=[False, True], kind="stable")
    lengths = pdf["length"].to_numpy(np.int64)
    bins, offsets = best_fit_decreasing(lengths, capacity)
    made, bound = int(bins.max()) + 1, lower_bound(lengths, capacity)
    fill = np.bincount(bins, weights=lengths, minlength=made)
    return pd.DataFrame({
        "key": pdf["key"], "length": lengths, "grp": pdf["grp"], "bin": bins, "offset": offsets,
        "bins": made, "bound": bound, "bin_full": fill[bins] >= capacity,
    })


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, seed: int = 3) -> DataFrame:
    """Give each row of ``pieces`` (key long, unique; length) a sequence_id and an offset.

    Rows are dealt at random to groups of about ``group_pieces``, each packed best fit decreasing by one
    task. A group whose number of bins equals its lower bound is certified and final. Of the others the
    full bins are final too; what lies in their bins that aren't full is exchanged: dealt anew, into
    groups of the same size and so fewer of them, and packed again, until all are certified, one group
    is left, or a round needs as many bins as the one before, which ends it: every round but the last
    saves a bin. ``group_id``, ``group_bins`` and ``group_bound`` are those of the group that placed the row:
    equal numbers certify that the group can't be packed in fewer. A group never depends on a key of the
    data, so no skew reaches it. Lengths are from 1 to ``capacity``; anything else is an error.
    """
    todo = materialize(pieces.select("key", F.col("length").cast("long").alias("length")), "pack-in")
    schema = "key long, length long, grp int, bin long, offset long, bins long, bound long, bin_full boolean"
    placed: list[DataFrame] = []
    turn, open_bins = 0, None
    while True:
        groups = max(1, -(-todo.count() // group_pieces))
        dealt = todo.withColumn("grp", F.pmod(F.xxhash64("key", F.lit(seed + turn)), F.lit(groups)).cast("int"))
        packed = materialize(dealt.groupBy("grp").applyInPandas(lambda pdf: _pack_group(pdf, capacity), schema), "packed")
        # the piece at the beginning of a bin stands for it
        made, left = packed.filter("offset = 0").agg(F.count(F.lit(1)), F.count_if((F.col("bins") > F.col("bound")) & ~F.col("bin_full"))).first()
        last = groups == 1 or left == 0 or (open_bins is not None and made >= open_bins)
        final = F.lit(True) if last else (F.col("bins") == F.col("bound")) | F.col("bin_full")
        placed.append(packed.filter(final).select("key", "offset", F.lit(turn).alias("turn"), "grp", "bin", "bins", "bound"))
        if last:
            break
        todo, open_bins, turn = packed.filter(~final).select("key", "length"), left, turn + 1
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    # round, group and bin fit one number: fewer than 2^26 groups and bins of a group, fewer than 2^11 rounds
    group = F.shiftleft(F.col("turn").cast("long"), 26) + F.col("grp")
    return out.select("key", (F.shiftleft(group, 26) + F.col("bin")).alias("sequence_id"), "offset", group.alias("group_id"), F.col("bins").alias("group_bins"), F.col("bound").alias("group_bound"))


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, folder: str | None = None
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, group_id, group_bins, group_bound (see ``pack``).

    Null and empty texts are the closing id alone. Null and repeated ids, and repeated rows, are packed
    each for itself. Whole texts are tokenised once; what is packed and exchanged is numbers. Other
    columns are ignored. An empty table gives an empty result.
    """
    pieces = materialize(tokenise(docs, id_col, text_col, capacity, folder).withColumn("key", F.monotonically_increasing_id()), "pieces")
    packed = pack(pieces.select("key", "length"), capacity, group_pieces)
    return pieces.join(packed, "key").select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "group_id", "group_bins", "group_bound")


def op3_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
