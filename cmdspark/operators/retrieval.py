"""Ranking documents by cosine similarity of vectors."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cmdspark.functions.batches import append_column
from cmdspark.functions.shipping import ship_package
from cmdspark.functions.storage import materialize

DIMENSIONS = 256
#: What Spark takes for white space, and what Python does besides.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SEPARATORS = frozenset("\x1c\x1d\x1e\x1f")
#: Queries or documents of one block, and documents that are multiplied with a block of queries at once.
BLOCK_ROWS, PRODUCT_ROWS = 4096, 1024
#: Tasks' shares that documents are dealt to, about; with more documents each share has more of them, so that a query is sent to no more places.
PLACES = 256


def normalise(text: Column) -> Column:
    """Q1."""
    return F.translate(F.lower(text), "_", " ")


def expand(query: Column, hint: Column) -> Column:
    """Q6."""
    return F.concat_ws(" ", query, hint)


def _words(text: str) -> list[str]:
    """Words between white space; the four separators that only Python counts as such belong to words."""
    return text.split() if _SEPARATORS.isdisjoint(text) else [w for w in _SPACE.split(text) if w]


def _slot_counts(texts: list[str]) -> list[np.ndarray]:
    slots: dict[str, int] = {}
    out = []
    for text in texts:
        counts = np.zeros(DIMENSIONS, np.int64)
        for word, n in Counter(_words(text)).items():
            slot = slots.get(word)
            if slot is None:
                slot = slots[word] = hashlib.md5(word.encode()).digest()[0]
            counts[slot] += n
        out.append(counts.astype(np.float32))
    return out


def hashed_terms(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The offline encoder: (id, embedding) with the counts of the normalised text's words by a byte of their hash.

    One row per input row, made where the text lies: nothing is shuffled. Null texts have no terms.
    """
    normal = texts.select(F.col(id_col), normalise(F.coalesce(F.col(text_col), F.lit(""))).alias("__text"))
    return append_column(normal, "embedding", "array<float>", _slot_counts, "__text", drop=("__text",))


def embed(texts: DataFrame, encoder: Callable[[list[str]], np.ndarray], text_col: str = "text") -> DataFrame:
    """Q2: adds ``embedding``; ``encoder`` maps a batch of normalised texts to rows of numbers. ``hashed_terms`` is the offline default."""
    ship_package(texts.sparkSession)

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(np.asarray(encoder(batch.fillna("").tolist()), dtype=np.float32)))

    return texts.withColumn("embedding", encode(normalise(F.col(text_col))))


def _local_top(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """For each query the best k documents of a partition; a document without length or with a null has no similarity."""
    norm = np.linalg.norm(queries, axis=1)
    best_sim = np.full((len(ids), 0), -np.inf)
    best_doc = np.zeros((len(ids), 0), np.int64)
    for batch in batches:
        column = batch.column("embedding")
        doc = np.array(batch.column("doc_id").to_pylist(), dtype=np.int64)
        width = queries.shape[1]
        rows = [x.as_py() for x in column]
        good = np.array([x is not None and len(x) == width and None not in x for x in rows], dtype=bool)
        if not good.any():
            continue
        matrix = np.array([rows[i] for i in np.flatnonzero(good)], dtype=np.float64)
        length = np.linalg.norm(matrix, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            sim = queries @ matrix.T / (norm[:, None] * length[None, :])
        sim = np.where(np.isfinite(sim), sim, -np.inf)
        own = doc[good]
        if sim.shape[1] > k:
            # only what reaches the k-th best is sorted, with all its ties
            least = np.maximum(np.partition(sim, -k, axis=1)[:, -k], best_sim[:, -1] if best_sim.shape[1] == k else -np.inf)
            row, at = np.nonzero(sim >= least[:, None])
            value = sim[row, at]
            order = np.lexsort((own[at], -value, row))
            row, at, value = row[order], at[order], value[order]
            turn = np.arange(len(row)) - np.searchsorted(row, row)
            row, at, value, turn = (x[turn < k] for x in (row, at, value, turn))
            sim, docs = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
            sim[row, turn], docs[row, turn] = value, own[at]
        else:
            docs = np.broadcast_to(own, sim.shape)
        best_sim, best_doc = np.hstack([best_sim, sim]), np.hstack([best_doc, docs])
        order = np.lexsort((best_doc, -best_sim), axis=1)[:, :k]
        best_sim, best_doc = np.take_along_axis(best_sim, order, 1), np.take_along_axis(best_doc, order, 1)
    q, at = np.nonzero(np.isfinite(best_sim))
    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best_doc[q, at]), pa.array(best_sim[q, at])], ["query_id", "doc_id", "similarity"])


def _pair_top(docs: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """For each query of a block the best k documents of a block; queries of equal width are asked together."""
    asked: dict[int, list[tuple]] = {}
    for query_id, vector in zip(queries.column("query_id").to_pylist(), queries.column("embedding"), strict=True):
        asked.setdefault(len(vector), []).append((query_id, vector.as_py()))
    parts = []
    for rows in asked.values():
        ids = np.array([q for q, _ in rows], dtype=np.int64)
        matrix = np.array([v for _, v in rows], dtype=np.float64).reshape(len(rows), -1)
        parts += _local_top(iter(docs.to_batches(max_chunksize=PRODUCT_ROWS)), ids, matrix, k)
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("similarity", pa.float64())])
    return pa.Table.from_batches(parts, schema) if parts else schema.empty_table()


def _unit(rows: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the vectors have the width, no null and a length, and these scaled to length 1."""
    good = np.array([x is not None and len(x) == width and None not in x for x in rows], dtype=bool)
    matrix = np.array([rows[i] for i in np.flatnonzero(good)], dtype=np.float64).reshape(-1, width)
    with np.errstate(over="ignore", invalid="ignore"):
        length = np.linalg.norm(matrix, axis=1)
    sound = np.isfinite(length) & (length > 0)
    good[np.flatnonzero(good)[~sound]] = False
    return good, matrix[sound] / length[sound][:, None]


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


@dataclass(frozen=True)
class Cells:
    """Documents around pivots, which are some of the documents, each near its own, in rings by the angle to it.

    ``pivots`` has the unit vectors of each width. A block is a stretch of rings of one cell: ``low`` and
    ``high`` are the least and greatest angle that its documents may have. Small blocks in a row share a ``place``;
    the documents of a place are dealt to ``parts`` tasks.
    """

    pivots: dict[int, np.ndarray]
    cell: dict[int, np.ndarray]
    low: dict[int, np.ndarray]
    high: dict[int, np.ndarray]
    place: dict[int, np.ndarray]
    parts: dict[int, np.ndarray]

    def wanted(self, unit: np.ndarray, k: int) -> list[np.ndarray]:
        """Of each query the blocks that may hold one of its k best documents.

        The k-th best pivot is a document, so no better than the k-th best document. A block's best
        cosine is that of the least angle the triangle inequality allows; the slack is for rounding.
        """
        width = unit.shape[1]
        far = _angles(unit, self.pivots[width])
        at = min(k, far.shape[1]) - 1
        reach = np.partition(far, at, axis=1)[:, at] if k <= far.shape[1] else np.full(len(unit), np.pi)
        own = far[:, self.cell[width]]
        least = np.maximum(0.0, np.maximum(self.low[width] - own, own - self.high[width]))
        return [np.flatnonzero(row) for row in least <= reach[:, None] + 1e-6]


RING = 64  # rings for each unit of angle


def _place_documents(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Documents with their width, nearest pivot and angle to it; those without a similarity are left out."""
    for batch in batches:
        rows = batch.column("embedding").to_pylist()
        cell, angle, width_of = np.full(batch.num_rows, -1, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        for width in {len(x) for x in rows if x is not None} & set(pivots):
            good, unit = _unit(rows, width)
            far = _angles(unit, pivots[width])
            cell[good], angle[good], width_of[good] = far.argmin(axis=1), far.min(axis=1), width
        out = batch
        for name, value in (("width", width_of), ("cell", cell), ("angle", angle)):
            out = out.append_column(name, pa.array(value))
        yield out.filter(pa.array(cell >= 0))


def _places(sizes: np.ndarray, size: int) -> np.ndarray:
    """The place of each block: blocks in a row share one while they have no more than ``size`` documents."""
    of, now, held = np.zeros(len(sizes), np.int64), -1, size
    for k, n in enumerate(sizes.tolist()):
        if held + n > size:
            now, held = now + 1, 0
        of[k], held = now, held + n
    return of


def _blocks(rings: pd.DataFrame, block: int) -> tuple[list[int], np.ndarray]:
    """The block of each ring of a width (in order of cell and ring), and of each block its cell, least and greatest angle and documents."""
    of, blocks = [], []
    for cell, low, high, n in rings[["cell", "low", "high", "n"]].itertuples(index=False):
        if blocks and blocks[-1][0] == cell and blocks[-1][3] + n <= block:
            blocks[-1][2], blocks[-1][3] = high, blocks[-1][3] + n
        else:
            blocks.append([cell, low, high, n])
        of.append(len(blocks) - 1)
    return of, np.array(blocks, dtype=float).reshape(-1, 4)


def build_cells(docs: DataFrame, pivots: int = 512, block: int = BLOCK_ROWS) -> tuple[Cells, DataFrame]:
    """Cells of documents (doc_id, embedding) around about ``pivots`` of them for each width, taken by a hash; and the documents with (width, place, parts).

    A place has ``block`` documents or, of many, the ``PLACES``-th part: the number of places that a query is sent to has a limit.

    The driver gets the pivots and one row for each ring that has documents, at most pivots x pi x RING for
    a width. Where each document lies is written once, so that all that is said of its ring is true of it.
    """
    spark = docs.sparkSession
    ship_package(spark)
    sound = docs.filter(F.size("embedding") > 0)
    sizes = {r["width"]: r["count"] for r in sound.groupBy(F.size("embedding").alias("width")).count().collect()}
    share = F.element_at(F.create_map(*[F.lit(x) for w, n in sizes.items() for x in (w, min(1.0, pivots / n))]), F.size("embedding")) if sizes else F.lit(0.0)
    vectors: dict[int, list] = {width: [] for width in sizes}
    for r in sound.filter(F.pmod(F.xxhash64("doc_id", "embedding", F.lit(3)), F.lit(1 << 30)) < share * (1 << 30)).select("embedding").collect():
        vectors[len(r["embedding"])].append(r["embedding"])
    units = {width: _unit(rows, width)[1] for width, rows in vectors.items()}
    # without a pivot an axis takes its place, which is no document and bounds nothing
    chosen = {width: unit if len(unit) else np.eye(1, width) for width, unit in units.items()}
    kind = docs.schema["embedding"].dataType.simpleString()
    placed = docs.mapInArrow(lambda it: _place_documents(it, chosen), f"doc_id long, embedding {kind}, width long, cell long, angle double")
    placed = materialize(placed.withColumn("ring", F.floor(F.col("angle") * RING)), "cells")
    rings = placed.groupBy("width", "cell", "ring").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("width", "cell", "ring").toPandas()
    arrays: dict[str, dict] = {k: {} for k in ("cell", "low", "high", "place", "parts")}
    lookup = []
    for width in chosen:
        own = rings[rings["width"] == width]
        of, table = _blocks(own, block)
        held = table[:, 3].astype(np.int64)
        size = max(block, -(-int(held.sum()) // PLACES))
        place = _places(held, size)
        parts = np.maximum(1, -(-np.bincount(place, held).astype(np.int64) // size))
        lookup += [(int(width), int(c), int(r), int(place[b]), int(parts[place[b]])) for c, r, b in zip(own["cell"], own["ring"], of, strict=True)]
        bounded = len(units[width]) > 0
        arrays["cell"][width], arrays["place"][width], arrays["parts"][width] = table[:, 0].astype(np.int64), place, parts
        arrays["low"][width], arrays["high"][width] = (table[:, 1], table[:, 2]) if bounded else (np.zeros(len(table)), np.full(len(table), np.pi))
    known = spark.createDataFrame(lookup, "width long, cell long, ring long, place long, parts long")
    return Cells(chosen, **arrays), placed.join(F.broadcast(known), ["width", "cell", "ring"]).select("doc_id", "embedding", "width", "place", "parts")


def _deal_queries(batches: Iterator[pa.RecordBatch], cells: Cells, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column("embedding").to_pylist()
        for width in {len(x) for x in rows} & set(cells.pivots):
            good, unit = _unit(rows, width)
            for at, wanted in zip(np.flatnonzero(good).tolist(), cells.wanted(unit, k), strict=True):
                # each place's parts, one row each
                wanted = np.unique(cells.place[width][wanted])
                part = np.concatenate([np.arange(n) for n in cells.parts[width][wanted]]) if len(wanted) else np.zeros(0, np.int64)
                place = np.repeat(wanted, cells.parts[width][wanted])
                same = pa.array(np.full(len(part), at))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id").take(same), batch.column("embedding").take(same), pa.array(np.full(len(part), width)), pa.array(place.astype(np.int64)), pa.array(part.astype(np.int64))],
                    ["query_id", "embedding", "width", "place", "part"],
                )


def deal_queries(asked: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(query_id, embedding, width, place, part): a row for each part of a place that a query must look at."""
    kind = asked.schema["embedding"].dataType.simpleString()
    return asked.mapInArrow(lambda it: _deal_queries(it, cells, k), f"query_id long, embedding {kind}, width long, place long, part long")


def top_documents(docs: DataFrame, queries: DataFrame, k: int = 3, query_block: int = BLOCK_ROWS, doc_block: int = BLOCK_ROWS, pivots: int = 512) -> DataFrame:
    """Q3, Q4: (query_id, rank, doc_id, similarity): the k nearest documents of each query, ties by id.

    Up to ``query_block`` queries go to the documents, which stay where they are. More of them are dealt
    to cells of documents: documents lie in blocks by their nearest pivot and the angle to it, and a query is sent only to
    blocks that can hold one of its k best (``Cells``), which loses none. Documents are shuffled once, to
    their place; one that over ``query_block`` queries, and over ``BLOCK_ROWS``, look at has a copy for each such number of them.
    A query is sent to ``PLACES`` or so at most; where bounds spare nothing, products of whole blocks still grow with both sides.
    Neither side has a limit.
    """
    ship_package(docs.sparkSession)
    asked = queries.select(F.col("query_id").cast("long"), "embedding").filter("embedding is not null")
    held = docs.select(F.col("doc_id").cast("long"), "embedding")
    few = asked.limit(query_block + 1).toArrow()
    if few.num_rows <= query_block:
        kinds = "query_id long, doc_id long, similarity double"
        local = held.mapInArrow(lambda it: (b for d in it for b in _pair_top(pa.Table.from_batches([d]), few, k).to_batches()), kinds)
        return _ranked(local, k)
    cells, dealt = build_cells(held, pivots, doc_block)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("doc_id", "embedding"), F.col("parts")))
    sent = materialize(deal_queries(asked, cells, k), "asked")
    place = ["width", "place", "part"]
    loads = sent.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / max(query_block, BLOCK_ROWS)).alias("turns")).filter("turns > 1")
    right = sent.join(loads, place, "left").withColumn("turn", F.pmod(F.xxhash64("query_id", "embedding"), F.coalesce("turns", F.lit(1))))
    copies = loads.select(*[F.col(c).alias(c) for c in place], F.col("turns").alias("copies"))
    left = dealt.join(copies, place, "left").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1)))
    local = left.groupBy(*place, "turn").cogroup(right.groupBy(*place, "turn")).applyInArrow(lambda d, q: _pair_top(d, q, k), "query_id long, doc_id long, similarity double")
    return _ranked(local, k)


def _ranked(local: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "similarity")


def context(ranked: DataFrame, texts: DataFrame) -> DataFrame:
    """Q5: (query_id, context): the texts of a query's documents, best first, a line feed between."""
    joined = ranked.join(texts.select("doc_id", "text"), "doc_id")
    return joined.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("context"))
