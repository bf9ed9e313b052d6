"""Near-duplicate classes of documents: ProbMinHash over five-word shingles, banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, bound_batches, hot_keys, materialize, skew_join

WORDS = 5
THRESHOLD = 0.8
#: With 30 bands of 6 rows a pair at similarity 0.8 shares a band with probability 0.9999, at 0.3 with 0.02.
BANDS, ROWS = 30, 6
#: Bytes of text and documents hashed at a time, so that arrays stay at some tens of MB whatever the documents' lengths.
PIECE, PIECE_DOCS = 1 << 20, 2048
#: Members of a bucket that one task compares with as many others.
BLOCK = 512

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of a splittable 64-bit generator: every input bit changes every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_PLACE = mix64(np.arange(101, 101 + WORDS, dtype=np.uint64) * _GOLDEN) | np.uint64(1)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each word in ``data``, the UTF-8 of documents that begin and end at ``bounds``."""
    sep = _SEPARATOR[data]
    start = ~sep
    start[1:] &= sep[:-1]
    first = bounds[:-1][bounds[:-1] < bounds[1:]] - bounds[0]
    start[first] = ~sep[first]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.empty(len(starts), np.uint64)
    ends = np.append(starts[1:], len(data))
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + PIECE, "right")))
        lo, own = starts[a], starts[a:b]
        part = data[lo : ends[b - 1]]
        place = np.arange(len(part)) - np.repeat(own - lo, ends[a:b] - own)
        power = np.cumprod(np.full(int(place.max()) + 1, 0xD6E8FEB86659FD93, np.uint64))
        out[a:b] = np.add.reduceat(np.where(_SEPARATOR[part], np.uint64(0), _BYTE[part] * power[place]), own - lo)
        a = b
    return mix64(out), np.searchsorted(bounds - bounds[0], starts, "right") - 1


def shingle_hashes(words: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each run of WORDS words; documents with fewer words have one shingle, of all of them."""
    count = np.bincount(doc, minlength=docs)
    full = np.zeros(0, np.int64)
    if len(words) >= WORDS:
        full = np.flatnonzero(doc[: len(doc) - WORDS + 1] == doc[WORDS - 1 :])
    total = np.zeros(len(full), np.uint64)
    for j in range(WORDS):
        total += words[full + j] * _PLACE[j]
    few = np.flatnonzero((count > 0) & (count < WORDS))
    at = (np.cumsum(count) - count)[few]
    rest = np.zeros(len(few), np.uint64)
    for j in range(WORDS):
        has = count[few] > j
        rest[has] += words[at[has] + j] * _PLACE[j]
    hashes, where = np.concatenate([mix64(total), mix64(rest)]), np.concatenate([doc[full], few])
    order = np.argsort(where, kind="stable")
    return hashes[order], where[order]


def prob_minhash(element: np.ndarray, doc: np.ndarray, weight: np.ndarray, docs: int, m: int) -> np.ndarray:
    """The ProbMinHash signature of each document: for each of m places the element that arrived there first.

    Each element is a Poisson process whose rate is its weight; every arrival falls on a place drawn by
    the element's own generator. A process stops once its next arrival is later than all of its
    document's places were reached. Places of two documents agree with the probability Jaccard
    similarity of their weights. ``element`` may have 44 bits, ``doc`` is ascending.
    """
    if m > 2048:
        raise ValueError("a draw has 11 bits for the place")
    first = np.full(docs * m, np.inf)
    winner = np.zeros(docs * m, np.uint64)
    latest = np.full(docs, np.inf)
    state = mix64(element + _GOLDEN)
    now, arrival = np.zeros(len(element)), 0
    while len(element):
        block = int(min(64, max(1, 200_000 // len(element))))
        number = np.arange(arrival + 1, arrival + 1 + block, dtype=np.uint64) * _GOLDEN
        draw = mix64(state[:, None] + number[None, :])
        gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        time = now[:, None] + np.cumsum(gap / weight[:, None], axis=1)
        place = doc[:, None] * m + ((draw & np.uint64(2047)) * np.uint64(m) >> np.uint64(11)).astype(np.int64)
        use = time < latest[doc][:, None]
        at, when = place[use], time[use]
        np.minimum.at(first, at, when)
        won = when == first[at]
        winner[at[won]] = np.broadcast_to(element[:, None], use.shape)[use][won]
        here = doc[np.r_[True, doc[1:] != doc[:-1]]]
        latest[here] = first.reshape(docs, m)[here].max(axis=1)
        now, arrival = time[:, -1], arrival + block
        going = now < latest[doc]
        element, doc, weight, state, now = element[going], doc[going], weight[going], state[going], now[going]
    return winner.reshape(docs, m)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about PIECE bytes of text and PIECE_DOCS documents at most, their UTF-8 and each document's bounds in it; null text is empty."""
    text = batch.column("text").cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(text):
        b = min(a + PIECE_DOCS, max(a + 1, int(np.searchsorted(bounds, bounds[a] + PIECE, "right")) - 1))
        yield batch.slice(a, b - a), data[bounds[a] : bounds[b]], bounds[a : b + 1]
        a = b


def _node(words: np.ndarray, doc: np.ndarray, docs: int) -> list[bytes]:
    """128 bits of each document's sequence of words: equal for documents that differ in white space only."""
    place = np.arange(len(words), dtype=np.uint64) - np.repeat(np.cumsum(n := np.bincount(doc, minlength=docs)) - n, n).astype(np.uint64)
    halves = []
    for salt in _PLACE[:2]:
        each = mix64(words ^ mix64((place + np.uint64(1)) * salt))
        total = np.zeros(docs, np.uint64)
        np.add.at(total, doc, each)
        halves.append(mix64(total + n.astype(np.uint64) * _GOLDEN))
    return [x.tobytes() for x in np.stack(halves, axis=1)]


def _sign(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    m = bands * rows
    salt = mix64(np.arange(m, dtype=np.uint64) + np.uint64(7)).reshape(bands, rows)
    for batch in batches:
        for own, data, bounds in _texts(batch):
            docs = len(own)
            words, word_doc = word_hashes(data, bounds)
            shingle, doc = shingle_hashes(words, word_doc, docs)
            key = np.unique((doc.astype(np.uint64) << np.uint64(44)) | (shingle >> np.uint64(20)))
            element, doc = key & np.uint64((1 << 44) - 1), (key >> np.uint64(44)).astype(np.int64)
            # of equal weights: places agree with the set Jaccard similarity, the one that _verify asks for
            signature = prob_minhash(element, doc, np.ones(len(element)), docs, m)
            band = mix64((mix64(signature.reshape(docs, bands, rows) + salt) * (salt | np.uint64(1))).sum(axis=2, dtype=np.uint64)).view(np.int64)
            some = np.bincount(doc, minlength=docs) > 0
            flat = pa.array(band[some].ravel())
            ends = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
            small = (mix64(signature) & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [own.column("id"), own.column("rid"), pa.array(_node(words, word_doc, docs), pa.binary()), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array([x.tobytes() for x in small], pa.binary())],
                ["id", "rid", "node", "bands", "signature"],
            )


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for own, data, bounds in _texts(batch):
            words, word_doc = word_hashes(data, bounds)
            shingle, doc = shingle_hashes(words, word_doc, len(own))
            cut = np.searchsorted(doc, np.arange(len(own) + 1))
            sets = [np.unique(shingle[cut[i] : cut[i + 1]]).tobytes() for i in range(len(own))]
            yield pa.RecordBatch.from_arrays([pa.array(_node(words, word_doc, len(own)), pa.binary()), pa.array(sets, pa.binary())], ["node", "shingles"])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of sorted arrays without repeats."""
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("left_set"), batch.column("right_set")
        keep = [jaccard(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) >= threshold for x, y in zip(left, right, strict=True)]
        yield batch.select(["left", "right"]).filter(pa.array(keep, pa.bool_()))


def _compare_block(group: pa.Table, threshold: float, margin: float) -> pa.Table:
    """Links between the group's members of different components, enough of them to join what belongs together."""
    order = np.argsort(np.array(group.column("place").to_pylist()), kind="stable")
    node = [group.column("node")[int(i)].as_py() for i in order]
    sets = [np.frombuffer(group.column("shingles")[int(i)].as_py(), np.uint64) for i in order]
    signature = np.stack([np.frombuffer(group.column("signature")[int(i)].as_py(), np.uint8) for i in order])
    _, comp = np.unique([group.column("comp")[int(i)].as_py().hex() for i in order], return_inverse=True)
    place = np.sort(np.array(group.column("place").to_pylist()))
    size, parent, links = np.array([len(s) for s in sets]), list(range(comp.max() + 1)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(node)):
        others = np.arange(i + 1, len(node))
        if place[0] != place[-1]:  # two blocks: pairs within either have a task of their own
            others = others[place[others] != place[i]]
        others = others[(comp[others] != comp[i]) & (np.minimum(size[others], size[i]) >= threshold * np.maximum(size[others], size[i]))]
        alike = (signature[others] == signature[i]).mean(axis=1) if len(others) else np.zeros(0)
        near = np.flatnonzero(alike >= threshold - margin)
        for k in near[np.argsort(-alike[near], kind="stable")]:
            j = int(others[k])
            a, b = root(int(comp[i])), root(int(comp[j]))
            if a != b and jaccard(sets[i], sets[j]) >= threshold:
                parent[a] = b
                links.append((node[i], node[j]))
    return pa.table([pa.array([x for x, _ in links], pa.binary()), pa.array([y for _, y in links], pa.binary())], ["left", "right"])


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node in ``links`` (left, right); comp is the least node of its connected component.

    Each round every node takes the least label around it and then its label's label; the work of a round
    is in proportion to the links, and labels reach over twice the distance each time. The driver sees
    only whether a label changed.
    """
    both = materialize(links.unionByName(links.select(F.col("right").alias("left"), F.col("left").alias("right"))).distinct(), "links")
    label = materialize(both.groupBy(F.col("left").alias("node")).agg(F.least("node", F.min("right")).alias("comp")), "labels")
    while True:
        around = both.join(label, both["right"] == label["node"]).groupBy("left").agg(F.min("comp").alias("near"))
        near = label.join(around, label["node"] == around["left"]).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = label.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        moved = materialize(near.join(jump, "comp").select("node", F.least("comp", "further").alias("comp"), (F.col("old") != F.least("comp", "further")).alias("moved")), "labels")
        label = moved.select("node", "comp")
        if moved.filter("moved").isEmpty():
            return label


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    block: int = BLOCK,
    row_col: str | None = None,
) -> DataFrame:
    """One row per input row: id, class_id, class_size, kept; and ``row_col``, unique numbers stored with the rows, where it is given.

    A class is a connected component of documents whose sets of five-word shingles have a Jaccard
    similarity of ``threshold`` or more; its class_id is its least id, the one kept.

    1. Copies (equal sequences of words) become one node, its set of shingles one ProbMinHash signature
       (all weights 1, so that it estimates the criterion however often a shingle is repeated), cut into bands.
    2. Every member of a bucket is paired with the bucket's leader, chosen by a hash of band and node: as
       many pairs as members. Pairs are verified on whole shingle sets and their components found.
    3. Buckets that still have several components are compared in blocks of ``block`` members, each pair
       of blocks a task that returns spanning links only. No bucket is capped and none sits in one task.
       Members of a bucket's largest component aren't compared with each other again, so the work is in
       proportion to the others times all, and only a bucket of many small components costs its square.

    Words are runs of characters other than x20 and x09 to x0D. Null and empty texts have no shingles:
    they are copies of each other and near nothing else. Null ids come after all others; of repeated
    rows with the least id just one is kept. Other columns are ignored. An empty table gives an empty
    result.
    """
    number = F.col(row_col) if row_col else F.monotonically_increasing_id()
    text = bound_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), number.alias("rid"))
    signed = materialize(
        text.mapInArrow(
            lambda it: _sign(it, bands, rows), "id long, rid long, node binary, bands array<long>, signature binary"
        ),
        "signatures",
    )
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("rid").alias("rid")))
    nodes = materialize(
        signed.groupBy("node").agg(first.alias("first"), F.count(F.lit(1)).alias("n"), F.max("bands").alias("bands"), F.max("signature").alias("signature")), "nodes"
    )
    entry = nodes.select("node", F.posexplode("bands").alias("band", "key")).select("node", "band", F.xxhash64("band", "key").alias("bucket"))
    leaders = materialize(
        entry.groupBy("bucket")
        .agg(F.min(F.struct(F.xxhash64("band", "node").alias("h"), F.col("node"))).alias("least"), F.count(F.lit(1)).alias("members"))
        .filter("members > 1")
        .select("bucket", F.col("least.node").alias("leader"), "members"),
        "leaders",
    )
    # a bucket with over 1/HOT_SHARE of the entries, so fewer than HOT_SHARE of them, meets its leader by broadcast
    entries = nodes.agg(F.sum(F.size("bands"))).first()[0] or 0
    hot = leaders.filter(F.col("members") * HOT_SHARE > F.lit(entries)).select("bucket")
    members = materialize(skew_join(entry.select("node", "bucket"), leaders, "bucket", hot), "buckets")
    pairs = materialize(members.filter("node <> leader").select("node", "leader").distinct(), "pairs")
    # texts are read again for the nodes that have a candidate
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select(F.col("first.id").alias("wanted"))
    sets = materialize(
        text.join(wanted, text["id"].eqNullSafe(wanted["wanted"]), "left_semi").select("text").mapInArrow(_shingle_sets, "node binary, shingles binary").dropDuplicates(["node"]),
        "shingle-sets",
    )
    links = materialize(_check_pairs(pairs, sets, threshold), "star-links")
    comp = components(links)
    placed = members.filter("members > 2").select("bucket", "node").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    by_comp = placed.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node") % (1 << 40)).alias("who"), F.bit_xor(F.xxhash64("node", F.lit(2))).alias("and_who"))
    mixed = (
        by_comp.groupBy("bucket")
        .agg(F.max(F.struct("n", "comp")).alias("major"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("comps"), F.sum("who").alias("who"), F.bit_xor("and_who").alias("and_who"))
        .filter("comps > 1")
        .groupBy("who", "and_who", "members").agg(F.min(F.struct("bucket", "major")).alias("b"))  # bands whose buckets have the same members need one comparison
        .select(
            F.col("b.bucket").alias("bucket"), F.col("b.major.comp").alias("major"),
            # what fits one block is one; else the largest component has blocks of its own
            F.when(F.col("members") > block, F.ceil(F.col("b.major.n") / block)).otherwise(F.lit(0)).cast("int").alias("major_blocks"),
            F.when(F.col("members") > block, F.ceil((F.col("members") - F.col("b.major.n")) / block)).otherwise(F.lit(1)).cast("int").alias("other_blocks"),
        )
    )
    # blocks of the bucket's largest component come first; its members are joined already, so those blocks only meet the others
    is_major, spot = (F.col("comp") == F.col("major")) & (F.col("major_blocks") > 0), F.xxhash64("node", F.lit(1))
    spread = (
        placed.join(mixed, "bucket")
        .withColumn("place", F.when(is_major, F.pmod(spot, "major_blocks")).otherwise(F.col("major_blocks") + F.pmod(spot, "other_blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.when(is_major, F.col("major_blocks")).otherwise(F.lit(0)), F.col("major_blocks") + F.col("other_blocks") - 1)))
        .select("bucket", "node", "comp", "place", F.least("place", "other").alias("low"), F.greatest("place", "other").alias("high"))
        .join(nodes.select("node", "signature"), "node")
        .join(sets, "node")
    )
    more = materialize(
        spread.groupBy("bucket", "low", "high").applyInArrow(lambda t: _compare_block(t, threshold, 0.2), "left binary, right binary"), "block-links"
    )
    if not more.isEmpty():
        comp = components(links.unionByName(more))
    grouped = materialize(nodes.select("node", "first", "n").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "node-classes")
    classes = grouped.groupBy("comp").agg(F.min("first").alias("keep"), F.sum("n").alias("size"))
    by_node = grouped.select("node", "comp").join(classes, "comp").select("node", F.col("keep.id").alias("class_id"), F.col("keep.rid").alias("keep_rid"), "size")
    rows_ = signed.select("id", "rid", "node")
    return skew_join(rows_, by_node, "node", hot_keys(rows_, "node")).select(
        F.col("id").alias(id_col), "class_id", F.col("size").cast("long").alias("class_size"), (F.col("rid") == F.col("keep_rid")).alias("kept"), *([F.col("rid").alias(row_col)] if row_col else [])
    )


def _check_pairs(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (node, leader) whose shingle sets are similar enough, as (left, right).

    A node's set travels to its leaders. A leader with over 1/HOT_SHARE of the pairs has a copy for each such
    share of them, fewer than 2 * HOT_SHARE copies in all, and its nodes are dealt to the copies.
    """
    total = pairs.count()
    often = pairs.groupBy("leader").count().filter(F.col("count") * HOT_SHARE > F.lit(total))
    copies = F.broadcast(materialize(often.select("leader", F.ceil(F.col("count") * HOT_SHARE / F.lit(max(1, total))).cast("int").alias("copies")), "hot-leaders"))
    own = pairs.join(sets.select("node", F.col("shingles").alias("left_set")), "node").join(copies, "leader", "left")
    own = own.withColumn("copy", F.pmod(F.xxhash64("node"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    led = sets.select(F.col("node").alias("leader"), F.col("shingles").alias("right_set")).join(copies, "leader", "left")
    led = led.withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    joined = own.join(led, ["leader", "copy"]).select(F.col("node").alias("left"), F.col("leader").alias("right"), "left_set", "right_set")
    return joined.mapInArrow(lambda it: _verify(it, threshold), "left binary, right binary")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
