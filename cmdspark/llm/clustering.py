"""Centroid clustering of integer vectors, exact, with whole balls of a metric tree assigned at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, materialize

#: Components lie in this range, so that squared distances of 64 of them and more fit a long.
LARGEST = 1 << 27
#: Vectors of a tree (one is built of each Arrow batch or part of it), and of a leaf.
TREE, LEAF = 8192, 24


class Tree:
    """A metric tree over the rows of ``points``: row k of each array is a ball over points ``begin[k]`` to ``end[k]``.

    A ball has a centre, a radius that no point of it lies beyond, its points' count (end - begin), the
    integer sum of their components and that of their squares. ``child`` is the first of its two balls,
    which follow each other, or -1 for a leaf. Balls are cut at the median of their widest component; equal
    points stay one leaf. Whole numbers wrap at 64 bits, so what fits a long in the end is right.
    """

    ARRAYS = {"begin": "<i4", "end": "<i4", "child": "<i4", "radius": "<f8", "centre": "<f8", "sum": "<i8", "square": "<i8"}

    def __init__(self, points: np.ndarray, **arrays: np.ndarray):
        self.points = points
        self.begin, self.end, self.child, self.radius, self.centre, self.sum, self.square = (arrays[k] for k in self.ARRAYS)

    @property
    def count(self) -> np.ndarray:
        return (self.end - self.begin).astype(np.int64)

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
        """The tree and the order in which it has the points."""
        order, spans, child = np.arange(len(points)), [(0, len(points))], []
        for k in range(2 * len(points)):
            if k == len(spans):
                break
            low, high = spans[k]
            own = points[order[low:high]]
            width = own.max(0).astype(np.int64) - own.min(0)
            if high - low <= leaf or not width.any():
                child.append(-1)
                continue
            half = (high - low) // 2
            order[low:high] = order[low:high][np.argpartition(own[:, width.argmax()], half)]
            child.append(len(spans))
            spans += [(low, low + half), (low + half, high)]
        placed = points[order]
        bounds = np.array(spans, np.int32).reshape(-1, 2)
        sums = np.array([placed[low:high].sum(0) for low, high in spans], np.int64).reshape(len(spans), points.shape[1])
        squares = (placed * placed).sum(1)
        centre = sums / (bounds[:, 1] - bounds[:, 0])[:, None]
        radius = np.array([np.sqrt(((placed[low:high] - c) ** 2).sum(1).max()) for (low, high), c in zip(spans, centre, strict=True)])
        arrays = {"begin": bounds[:, 0], "end": bounds[:, 1], "child": np.array(child, np.int32), "radius": radius, "centre": centre, "sum": sums}
        arrays["square"] = np.array([squares[low:high].sum() for low, high in spans], np.int64)
        return cls(placed, **arrays), order

    def write(self) -> dict[str, bytes]:
        kind = next(t for t in ("<i1", "<i2", "<i4") if not len(self.points) or (np.iinfo(t).min <= self.points.min() and self.points.max() <= np.iinfo(t).max))
        return {"points": self.points.astype(kind).tobytes(), "kind": kind.encode()} | {k: getattr(self, k).astype(t).tobytes() for k, t in self.ARRAYS.items()}

    @classmethod
    def read(cls, row: dict, dim: int) -> Tree:
        arrays = {k: np.frombuffer(row[k], t) for k, t in cls.ARRAYS.items()}
        for k in ("centre", "sum"):
            arrays[k] = arrays[k].reshape(-1, dim)
        return cls(np.frombuffer(row["points"], row["kind"].decode()).reshape(-1, dim), **arrays)

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Balls that go to one centroid as a whole, those centroids, and the leaves that are left for an exact look.

        By the triangle inequality each point of a ball is at most d + radius and at least d - radius from a
        centroid that is d from the centre. A ball goes to a centroid if all others lie further for certain:
        by more than rounding can blur; ties are therefore never decided here.
        """
        whole, owner, leaves = [], [], []
        level = np.arange(min(1, len(self.begin)))
        while len(level):
            far = np.stack([np.sqrt(((self.centre[level] - c) ** 2).sum(1)) for c in centroids], 1)
            slack = self.radius[level] + 1e-7 * (1 + far.max(1) + self.radius[level])
            best = far.argmin(1)
            rivals = (far <= (far.min(1) + 2 * slack)[:, None]).sum(1)
            sure = rivals == 1
            whole.append(level[sure])
            owner.append(best[sure])
            left = level[~sure]
            child = self.child[left]
            leaves.append(left[child < 0])
            child = child[child >= 0]
            level = np.concatenate([child, child + 1])
        return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (whole, owner, leaves))


def exact_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances in whole numbers; by floating products where these are exact."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if most * most * points.shape[1] < 1 << 51:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)[None]).astype(np.int64)
    return np.stack([((points.astype(np.int64) - c) ** 2).sum(1) for c in centroids], 1)


def _grow(batches: Iterator[pa.RecordBatch], dim: int, scale: int, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = pc.list_value_length(batch.column("vector")).fill_null(-1).to_numpy()
        batch = batch.filter(pa.array(lengths == dim))
        values = batch.column("vector").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)  # null is NaN
        whole = np.floor(scale * np.where(np.isfinite(values), values, np.inf))
        sound = (np.abs(whole) <= LARGEST).all(1)
        ids, points = batch.column("id").filter(pa.array(sound)), whole[sound].astype(np.int64)
        for at in range(0, len(ids), size):
            tree, order = Tree.build(points[at : at + size])
            row = tree.write()
            own = ids.slice(at, size).take(pa.array(order))
            lists = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            yield pa.RecordBatch.from_arrays([lists, *[pa.array([v], pa.binary()) for v in row.values()]], ["ids", *row])


def _trees(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.column("ids")[k].values, Tree.read({c: batch.column(c)[k].as_py() for c in ("points", "kind", *Tree.ARRAYS)}, dim)


def _digest(seed: int, key: object) -> str:
    return hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()


def _first(batches: Iterator[pa.RecordBatch], dim: int, k: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Of each tree the k vectors with the smallest digests."""
    for ids, tree in _trees(batches, dim):
        ranked = sorted((_digest(seed, key), tree.points[at].tolist()) for at, key in enumerate(ids.to_pylist()))[:k]
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in ranked]), pa.array([v for _, v in ranked], pa.list_(pa.int64()))], ["digest", "vector"])


def _clusters(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Balls that go whole, their centroids, the other points' places and their centroids, ties to the smaller number."""
    whole, owner, leaves = tree.assign(centroids)
    at = np.concatenate([np.arange(tree.begin[x], tree.end[x]) for x in leaves]) if len(leaves) else np.empty(0, np.int64)
    return whole, owner, at, exact_distances(tree.points[at], centroids).argmin(1)


#: Before the sums of a centroid's components: its vectors, their inertia, balls taken whole, vectors looked at one by one.
TALLIES = ("n", "inertia", "balls", "looked")


def _tally(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What each centroid gets of a task's trees; a ball's share comes from its sums, without its vectors."""
    k, dim = centroids.shape
    tally, fixed = np.zeros((k, len(TALLIES) + dim), np.int64), (centroids * centroids).sum(1)
    for _, tree in _trees(batches, dim):
        whole, owner, at, best = _clusters(tree, centroids)
        inertia = tree.square[whole] - 2 * (tree.sum[whole] * centroids[owner]).sum(1) + tree.count[whole] * fixed[owner]
        one = np.ones(len(whole), np.int64)
        np.add.at(tally, owner, np.column_stack([tree.count[whole], inertia, one, 0 * one, tree.sum[whole]]))
        points = tree.points[at].astype(np.int64)
        one = np.ones(len(at), np.int64)
        np.add.at(tally, best, np.column_stack([one, ((points - centroids[best]) ** 2).sum(1), 0 * one, one, points]))
    used = np.flatnonzero(tally[:, 0])
    sums = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * tally.shape[1], pa.int32()), pa.array(tally[used].ravel()))
    yield pa.RecordBatch.from_arrays([pa.array(used), sums], ["cluster", "sums"])


@dataclass(frozen=True)
class Fitted:
    """Trees over all vectors, the final centroids, and what the last assignment gives each: n, inertia, balls, looked."""

    trees: DataFrame
    centroids: np.ndarray
    tally: dict[str, np.ndarray]


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1) -> Fitted:
    """Centroids after ``rounds`` of assigning every vector and replacing each centroid by its vectors' floored mean.

    The trees are built where the rows lie and written once to the shared folder; each round reads them and
    gives a sum for each task and centroid, added up by centroid and component. Only k rows of sums reach
    the driver. See ``cluster`` for which vectors count.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = bound_batches(vectors).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    columns = ", ".join(f"{c} binary" for c in ("points", "kind", *Tree.ARRAYS))
    trees = materialize(rows.mapInArrow(lambda batches: _grow(batches, dim, scale, TREE), f"ids array<{kind}>, {columns}"), "ball-trees")
    first = trees.mapInArrow(lambda batches: _first(batches, dim, k, seed), "digest string, vector array<long>").orderBy("digest", "vector").limit(k).collect()
    centroids = np.array([r["vector"] for r in first], np.int64).reshape(-1, dim)
    tally = np.zeros((len(centroids), len(TALLIES) + dim), np.int64)
    for turn in range(rounds + 1 if len(centroids) else 0):
        given = trees.mapInArrow(lambda batches, c=centroids: _tally(batches, c), "cluster long, sums array<long>")
        tally = np.zeros_like(tally)
        for r in given.select("cluster", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("col").alias("total")).collect():
            tally[r["cluster"], r["pos"]] = r["total"]
        if turn < rounds:
            some = tally[:, 0] > 0
            centroids = centroids.copy()
            centroids[some] = tally[some, len(TALLIES) :] // tally[some, :1]
    return Fitted(trees, centroids, {name: tally[:, at] for at, name in enumerate(TALLIES)})


def _place(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, inertia: np.ndarray, digests: list[str]) -> Iterator[pa.RecordBatch]:
    names = pa.array(digests)
    for ids, tree in _trees(batches, centroids.shape[1]):
        whole, owner, at, best = _clusters(tree, centroids)
        cluster = np.zeros(len(ids), np.int64)
        for ball, c in zip(whole.tolist(), owner.tolist(), strict=True):
            cluster[tree.begin[ball] : tree.end[ball]] = c
        cluster[at] = best
        distance = ((tree.points.astype(np.int64) - centroids[cluster]) ** 2).sum(1)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(cluster, pa.int32()), pa.array(distance), pa.array(inertia[cluster]), pa.array(np.full(len(ids), inertia.sum())), names.take(pa.array(cluster))],
            ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
        )


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1) -> DataFrame:
    """One row per vector that counts: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    A vector counts if it has ``dim`` components, none null or non-finite, each with floor(scale * x) of
    at most ``LARGEST`` in size (beyond, distances don't fit a long); others are left out. Centroids begin
    as the k vectors with the smallest sha256 of "seed:id"; a null id reads as nothing, and of rows that
    repeat an id the one with the smallest components comes first. With fewer vectors than k there are
    fewer centroids, which may be equal: the smaller number then gets the vectors. Distances, sums and
    means are whole numbers and exact. Repeated rows count each for itself; other columns are ignored, so
    their names may clash; an empty table gives an empty result.
    """
    fitted = fit(vectors, id_col, vector_col, dim, k, rounds, scale, seed)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in fitted.centroids.tolist()]
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids, inertia = fitted.centroids, fitted.tally["inertia"]
    placed = fitted.trees.mapInArrow(lambda batches: _place(batches, centroids, inertia, digests), schema)
    return placed.withColumnRenamed("id", id_col)


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(rounds: int = 3) -> str:
    """The same by unnested components: distances of all vectors and the centroids, round by round."""
    parts = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM kept) ORDER BY h, v LIMIT 16)",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"a{r} AS MATERIALIZED (SELECT k, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT k, c, list_sum(list_transform(list_zip(kept.v, c{r}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d"
            f" FROM kept, c{r}) GROUP BY k)"
        )
        if r < rounds:
            parts.append(
                f"m{r} AS (SELECT c, list(m ORDER BY j) AS v FROM (SELECT c, j, floor(sum(x)::HUGEINT / count(*))::BIGINT AS m FROM"
                f" (SELECT a{r}.c, unnest(v) AS x, unnest(range(1, 65)) AS j FROM kept JOIN a{r} USING (k)) GROUP BY c, j) GROUP BY c)"
            )
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, a{rounds}.c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a{rounds}.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (k) JOIN c{rounds} ON c{rounds}.c = a{rounds}.c
"""


OP11_SQL = _sql()
