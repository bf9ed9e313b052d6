"""Values from a row's neighbours in its ordered session, where one session may be most of the table.

A session of common size is a window. A long one is cut into chunks by ranges of its order, so its rows
lie in many tasks: windows run within chunks, each chunk is summed up in one row (the last value of each
kind, its sums, its first rows), a window over these rows tells each chunk what comes before and after it,
and the chunk's rows are completed with that. Results are those of the window, whatever is cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cmdspark.functions.storage import materialize

#: Rows of a session that one task may take, and of a chunk of a longer one.
SPLIT_OVER = 100_000
#: Long sessions at most; with more of them only those with a greater share of the rows are cut, so that their names stay small enough to be broadcast.
MOST_LONG = 100_000
#: Chunks at most, while they have no more than SPLIT_OVER rows: each is a task and a file of its own.
MOST_CHUNKS = 1000

_OWN = "__scan_"
CHUNK = _OWN + "#chunk"


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def long_sessions(rows: DataFrame, session: list[str], split_over: int) -> tuple[DataFrame, int, int]:
    """Sessions of more than ``split_over`` rows, the rows that they have in all, and the rows that a chunk should have."""
    counts = materialize(rows.groupBy(*session).agg(F.count(F.lit(1)).alias(_OWN + "#n")).filter(F.col(_OWN + "#n") > split_over), "long-sessions")
    total = counts.agg(F.sum(_OWN + "#n")).first()[0] or 0
    size = max(split_over, total // MOST_LONG, min(SPLIT_OVER, total // MOST_CHUNKS))
    return counts.filter(F.col(_OWN + "#n") > size).select(*session), total, size


def chunks(rows: DataFrame, session: list[str], order: list[str], total: int, size: int) -> DataFrame:
    """``rows`` with the number of their chunk; chunks follow each other by session and order. Written once, so that all readers see the same cuts."""
    count = max(2, -(-total // size))
    return materialize(rows.repartitionByRange(count, *session, *order).withColumn(CHUNK, F.spark_partition_id()), "session-chunks")


def ordered(
    rows: DataFrame,
    session: list[str],
    order: list[str],
    last: dict[str, Column] | None = None,
    following: dict[str, tuple[Column, int]] | None = None,
    running: dict[str, Column] | None = None,
    split_over: int | None = SPLIT_OVER,
) -> DataFrame:
    """``rows`` with values from their session (columns ``session``), ordered by ``order``, which must be total in it.

    ``last``: the last value that isn't null in the rows before; ``following``: the value so many rows
    further on; ``running``: the sum up to and with the row. ``split_over`` None means that no session is
    long, for sessions that come from one row each, such as the blocks of a text; else ``rows`` are counted by session
    first, so they should be a table or cheap to make.
    """
    last, following, running = last or {}, following or {}, running or {}
    if split_over is None:
        return _windowed(rows, session, order, last, following, running)
    long, total, size = long_sessions(rows, session, split_over)
    if long.isEmpty():
        return _windowed(rows, session, order, last, following, running)
    names = F.broadcast(long)
    cut = chunks(rows.join(names, _same(rows, names, session), "left_semi"), session, order, total, size)
    rest = rows.join(names, _same(rows, names, session), "left_anti")
    return _windowed(rest, session, order, last, following, running).unionByName(_stitched(cut, session, order, last, following, running))


def _windowed(rows: DataFrame, session: list[str], order: list[str], last: dict, following: dict, running: dict) -> DataFrame:
    w = Window.partitionBy(*session).orderBy(*order)
    return rows.withColumns(
        {name: F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for name, value in last.items()}
        | {name: F.lead(value, by).over(w) for name, (value, by) in following.items()}
        | {name: F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) for name, value in running.items()}
    )


def _stitched(cut: DataFrame, session: list[str], order: list[str], last: dict, following: dict, running: dict) -> DataFrame:
    part = [*session, CHUNK]
    reach = max([by for _, by in following.values()], default=0)
    w = Window.partitionBy(*part).orderBy(*order)
    # whole structures, so that a value that is null differs from a row that isn't there
    value = F.struct(*[v.alias(name) for name, (v, _) in following.items()]) if following else F.struct(F.lit(1))
    ahead = {f"{_OWN}#ahead_{k}": F.lead(value, k).over(w) if k else value for k in range(reach + 1)}
    own = _windowed(cut, part, order, last, {}, running).withColumns(ahead)

    place = F.struct(*order)
    lasts = cut.select(*part, place.alias(_OWN + "#order"), *[v.alias(_OWN + name) for name, v in last.items()], *[v.alias(_OWN + name) for name, v in running.items()])
    summary = lasts.groupBy(*part).agg(
        F.count(F.lit(1)).alias(_OWN + "#n"),
        *[F.max_by(_OWN + name, F.when(F.col(_OWN + name).isNotNull(), F.col(_OWN + "#order"))).alias(_OWN + name) for name in last],
        *[F.sum(_OWN + name).alias(_OWN + name) for name in running],
    )
    if reach:
        firsts = F.min_by(F.array_compact(F.array(*list(ahead)[:-1])), place).alias(_OWN + "#firsts")
        heads = own.groupBy(*part).agg(firsts)
        summary = summary.join(heads.select(*[F.col(k).alias(_OWN + "#" + k) for k in part], _OWN + "#firsts"), reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(_OWN + "#" + k)) for k in part])).drop(*[_OWN + "#" + k for k in part])
    by_chunk = Window.partitionBy(*session).orderBy(CHUNK)
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    none = F.array().cast(summary.schema[_OWN + "#firsts"].dataType) if reach else None
    carried = summary.select(
        *[F.col(k).alias(_OWN + "#of_" + k) for k in part],
        *[F.last(_OWN + name, ignorenulls=True).over(before).alias(_OWN + name) for name in last],
        *[F.sum(_OWN + name).over(before).alias(_OWN + name) for name in running],
        *([F.flatten(F.array(*[F.coalesce(F.lead(_OWN + "#firsts", k).over(by_chunk), none) for k in range(1, reach + 1)])).alias(_OWN + "#next")] if reach else []),
    )
    joined = own.join(carried, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(_OWN + "#of_" + k)) for k in part]))
    if reach:
        left = F.size(F.array_compact(F.array(*list(ahead)[1:])))  # rows of the chunk that follow, as far as they matter
    done = {name: F.coalesce(F.col(name), F.col(_OWN + name)) for name in last}
    done |= {name: F.coalesce(F.col(name) + F.coalesce(F.col(_OWN + name), F.lit(0)), F.col(_OWN + name)) for name in running}
    done |= {name: F.coalesce(F.col(f"{_OWN}#ahead_{by}"), F.get(_OWN + "#next", by - 1 - left))[name] for name, (_, by) in following.items()}
    out = joined.withColumns(done)
    return out.select(*[c for c in out.columns if not c.startswith(_OWN)])
