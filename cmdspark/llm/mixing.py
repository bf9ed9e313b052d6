"""Mixing sources to target weights: exact budgets from length counts and a bounded knapsack."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialize, words_count


def fill_targets(sources: DataFrame, budget_share: float, cap: float, weights: tuple[float, ...]) -> DataFrame:
    """Targets by weight, none over ``cap`` times its source's size; what is over goes to the others by weight.

    ``sources`` has (source, size), one row each. The fixed point has a level t with target =
    min(cap * size, t * weight): sources in order of cap * size / weight are full up to some place, and
    t follows from what is left there. One row per source: windows over it are small.
    """
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    nth = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(nth, F.lit(len(weights))) + 1).cast("int"))
    full = everything.orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(budget_share) * F.sum("size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return (
        sources.withColumn("weight", weight)
        .withColumn("limit", F.col("size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("level", level)
        # the first source whose limit isn't reached fixes the level of all that follow it
        .withColumn("t", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
        .withColumn("target", F.when(F.col("t").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("t") * F.col("weight"))))
        .select("source", F.col("size").alias("source_size"), "weight", "target")
    )


#: Words up to which the knapsack has a table of all sums; beyond, it keeps the sums that can be reached.
REACH = 1 << 17
#: Sums that are kept at most. With more, one of each of as many equal ranges stays, and the result is off by a range for each lot at most.
SUMS = 1 << 20
#: A miss of so small a share of the budget is none.
NEAR = 1e-6


def proportional(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that every length gets its share of ``budget``, longest first, what rounding leaves carried on."""
    total = sum(int(n) * int(c) for n, c in zip(lengths, counts, strict=True))
    taken = np.zeros(len(lengths), dtype=np.int64)
    seen = got = 0
    for i in np.argsort(-lengths, kind="stable"):
        length, count = int(lengths[i]), int(counts[i])
        if length:
            seen += length * count
            taken[i] = min(count, (seen * budget // total - got) // length)
            got += int(taken[i]) * length
    return taken


def _lots(lengths: np.ndarray, free: np.ndarray, rest: int) -> list[tuple[int, int]]:
    """(place, documents) of each lot: the free documents of a length in lots of 1, 2, 4, ... and what is left."""
    lots = []
    for i in np.argsort(lengths, kind="stable"):
        length = int(lengths[i])
        left, lot = (min(int(free[i]), rest // length) if 0 < length <= rest else 0), 1
        while left > 0:
            lots.append((int(i), min(lot, left)))
            left, lot = left - lot, 2 * lot
    return lots


def knapsack(lengths: np.ndarray, free: np.ndarray, rest: int, over: int = 0) -> np.ndarray:
    """How many of the ``free`` documents of each length to add so that their words come as near ``rest`` as can be, at most ``over`` beyond it.

    Bounded knapsack by reachable sums, lot by lot. Up to REACH words these are marks in a table, so work
    grows with lengths x log(documents) x rest. Beyond, where documents are long and sums few, they are a
    sorted list, whatever ``rest`` is; only with over SUMS of them it is thinned.
    """
    lots = _lots(lengths, free, rest + over)
    chosen = (_by_table if rest + over <= REACH else _by_list)(lots, lengths, rest, over)
    added = np.zeros(len(lengths), dtype=np.int64)
    for k in chosen:
        added[lots[k][0]] += lots[k][1]
    return added


def _by_table(lots: list[tuple[int, int]], lengths: np.ndarray, rest: int, over: int) -> list[int]:
    reach = np.zeros(rest + over + 1, dtype=bool)
    reach[0] = True
    last = np.full(rest + over + 1, -1, dtype=np.int64)  # the lot last added on the way to a sum
    for k, (i, lot) in enumerate(lots):
        if reach[rest]:
            break
        words = lot * int(lengths[i])
        new = np.zeros_like(reach)
        new[words:] = reach[:-words]
        new &= ~reach
        last[new] = k
        reach |= new
    sums, chosen = np.flatnonzero(reach), []
    at = int(sums[np.abs(sums - rest).argmin()])
    while at:
        chosen.append(int(last[at]))
        i, lot = lots[chosen[-1]]
        at -= lot * int(lengths[i])
    return chosen


def _by_list(lots: list[tuple[int, int]], lengths: np.ndarray, rest: int, over: int) -> list[int]:
    sums, added = np.zeros(1, dtype=np.int64), []  # of each lot the sums that it first reaches
    for i, lot in lots:
        if sums[min(np.searchsorted(sums, rest), len(sums) - 1)] == rest:
            break
        new = sums + lot * int(lengths[i])
        new = np.setdiff1d(new[new <= rest + over], sums, assume_unique=True)
        added.append(new)
        sums = np.sort(np.concatenate([sums, new]))
        if len(sums) > SUMS:
            kept = np.unique(sums // -(-(rest + over + 1) // SUMS), return_index=True)[1]
            sums = np.union1d(sums[kept], sums[-1:])
    at, chosen = int(sums[np.abs(sums - rest).argmin()]), []
    for k in range(len(added) - 1, -1, -1):
        place = int(np.searchsorted(added[k], at))
        if at and place < len(added[k]) and added[k][place] == at:
            chosen.append(k)
            at -= lots[k][1] * int(lengths[lots[k][0]])
    return chosen


def choose_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that the words taken come as near ``budget`` as can be.

    Every length gets its proportional share, and a bounded knapsack over the documents left fills what
    rounding leaves of the budget. Where no documents sum up to that remainder, the share is laid out anew
    with more of the budget held back for the knapsack, twice as much each time, until what is missing is
    less than the lengths' common divisor or NEAR of the budget, or the knapsack has the whole budget. It may
    then go over the budget by less than what was missing. No choice comes nearer, as long as the knapsack's
    sums are under SUMS.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), dtype=np.int64)
    if budget >= total:
        return counts.copy()
    step = int(np.gcd.reduce(lengths[(lengths > 0) & (counts > 0)]))
    held, best, least = 0, None, 0
    while True:
        taken = proportional(lengths, counts, budget - held)
        taken = taken + knapsack(lengths, counts - taken, budget - int((taken * lengths).sum()))
        short = budget - int((taken * lengths).sum())
        if best is None or short < least:
            best, least = taken, short
        if least <= max(budget % step, int(NEAR * budget)) or held == budget:
            break
        held = min(budget, max(2 * held, 2 * int(lengths[lengths > 0].min())))
    if least > int(NEAR * budget) and 2 * least > step:
        best = knapsack(lengths, counts, budget, least - 1)
    return best


def mix(
    docs: DataFrame,
    size: Column,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    budget_share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
    buckets: int = 1024,
    row_col: str | None = None,
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies, rid.

    Each source gets floor(target / source_size) whole rounds of all its documents; the rest of its
    target is a budget that ``choose_counts`` meets from the source's count of documents by length,
    and documents of a length are drawn in the order of a seeded hash. ``buckets`` ranges of that hash
    are counted first, so that ranking is needed in one of them only and no length is sorted whole.

    Null text has size 0, null sources form the last source, null ids draw each by its row. Sizes of 0 take
    part (copies may be 0 or more) and cost nothing. Ties between repeated rows are settled by row;
    which of identical rows is drawn doesn't matter. ``rid`` is a row's number: ``row_col``, unique numbers
    stored with the rows, else one made here. An empty table gives an empty result; names of
    other columns are never looked at.
    """
    # rows without an id can't be told apart by what is returned, so any of them may be drawn, and they needn't lie in one bucket
    order = F.when(F.col("id").isNull(), F.xxhash64(F.lit(seed), F.col("rid"))).otherwise(F.xxhash64(F.lit(seed), F.col("id")))
    number = F.col(row_col) if row_col else F.monotonically_increasing_id()
    table = materialize(
        bound_batches(docs).select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.cast("long").alias("size"), number.alias("rid"))
        .withColumn("draw", order)
        .withColumn("bucket", F.pmod(F.shiftright("draw", 8), F.lit(buckets)).cast("int")),
        "mix-sizes",
    )
    by_bucket = materialize(table.groupBy("source", "size", "bucket").count(), "mix-counts")
    sizes = by_bucket.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("size"))
    targets = materialize(fill_targets(sizes, budget_share, cap, weights), "mix-targets")
    # a null source must meet itself: joins go by a key that is never null
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    targets = targets.withColumn("skey", key).drop("source", "weight").withColumn(
        "rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    )
    lengths = by_bucket.groupBy("source", "size").agg(F.sum("count").alias("count")).withColumn("skey", key).drop("source")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        left = float(pdf["target"].iloc[0]) - int(pdf["rounds"].iloc[0]) * int(pdf["source_size"].iloc[0])
        extra = choose_counts(pdf["size"].to_numpy(np.int64), pdf["count"].to_numpy(np.int64), int(round(left)))
        return pd.DataFrame({"skey": pdf["skey"], "size": pdf["size"], "extra": extra})

    chosen = lengths.join(targets, "skey").groupBy("skey").applyInPandas(plan, "skey string, size long, extra long")
    quotas = materialize(
        by_bucket.withColumn("skey", key)
        .drop("source")
        .join(chosen, ["skey", "size"])
        .withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("skey", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("skey", "size", "bucket", F.greatest(F.lit(0), F.least(F.col("count"), F.col("extra") - F.col("before"))).alias("quota"), "count"),
        "mix-quotas",
    )
    placed = table.withColumn("skey", key).join(quotas, ["skey", "size", "bucket"])
    whole = placed.filter("quota = 0 or quota = count").withColumn("more", (F.col("quota") > 0).cast("int"))
    within = Window.partitionBy("skey", "size", "bucket").orderBy("draw", "id", "rid")
    split = placed.filter("quota > 0 and quota < count").withColumn("more", (F.row_number().over(within) <= F.col("quota")).cast("int"))
    return (
        whole.unionByName(split)
        .join(targets, "skey")
        .select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("rounds") + F.col("more")).alias("copies"), "rid")
    )


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix(docs, words_count(F.col("text")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
