"""A Bloom filter of a column's values, made by an aggregation and asked by a built-in expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each value and hashes of it: about one stranger in a hundred passes. At most so many bits; beyond, more strangers pass, never fewer members.
BITS_EACH, HASHES, MOST_BITS = 10, 4, 1 << 27


def _place(value: Column, turn: int, size: int) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(turn)), F.lit(size))


def bloom_filter(values: DataFrame, column: str) -> tuple[DataFrame, int]:
    """One row with ``bits``, an array of longs, and the number of bits; of a megabyte for each 800,000 values, 16 at most."""
    count = values.count()
    size = 1 << max(10, min(MOST_BITS, BITS_EACH * count).bit_length())
    size = min(size, MOST_BITS)
    places = F.explode(F.array(*[_place(F.col(column), turn, size) for turn in range(HASHES)]))
    marked = values.filter(F.col(column).isNotNull()).select(places.alias("place"))
    words = marked.groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int"))).alias("word"))
    every = values.sparkSession.range(size // 64).select(F.col("id").alias("at")).join(words, "at", "left")
    row = every.agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("word", F.lit(0).cast("long")).alias("word")))).alias("words"))
    return row.select(F.col("words.word").alias("bits")), size


def might_contain(bits: Column, value: Column, size: int) -> Column:
    """False if a value is certainly not among the filter's, and if it is null. No lambda, so that it runs in generated code, without a copy of the bits."""
    hits = []
    for turn in range(HASHES):
        place = _place(value, turn, size)
        word = F.get(bits, F.shiftright(place, 6).cast("int"))
        hits.append(F.call_function("shiftright", word, F.pmod(place, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return value.isNotNull() & reduce(lambda a, b: a & b, hits)
