"""Values from a session's neighbours: cut sessions against plain windows."""

import random

import pytest
from pyspark.sql import functions as F

from cmdspark.functions import storage
from cmdspark.jobs import session_jobs
from cmdspark.operators import advice, mining, scan

KINDS = ("last", "following", "running")


def specs(*kinds):
    every = {
        "last": {"mark": F.col("flag"), "word": F.when(F.col("n") > 4, F.col("command"))},
        "following": {"one": (F.col("command"), 1), "two": (F.col("command"), 2), "n_on": (F.col("n"), 1)},
        "running": {"total": F.col("n"), "place": F.lit(1)},
    }
    return {k: every[k] for k in kinds or KINDS}


def rows(spark, seed, n):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        session = rng.choice(["long"] * 8 + [None, "b", "c"])
        data.append((session, rng.randrange(5), i, rng.choice(["x", "y", None]), rng.choice([True, False, None, None]), rng.choice([1, 2, 7, None])))
    rng.shuffle(data)
    return spark.createDataFrame(data, "s string, t int, i int, command string, flag boolean, n int")


def whole(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("seed", "n", "split"), [(1, 90, 3), (2, 200, 1), (3, 60, 7), (4, 12, 2)])
def test_cut_sessions_give_what_windows_give(spark, seed, n, split):
    df = rows(spark, seed, n).repartition(3)
    assert whole(scan.ordered(df, ["s"], ["t", "i"], **specs(), split_over=split)) == whole(scan.ordered(df, ["s"], ["t", "i"], **specs(), split_over=None))


@pytest.mark.parametrize("kind", KINDS)
def test_each_kind_alone(spark, kind):
    df = rows(spark, 5, 80)
    given = specs(kind)
    assert whole(scan.ordered(df, ["s"], ["t", "i"], **given, split_over=4)) == whole(scan.ordered(df, ["s"], ["t", "i"], **given, split_over=None))


def test_a_session_with_most_rows_lies_in_many_tasks(spark):
    events = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(-1)).alias("s"), "id")
    long, total, size = scan.long_sessions(events, ["s"], 500)
    assert (long.count(), total, size) == (1, 18_000, 500)
    sizes = [r["count"] for r in scan.chunks(events.filter("s = -1"), ["s"], ["id"], total, size).groupBy(scan.CHUNK).count().collect()]
    assert sum(sizes) == 18_000 and len(sizes) > 25 and max(sizes) < 4 * size


def test_chunks_of_long_sessions_stay_few(spark):
    events = spark.range(2_000_000).select(F.lit(1).alias("s"), "id")
    _, total, size = scan.long_sessions(events, ["s"], 500)
    assert (total, size) == (2_000_000, 2_000)


def test_no_rows_and_no_long_session(spark):
    df = rows(spark, 1, 20)
    assert scan.ordered(df.filter(F.lit(False)), ["s"], ["t", "i"], **specs()).count() == 0
    assert whole(scan.ordered(df, ["s"], ["t", "i"], **specs())) == whole(scan.ordered(df, ["s"], ["t", "i"], **specs(), split_over=None))


def test_operators_do_not_depend_on_the_cut(spark, sf_dir):
    log = session_jobs.long_log(spark, sf_dir)
    prob = session_jobs.model(spark, sf_dir)
    assert whole(advice.advise(log, prob, session_jobs.RULES, split_over=50)) == whole(advice.advise(log, prob, session_jobs.RULES, split_over=None))
    lines = spark.createDataFrame([("s", i, random.Random(i).choice(["", " ", "a command line", "x"])) for i in range(300)] + [(None, 1, "a line without a script")], "script_id string, line_no int, line string")
    assert whole(mining.blocks_of_lines(lines, split_over=7)) == whole(mining.blocks_of_lines(lines, split_over=None))


def test_noted_tables_are_dropped(spark):
    df = spark.range(5)
    with storage.noted_tables() as outer:
        first = storage.materialize(df, "first")
        with storage.noted_tables() as inner:
            second = storage.materialize(first, "second")
    third = storage.materialize(df, "third")
    assert len(outer) == 2 and inner == outer[1:]
    storage.drop_tables(spark, [*inner, *inner])
    assert first.count() == third.count() == 5
    with pytest.raises(Exception, match="not exist|FAILED_READ_FILE|FileNotFound"):
        second.count()
