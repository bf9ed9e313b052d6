import pandas as pd
import pytest
from pyspark.sql import functions as F

from cmdspark.operators import advice
from cmdspark.streaming.advisor import KEY, SessionReplay, advise_stream, replay_stream

LOG = [
    ("s", 1, "run_atpg", "run_atpg", True), ("s", 2, "read_netlist", "read_netlist a.SPF", True), ("s", 3, "add_clocks", "add_clocks 0 c", True), ("s", 4, "remove_clocks", "remove_clocks -all", False),
    ("s", 5, "report_clocks", "report_clocks", True), ("s", 6, "remove_clocks", "remove_clocks c", True), ("s", 7, "remove_clocks", "remove_clocks c", True), ("t", 1, "run_drc", "run_drc", True), ("t", 2, "run_atpg", "run_atpg", True),
]
PROB = [("read_netlist", "run_drc", 0.8), ("read_netlist", "add_clocks", 0.2), ("add_clocks", "run_drc", 1.0), ("run_drc", "add_faults", 0.6), ("run_drc", "x", 0.3), ("run_drc", "a", 0.05), ("run_drc", "b", 0.05)]
SCHEMA = "session_id string, seq long, command string, cmd_line string, valid boolean, exists boolean"


@pytest.fixture
def log(spark):
    return spark.createDataFrame([(*r, True) for r in LOG], SCHEMA)


@pytest.fixture
def prob(spark):
    return spark.createDataFrame(PROB, "`from` string, `to` string, prob double")


def test_state_before(log):
    rows = {(r["session_id"], r["seq"]): r for r in advice.replay(log).collect()}
    assert not rows["s", 2]["netlist_loaded"]
    assert rows["s", 3]["netlist_loaded"]
    assert rows["s", 3]["spf_loaded"]
    assert rows["s", 5]["clocks_defined"]  # the invalid removal changed nothing
    assert not rows["s", 7]["clocks_defined"]
    assert rows["s", 5]["prev"] == "add_clocks"
    assert rows["t", 1]["prev"] is None


def test_advice(log, prob):
    rows = {(r["session_id"], r["seq"]): r for r in advice.advise(log, prob).collect()}
    assert len(rows["s", 1]["warnings"]) == 3
    assert rows["s", 3]["warnings"] == ["'add_clocks' after 'read_netlist' is rare in typical flows (20%)"]
    assert rows["t", 2]["suggestions"] == ["'run_atpg' is uncommon after 'run_drc'. Common next: add_faults, x, a"]


def test_final_state(log):
    rows = {r["session_id"]: r for r in advice.final_state(log).collect()}
    assert rows["s"]["netlist_loaded"]
    assert not rows["s"]["clocks_defined"]
    assert rows["t"]["prev"] == "run_atpg"


def test_probabilities_sum_to_one(spark):
    counts = spark.createDataFrame([("a", "b", 3), ("a", "c", 1), ("b", "a", 2)], "`from` string, `to` string, count long")
    sums = advice.transition_probability(counts).groupBy("from").agg(F.sum("prob").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in sums)


def test_stream_gives_the_advice_of_the_batch(spark, log, prob, tmp_path):
    """A9 = A8, over two runs on one checkpoint that both hold rows of one session."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ("seq <= 4", "seq > 4"):
        log.filter(part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(log.schema).parquet(source)
        query = advise_stream(stream, prob, idle_minutes=None).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        try:
            assert query.awaitTermination(120)
        finally:
            query.stop()
    got = sorted((r["session_id"], r["seq"], r["warnings"], r["suggestions"]) for r in spark.read.parquet(out).collect())
    want = sorted((r["session_id"], r["seq"], r["warnings"], r["suggestions"]) for r in advice.advise(log, prob).collect())
    assert got == want


def run_stream(spark, stream, folder, name):
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/{name}-cp").trigger(availableNow=True).start(f"{folder}/{name}")
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    return sorted((r["session_id"], r["seq"], r["warnings"], r["suggestions"]) for r in spark.read.parquet(f"{folder}/{name}").collect())


def test_stream_goes_on_from_a_state(spark, log, prob, tmp_path):
    """A session of which the first commands were replayed elsewhere, and one that begins with the stream."""
    rest = log.filter("seq > 4 or session_id <> 's'")
    rest.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in")
    state = advice.final_state(log.filter("seq <= 4 and session_id = 's'"))
    got = run_stream(spark, advise_stream(stream, prob, idle_minutes=None, initial=state), tmp_path, "out")
    want = sorted((r["session_id"], r["seq"], r["warnings"], r["suggestions"]) for r in advice.advise(log, prob).filter("seq > 4 or session_id <> 's'").collect())
    assert got == want


def test_stream_replays_nulls_and_clearing_like_the_batch(spark, tmp_path):
    rules = advice.StateRules(flags=("a", "b"), sets={"a": ("x", "z")}, clears={"a": ("y", "z")}, line_sets=(("b", ("x", "y"), "on"),))
    rows = [("s", 1, "x", "x ON", True), ("s", 2, None, None, True), ("s", 3, "y", None, None), ("s", 4, "z", "z", True), ("s", 5, "x", "x", True), ("s", 6, "y", "y", True), ("s", 7, "w", "w", False), (None, 1, "x", "x", True), (None, 2, "y", "on", True)]
    log = spark.createDataFrame(rows, "session_id string, seq long, command string, cmd_line string, valid boolean")
    log.write.parquet(f"{tmp_path}/in")
    stream = replay_stream(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in"), rules, idle_minutes=None)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
    assert query.awaitTermination(120)
    columns = ["session_id", "seq", "a", "b", "prev"]
    assert sorted(spark.read.parquet(f"{tmp_path}/out").select(*columns).collect(), key=repr) == sorted(advice.replay(log, rules).select(*columns).collect(), key=repr)


def many_sessions(spark):
    """Sessions that end at different places, one of them without a name."""
    command, n = F.element_at(F.array(*map(F.lit, ("read_netlist", "run_drc", "add_clocks", "remove_clocks", "run_atpg", "x", None))), (F.xxhash64("id") % 4 + 4).cast("int")), F.col("id") % 97
    return spark.range(1500).select(
        F.when(n > 0, n).alias("session_id"), (F.col("id") * 7 % 1500).alias("seq"), command.alias("command"), F.lit("-f a.SPF").alias("cmd_line"), (F.col("id") % 5 > 0).alias("valid"), F.lit(True).alias("exists")
    )


def test_stream_with_many_sessions_in_a_bucket(spark, prob, tmp_path):
    """Some sessions have a state at the start, all have rows in two runs on one checkpoint."""
    log = many_sessions(spark)
    early = log.filter("seq < 400 and (session_id % 3 = 0 or session_id is null)")
    later = log.filter("seq >= 400 or session_id % 3 > 0")
    state = advice.final_state(early)
    for part in ("seq < 900", "seq >= 900"):
        later.filter(part).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in")
        told = advise_stream(stream, prob, idle_minutes=None, initial=state, buckets=3)
        query = told.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
        assert query.awaitTermination(120)
    want = [r for r in advice.advise(log, prob).collect() if not (r["seq"] < 400 and (r["session_id"] is None or r["session_id"] % 3 == 0))]
    columns = ["session_id", "seq", "warnings", "suggestions"]
    got = spark.read.parquet(f"{tmp_path}/out").select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((tuple(r[c] for c in columns) for r in want), key=repr)


def test_one_call_takes_all_sessions_of_a_bucket():
    """A call of the processor has a cost of its own, so its number may not be that of the sessions."""
    held, rules = {}, advice.StateRules(flags=("a",), sets={"a": ("x",)}, clears={"a": ("y",)})

    class Sessions:
        containsKey, getValue, updateValue = held.__contains__, held.__getitem__, held.__setitem__  # noqa: N815

    replay = SessionReplay(rules, ["session_id", "seq", "command", "valid"], None)
    replay.sessions = Sessions()
    rows = [(s, seq, "xyz"[(s + seq) % 3], (s * seq) % 4 > 0) for seq in (2, 1, 3) for s in range(30_000)]
    bucket = pd.DataFrame([(*r, f"k{r[0]}", {"x": "1", "y": "0"}.get(r[2], "-") if r[3] else "-") for r in rows], columns=["session_id", "seq", "command", "valid", KEY, "stream_effects"])
    told = pd.concat(replay.handleInputRows((0,), iter([bucket[:50_000], bucket[50_000:]]), None))
    want, state = [], {}
    for s, seq, command, valid in sorted(rows):
        a, prev = state.get(s, (False, None))
        want.append((s, seq, a, prev))
        if valid:
            state[s] = ({"x": True, "y": False}.get(command, a), command)
    assert sorted(told[["session_id", "seq", "a", "prev"]].itertuples(index=False, name=None)) == want
    assert held == {(f"k{s}",): v for s, v in state.items() if v != (False, None)}
