import random

from pyspark.sql import functions as F

from cmdspark.functions.bloom import bloom_filter, might_contain
from cmdspark.operators import mining

COMMANDS = ["read_netlist", "run_drc", "add_faults", "run_atpg", "report_faults", "set_patterns"]
SCRIPT = """TEST-T> read_netlist a.v -lib
// a comment, dropped
add_faults -all \\
  -verbose
module foo

tiny

run_drc x.spf
report_faults -summary
run_atpg -auto -verbose
   Set_Patterns ext
then please now run_atpg too late"""


def frame(spark, text):
    return spark.createDataFrame([("s", text)], "script_id string, text string")


def test_blocks_and_sequences(spark):
    blocks = mining.blocks(frame(spark, SCRIPT)).collect()
    assert [b["block_no"] for b in blocks] == [0, 2]  # the short block goes, numbers stay
    seq = mining.mine(frame(spark, SCRIPT), COMMANDS).orderBy("block_no", "pos").collect()
    assert [(r["block_no"], r["pos"], r["command"]) for r in seq] == [(0, 0, "read_netlist"), (0, 1, "add_faults"), (2, 0, "run_drc"), (2, 1, "report_faults"), (2, 2, "run_atpg"), (2, 3, "set_patterns")]


def test_catalogue_table_matches_like_a_list(spark):
    lines = mining.clean_lines(mining.logical_lines(mining.blocks(frame(spark, SCRIPT))))
    table = spark.createDataFrame([(c,) for c in COMMANDS], "command string")
    a = mining.match_commands(lines, COMMANDS).select("line_no", "command").collect()
    b = mining.match_commands(lines, table).select("line_no", "command").collect()
    assert sorted(a) == sorted(b)


def test_catalogue_table_keeps_repeated_rows(spark):
    lines = spark.createDataFrame([("s", "run_drc a"), ("s", "run_drc a"), ("s", "x Run_ATPG run_drc"), ("s", "a b c run_drc"), ("s", "none")], "script_id string, line string")
    table = spark.createDataFrame([(c,) for c in [*COMMANDS, *COMMANDS]], "command string")
    for commands in (COMMANDS, table):
        got = sorted((r["line"], r["command"]) for r in mining.match_commands(lines, commands).collect())
        assert got == [("run_drc a", "run_drc"), ("run_drc a", "run_drc"), ("x Run_ATPG run_drc", "run_atpg")]


def test_continued_line_keeps_its_flags(spark):
    lines = mining.match_commands(mining.clean_lines(mining.logical_lines(mining.blocks(frame(spark, SCRIPT)))), COMMANDS)
    used = {(r["command"], r["flag"]) for r in mining.flag_usage(lines).collect()}
    assert {("add_faults", "all"), ("add_faults", "verbose"), ("read_netlist", "lib")} <= used


def test_noise_breaks_a_chain(spark):
    seq = mining.mine(frame(spark, SCRIPT), COMMANDS)
    got = {(r["from"], r["to"]) for r in mining.transitions(seq, ["script_id", "block_no"], ["pos"]).collect()}
    assert got == {("read_netlist", "add_faults"), ("run_atpg", "set_patterns")}


def test_trigram_ties_by_first_place(spark):
    rows = [("x", i, c) for i, c in enumerate("abcabc")] + [("y", i, c) for i, c in enumerate("zyx")]
    seq = spark.createDataFrame(rows, "session string, pos int, command string")
    top = mining.trigrams(seq, ["session"], ["pos"], k=3).collect()
    assert [("".join(r["sequence"]), r["count"]) for r in top] == [("abc", 2), ("bca", 1), ("cab", 1)]


def test_lines_form_has_the_same_blocks(spark):
    rows = [("s", i, x) for i, x in enumerate(SCRIPT.split("\n"))]
    lines = spark.createDataFrame(rows, "script_id string, line_no int, line string")
    got = mining.blocks_of_lines(lines).groupBy("block_no").count().orderBy("block_no").collect()
    assert [r["count"] for r in got] == [5, 5]


def test_empty_input(spark):
    none = frame(spark, SCRIPT).filter(F.lit(False))
    seq = mining.mine(none, COMMANDS)
    assert seq.count() == 0
    stats = mining.corpus_stats(seq, ["script_id", "block_no"]).first()
    assert (stats["scripts_parsed"], stats["total_commands"], stats["avg_script_length"]) == (0, 0, 0.0)


def test_a_large_catalogue_matches_like_a_list(spark):
    names = [f"cmd_{k}" for k in range(3000)]
    rng = random.Random(4)
    pick = lambda: rng.choice([f"cmd_{rng.randrange(3000)}", "Cmd_7", f"word{rng.randrange(9000)}", "the"])
    rows = [("s", i, " ".join(pick() for _ in range(rng.randint(1, 5)))) for i in range(2000)] + [("s", -1, ""), ("s", -2, None), ("s", 5, "cmd_1 cmd_2 cmd_3")]
    lines = spark.createDataFrame(rows, "script_id string, line_no int, line string").repartition(3)
    table = spark.createDataFrame([(c,) for c in [*names, names[0], None]], "command string")
    a, b = (sorted(mining.match_commands(lines, x).collect(), key=repr) for x in (names, table))
    assert a == b
    assert len(a) > 1000
    assert mining.match_commands(lines, table.limit(0)).count() == 0


def test_filter_lets_members_and_few_strangers_pass(spark):
    values = spark.range(5000).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    bits, size = bloom_filter(values.filter("v < 'v5'"), "v")
    passed = {r["v"] for r in values.crossJoin(bits).filter(might_contain(F.col("bits"), F.col("v"), size)).select("v").collect()}
    members = {f"v{k}" for k in range(5000) if f"v{k}" < "v5"}
    assert members <= passed
    assert len(passed - members) < 0.03 * (5000 - len(members)) + 5
