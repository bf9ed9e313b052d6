import random
from difflib import get_close_matches

import pytest
from pyspark.sql import functions as F

from cmdspark.functions.similarity import nearest
from cmdspark.functions.syntax import syntax_rules
from cmdspark.functions.tokens import structure, tokenise
from cmdspark.operators import rules, validation
from cmdspark.operators.cleaning import clean


@pytest.mark.parametrize(
    ("line", "plain", "quoted"),
    [
        ("", [], []),
        ('a "x y" b', ["a", "x y", "b"], ["a", '"x y"', "b"]),
        ("a {b {c d} e} f", ["a", "{b {c d} e}", "f"], ["a", "{b {c d} e}", "f"]),
        ("a {b {c", ["a", "{b {c"], ["a", "{b {c"]),
        ('a\t"open', ["a", "open"], ["a", '"open']),
        ("a b{c d}", ["a", "b{c", "d}"], ["a", "b{c", "d}"]),
    ],
)
def test_tokens(line, plain, quoted):
    assert tokenise(line) == plain
    assert tokenise(line, True) == quoted


def test_structure_takes_all_following_words():
    assert structure(tokenise("c p -f a b -g -h=v w -i=")) == [("cmd", "c", []), ("positional", "p", []), ("flag_arg", "-f", ["a", "b"]), ("flag", "-g", []), ("flag_arg", "-h", ["v"]), ("positional", "w", []), ("flag_arg", "-i", [])]


def test_syntax_rules():
    r = syntax_rules("c <0 | 1> -t {a b} [-u <ns | ps>] [-v n m] [full | fast] [-x | -y [<p | q>]] -t")
    assert [(f["flag"], f["ord"], f["type"], f["n_args"]) for f in r["flags"]] == [("-t", 0, "boolean", 0), ("-u", 1, "choice", 1), ("-v", 2, "value", 2), ("-x", 3, "boolean", 0), ("-y", 4, "boolean", 0)]
    assert r["mutex"] == [["full", "fast"], ["p", "q"]]
    assert r["positionals"] == [{"position": 0, "choices": ["0", "1"]}]
    assert r["status"] == "ok"


@pytest.mark.parametrize(("syntax", "status"), [(None, "none"), ("  ", "none"), ("c [-a", "failed"), ("[-a]", "failed"), ("c -a ]", "ok")])
def test_rule_status(syntax, status):
    assert syntax_rules(syntax)["status"] == status


def test_nearest():
    assert nearest(["run_atgp", "zzz", None, "-al"], [["run_atpg", "run_drc"], ["run_atpg"], ["a"], ["-all", "-alx"]]) == ["run_atpg", None, None, "-alx"]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        (None, None), ("", ""), ("run_atpg-auto", "run_atpg -auto"), ("a \\\n  b", "a b"), ("f x{1 2}-y", "f x {1 2} -y"), ("f -n 5-auto", "f -n 5 -auto"), ("  f   -a  ", "f -a"),
    ],
)
def test_clean(spark, line, want):
    df = spark.createDataFrame([(line,)], "l string").select(clean(F.col("l"), F.array(F.lit("-auto"), F.lit("-n"))).alias("c"))
    assert df.first()["c"] == want


@pytest.mark.parametrize(
    ("value", "kind", "ok"),
    [("1_0", "int", True), (" +5 ", "int", True), ("5.0", "int", False), ("1e3", "float", True), ("inf", "float", True), (".5", "float", True), ("x", "float", False), ("Yes", "bool", True), ("2", "bool", False), ("a.v", "file", True), ("a", "file", False), ("d/x", "file", True), ("any", "string", True), ("any", "what", True)],
)
def test_types(spark, value, kind, ok):
    df = spark.createDataFrame([(value, kind)], "v string, k string")
    assert df.select(validation.has_type(F.col("v"), F.col("k")).alias("x")).first()["x"] is ok


CATALOGUE = [
    ("run_atpg", "atpg", "run_atpg [-auto] [-ndetects n] [-lbist {a b c}] [full | fast]", ["-auto", "-ndetects", "-lbist"]),
    ("set_atpg", "atpg", "set_atpg [-merge <low | medium | high>] [-abort_limit n]", ["-merge", "-abort_limit"]),
    ("bare", "x", None, []),
]
TYPES = [("run_atpg", "-ndetects", "int", 1.0, None, None, None, None), ("run_atpg", "-lbist", None, None, None, None, 3, ["int", "int", "int"]), ("run_atpg", "-absent", "int", 1.0, None, None, None, None)]


@pytest.fixture(scope="module")
def catalogue(spark):
    ruled = rules.with_rules(spark.createDataFrame(CATALOGUE, "command string, category string, syntax string, options array<string>"))
    return rules.overlay_types(ruled, spark.createDataFrame(TYPES, rules.TYPE_RULE))


LINES = {
    "run_atpg -auto": (True, []),
    "run_atpg-auto": (True, []),
    "run_atpg -ndetects": (False, ["2:needs_argument"]),
    "run_atpg -ndetects 0": (False, ["3:below_min"]),
    "run_atpg -ndetects five": (False, ["3:wrong_type"]),
    "run_atpg -ndetects 5 6": (False, ["2:argument_count"]),
    "run_atpg -lbist {1 2}": (False, ["3:block_size"]),
    "run_atpg -lbist {1 2 x}": (False, ["3:block_type"]),
    "run_atpg -lbist {}": (False, ["2:empty_block", "3:block_size"]),
    "run_atpg full fast": (False, ["2:mutually_exclusive"]),
    "run_atpg stray": (False, ["2:unexpected_positional"]),
    "run_atpg -ndetects=5": (False, ["2:equals_sign"]),
    "run_atpg -auto -auto": (True, ["1:duplicate_flag", "2:duplicate_flag"]),
    "run_atpg -bad": (False, ["1:unknown_flag"]),
    "set_atpg -merge odd": (False, ["2:not_a_choice"]),
    "set_atpg -merge high -abort_limit 5": (True, ["3:low_limit"]),
    "bare -x": (False, ["1:no_flags_accepted", "1:unknown_flag"]),
    "bare": (True, []),
    "nothing": (False, ["1:unknown_command"]),
    "": (False, ["1:empty"]),
    None: (False, ["1:empty"]),
}


def test_validate(spark, catalogue):
    log = spark.createDataFrame([(x,) for x in [*LINES, "bare"]], "cmd_line string")
    got = {r["cmd_line"]: (r["valid"], sorted(f"{f['level']}:{f['code']}" for part in ("l1", "l2", "l3") for f in r[part])) for r in validation.validate(log, catalogue).collect()}
    assert got == LINES


def test_suggestions(spark, catalogue):
    done = validation.validate(spark.createDataFrame([("run_atgp",), ("run_atpg -autt",), ("zzzz",)], "cmd_line string"), catalogue)
    got = {(r["command"], r["flag"]): r["suggestion"] for r in validation.suggest(done, catalogue).collect()}
    assert got == {("run_atgp", None): "run_atpg", ("run_atpg", "-autt"): "-auto"}


def test_suggestions_do_not_depend_on_blocks(spark):
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abcd_") for _ in range(rng.randint(3, 8))) for _ in range(120)})
    words = sorted({"".join(rng.choice("abcd_") for _ in range(rng.randint(2, 9))) for _ in range(60)} | {names[0]})
    want = {(w, found[0]) for w in words if (found := get_close_matches(w, names, n=1, cutoff=0.6))}
    w = spark.createDataFrame([(x,) for x in words], "word string")
    n = spark.createDataFrame([(x,) for x in names], "name string")
    for blocks in ((20_000, 50_000), (17, 23)):
        assert {(r["word"], r["name"]) for r in validation.nearest_names(w, n, *blocks).collect()} == want


def misspelt(rng, name):
    letters = list(name)
    for _ in range(rng.randint(1, 3)):
        k = rng.randrange(len(letters))
        letters[k : k + rng.choice([0, 1])] = rng.choice(["", "x", "_", "ab"])
    return "".join(letters)


def test_nearest_names_are_those_of_all_pairs_and_few_are_compared(spark):
    rng = random.Random(7)
    parts = ["run", "set", "add", "report", "remove", "read", "write", "faults", "clocks", "netlist", "patterns", "atpg", "drc", "rules", "scan", "cell", "model", "net", "pins", "simulation"]
    names = sorted({"_".join(rng.sample(parts, rng.randint(2, 3))) for _ in range(400)})
    words = sorted({misspelt(rng, rng.choice(names)) for _ in range(120)} | {"".join(rng.choice("abcdefghijklmnopqrstuvwxyz_") for _ in range(rng.randint(1, 20))) for _ in range(40)} | {"", "é", "a" * 300, names[3]})
    want = {w: next(iter(get_close_matches(w, names, n=1, cutoff=0.6)), None) for w in words}
    found = validation.compare_names(spark.createDataFrame([(x,) for x in [*words, None]], "word string"), spark.createDataFrame([(x,) for x in [*names, None]], "name string")).collect()
    assert {r["word"]: r["name"] for r in found} == want
    assert sum(r["compared"] for r in found) < 0.05 * len(words) * len(names)
