"""Jobs on command lines that reach every rule: cleaning, all types, warnings, reports, suggestions.

Each event is one of LINES with its number in it. The SQL's findings are written down by hand next to the
lines, so they don't repeat what the library computes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cmdspark.functions.storage import materialize
from cmdspark.operators import rules, validation

from .mining_jobs import table

#: (command, category, syntax, options)
CATALOGUE = [
    ("run_atpg", "atpg", "run_atpg [-auto_compression] [-optimize_patterns] [-ndetects n] [-ratio x] [-quiet flag] [-out file] [-lbist {a b c}] [full | fast]", ["-auto_compression", "-optimize_patterns", "-ndetects", "-ratio", "-quiet", "-out", "-lbist"]),
    ("set_atpg", "atpg", "set_atpg [-merge <low | medium | high>] [-abort_limit n]", ["-merge", "-abort_limit"]),
    ("add_clocks", "drc", "add_clocks <0 | 1> [-timing {a b}]", ["-timing"]),
    ("reset", "state", None, []),
]
#: (command, flag, datatype, min, max, choices, block_size, block_types)
TYPE_RULES = [
    ("run_atpg", "-ndetects", "int", 1.0, 90.0, None, None, None),
    ("run_atpg", "-ratio", "float", 0.5, None, None, None, None),
    ("run_atpg", "-quiet", "bool", None, None, None, None, None),
    ("run_atpg", "-out", "file", None, None, None, None, None),
    ("run_atpg", "-lbist", None, None, None, None, 3, ["int", "float", "int"]),
    ("set_atpg", "-merge", "enum", None, None, ["low", "high"], None, None),
    ("set_atpg", "-abort_limit", "int", 1.0, None, None, None, None),
    ("add_clocks", "-timing", None, None, None, None, 2, ["float", "float"]),
]
#: (line, what cleaning makes of it); @ is the event's number, from 0 to 99.
LINES = [
    ("run_atpg -ndetects @", "run_atpg -ndetects @"),
    ("  run_atpg \\\n -ndetects\t@  -quiet yes ", "run_atpg -ndetects @ -quiet yes"),
    ("run_atpg -lbist{1 2 @}-auto_compression", "run_atpg -lbist {1 2 @} -auto_compression"),
    ("run_atpg -ndetects @-quiet 1", "run_atpg -ndetects @ -quiet 1"),
    ("run_atpg -ratio 0.@", "run_atpg -ratio 0.@"),
    ("run_atpg -ratio x@", "run_atpg -ratio x@"),
    ("run_atpg -quiet\\maybe", "run_atpg -quiet maybe"),
    ("run_atpg -out a@.v", "run_atpg -out a@.v"),
    ("run_atpg -out plain", "run_atpg -out plain"),
    ("run_atpg-auto_compression -optimize_patterns", "run_atpg -auto_compression -optimize_patterns"),
    ("set_atpg -merge high -abort_limit @", "set_atpg -merge high -abort_limit @"),
    ("set_atpg -merge medium", "set_atpg -merge medium"),
    ("set_atpg -merge odd", "set_atpg -merge odd"),
    ("add_clocks 2 c@", "add_clocks 2 c@"),
    ("add_clocks", "add_clocks"),
    ("add_clocks 1 -timing {1 x}", "add_clocks 1 -timing {1 x}"),
    ("run_atpg -lbist {1 2}", "run_atpg -lbist {1 2}"),
    ("run_atpg -lbist 5", "run_atpg -lbist 5"),
    ("run_atpg full fast", "run_atpg full fast"),
    ("run_atpg stray@", "run_atpg stray@"),
    ("run_atpg -ndetects", "run_atpg -ndetects"),
    ("run_atpg -ndetects @ 6", "run_atpg -ndetects @ 6"),
    ("run_atpg -bad -bad", "run_atpg -bad -bad"),
    ("run_atgp -ndetects @", "run_atgp -ndetects @"),
    ("reset -x", "reset -x"),
    ("reset", "reset"),
    ("run_atpg -ndetects=@", "run_atpg -ndetects=@"),
    ("", ""),
    ("run_atpg -auto_compression yes", "run_atpg -auto_compression yes"),
    ("run_atpg -lbist {}", "run_atpg -lbist {}"),
    ("run_atpg -ndetects @ -outt", "run_atpg -ndetects @ -outt"),
]
_RANGE = "Flag '-ndetects' value @ < min 1", "Flag '-ndetects' value @ > max 90"


def _in_range(i: int) -> list[tuple]:
    return [
        (i, 0, 0, 3, "error", "below_min", "-ndetects", "1", "@", _RANGE[0]),
        (i, 91, 999, 3, "error", "above_max", "-ndetects", "90", "@", _RANGE[1]),
    ]


#: (line, from number, to number, level, severity, code, subject, expected, given, sentence), in the order of a level's checks.
EXPECTED = [
    *_in_range(0), *_in_range(1), *_in_range(3), *_in_range(21), *_in_range(26), *_in_range(30),
    (4, 0, 4, 3, "error", "below_min", "-ratio", "0.5", "0.@", "Flag '-ratio' value 0.@ < min 0.5"),
    (4, 10, 49, 3, "error", "below_min", "-ratio", "0.5", "0.@", "Flag '-ratio' value 0.@ < min 0.5"),
    (5, 0, 999, 3, "error", "wrong_type", "-ratio", "float", "x@", "Flag '-ratio' expects float, got 'x@'"),
    (6, 0, 999, 3, "error", "wrong_type", "-quiet", "bool", "maybe", "Flag '-quiet' expects bool, got 'maybe'"),
    (8, 0, 999, 3, "error", "wrong_type", "-out", "file", "plain", "Flag '-out' expects file, got 'plain'"),
    (9, 0, 999, 3, "warning", "flags_conflict", "-auto_compression -optimize_patterns", None, None, "Flags work against each other: -auto_compression -optimize_patterns"),
    (10, 0, 0, 3, "error", "below_min", "-abort_limit", "1", "@", "Flag '-abort_limit' value @ < min 1"),
    (10, 0, 9, 3, "warning", "low_limit", "-merge -abort_limit", None, None, "High effort with a low limit: -merge -abort_limit"),
    (11, 0, 999, 3, "error", "not_in_enum", "-merge", "low, high", "medium", "Flag '-merge' must be one of: low, high; got 'medium'"),
    (12, 0, 999, 2, "error", "not_a_choice", "-merge", "low, medium, high", "odd", "Flag '-merge' must be one of: low, medium, high; got 'odd'"),
    (12, 0, 999, 3, "error", "not_in_enum", "-merge", "low, high", "odd", "Flag '-merge' must be one of: low, high; got 'odd'"),
    (13, 0, 999, 2, "error", "bad_positional", "2", "0, 1", "2", "Positional argument '2' must be one of: 0, 1"),
    (14, 0, 999, 2, "error", "missing_positional", "0", "0, 1", None, "Missing positional argument 0, one of: 0, 1"),
    (15, 0, 999, 3, "error", "block_type", "-timing[1]", "float", "x", "Flag '-timing[1]' expects float, got 'x'"),
    (16, 0, 999, 3, "error", "block_size", "-lbist", "3", "2", "Flag '-lbist' expects 3 values, got 2"),
    (17, 0, 999, 3, "error", "needs_block", "-lbist", "{...}", "5", "Flag '-lbist' requires a block {...}, got '5'"),
    (18, 0, 999, 2, "error", "mutually_exclusive", "full, fast", None, None, "Mutually exclusive options: full, fast"),
    (19, 0, 999, 2, "error", "unexpected_positional", "stray@", None, None, "Unexpected positional argument: 'stray@'"),
    (20, 0, 999, 2, "error", "needs_argument", "-ndetects", "value", None, "Flag '-ndetects' requires an argument (value)"),
    (21, 0, 999, 2, "error", "argument_count", "-ndetects", "1", "2", "Flag '-ndetects' expects 1 argument(s), got 2"),
    (22, 0, 999, 1, "warning", "duplicate_flag", "-bad", None, None, "Duplicate flag: -bad"),
    (22, 0, 999, 1, "error", "unknown_flag", "-bad", None, None, "Unknown option: -bad"),
    (22, 0, 999, 1, "error", "unknown_flag", "-bad", None, None, "Unknown option: -bad"),
    (22, 0, 999, 2, "warning", "duplicate_flag", "-bad", None, None, "Duplicate flag: -bad"),
    (23, 0, 999, 1, "error", "unknown_command", "run_atgp", None, None, "Unknown command: 'run_atgp'"),
    (24, 0, 999, 1, "error", "no_flags_accepted", "reset", None, None, "Command 'reset' does not accept any flags"),
    (24, 0, 999, 1, "error", "unknown_flag", "-x", None, None, "Unknown option: -x"),
    (26, 0, 999, 2, "error", "equals_sign", "-ndetects=@", None, None, "'-ndetects=@': arguments are separated by a blank, not by '='"),
    (27, 0, 999, 1, "error", "empty", None, None, None, "Empty command line"),
    (28, 0, 999, 2, "error", "takes_no_argument", "-auto_compression", "0", "yes", "Flag '-auto_compression' takes no argument, got: yes"),
    (29, 0, 999, 2, "error", "empty_block", "-lbist", "{...}", "{}", "Flag '-lbist' needs a block {...} that isn't empty"),
    (29, 0, 999, 3, "error", "block_size", "-lbist", "3", "0", "Flag '-lbist' expects 3 values, got 0"),
    (30, 0, 999, 1, "error", "unknown_flag", "-outt", None, None, "Unknown option: -outt"),
]
#: (line, command, flag, nearest name, sentence)
HINTS = [(23, "run_atgp", None, "run_atpg", "Did you mean: run_atpg?"), (30, "run_atpg", "-outt", "-out", "'-outt': try '-out'")]


def catalogue(spark: SparkSession) -> DataFrame:
    ruled = rules.with_rules(spark.createDataFrame(CATALOGUE, "command string, category string, syntax string, options array<string>"))
    return rules.overlay_types(ruled, spark.createDataFrame(TYPE_RULES, rules.TYPE_RULE))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = F.element_at(F.array(*[F.lit(x) for x, _ in LINES]), (F.col("event_id") % len(LINES) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.replace(template, F.lit("@"), F.get_json_object("props", "$.k")).alias("cmd_line"))


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.validate(lines(spark, sf_dir), catalogue(spark))


def v27_validate(spark, sf_dir):
    """Each distinct line cleaned and judged."""
    return validated(spark, sf_dir).select("cmd_line", "clean_line", "command_exists", "l1_valid", "l2_valid", "valid")


def v28_finding_rows(spark, sf_dir):
    """V5 to V26 with what was expected and given, in the order of a report."""
    return validation.findings(validated(spark, sf_dir))


def v28_report(spark, sf_dir):
    done = materialize(validated(spark, sf_dir), "validated")
    return validation.report(done, validation.suggest(done, catalogue(spark)))


def v8_flag_suggestions(spark, sf_dir):
    """V4 and V8."""
    return validation.suggest(validated(spark, sf_dir), catalogue(spark))


QUERIES = {f.__name__: f for f in (v27_validate, v28_finding_rows, v28_report, v8_flag_suggestions)}


def _text(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, int):
        return str(value)
    return " || chr(10) || ".join(" || chr(9) || ".join("'" + t.replace("'", "''") + "'" for t in part.split("\t")) for part in value.split("\n"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows)


_SQL = f"""
WITH tp(i, raw, neat) AS (VALUES {_values([(i, *x) for i, x in enumerate(LINES)])}),
ex(i, low, high, pos, level, severity, code, subject, expected, given, says) AS (VALUES {_values([(*e[:3], pos, *e[3:]) for pos, e in enumerate(EXPECTED)])}),
hi(i, command, flag, suggestion, says) AS (VALUES {_values(HINTS)}),
sy(command, syntax) AS (VALUES {_values([(c[0], c[2]) for c in CATALOGUE])}),
ev AS (SELECT DISTINCT event_id % {len(LINES)} AS i, CASE WHEN contains(raw, '@') THEN json_extract_string(props, '$.k') ELSE '0' END AS k, raw, neat FROM events JOIN tp ON tp.i = event_id % {len(LINES)}),
ln AS (SELECT i, k, replace(raw, '@', k) AS cmd_line, replace(neat, '@', k) AS clean_line, split_part(neat, ' ', 1) AS command FROM ev),
fi AS (SELECT cmd_line, row_number() OVER (PARTITION BY cmd_line ORDER BY severity <> 'error', level DESC, pos) - 1 AS ord, pos, level, severity, code, replace(subject, '@', k) AS subject, expected, replace(given, '@', k) AS given, replace(says, '@', k) AS says
       FROM ln JOIN ex ON ex.i = ln.i AND k::INT BETWEEN low AND high),
ve AS (SELECT ln.*, i NOT IN (23, 27) AS command_exists, NOT EXISTS (SELECT 1 FROM fi WHERE fi.cmd_line = ln.cmd_line AND level = 1 AND severity = 'error') AS l1_valid,
              NOT EXISTS (SELECT 1 FROM fi WHERE fi.cmd_line = ln.cmd_line AND level <= 2 AND severity = 'error') AS l2_valid, NOT EXISTS (SELECT 1 FROM fi WHERE fi.cmd_line = ln.cmd_line AND severity = 'error') AS valid FROM ln),
command_events AS (SELECT user_id, event_id, ts, replace(raw, '@', json_extract_string(props, '$.k')) AS cmd_line FROM events JOIN tp ON tp.i = event_id % {len(LINES)}),
re AS (SELECT cmd_line, string_agg('  ' || severity || ' L' || level || ': ' || says, chr(10) ORDER BY level DESC, severity <> 'error', pos) AS found FROM fi GROUP BY 1),
rp AS (SELECT cmd_line, concat_ws(chr(10), ve.command || CASE WHEN valid THEN ' VALID' WHEN ve.i = 23 THEN ' UNKNOWN COMMAND' ELSE ' INVALID' END, found, '  ' || hi.says, '  Syntax: ' || syntax) AS report
       FROM ve LEFT JOIN re USING (cmd_line) LEFT JOIN hi USING (i) LEFT JOIN sy ON sy.command = ve.command)
"""
#: The events' lines, their findings and reports, for other jobs: command_events, ve, fi and rp.
FINDINGS_SQL = _SQL
SQL = {
    "v27_validate": _SQL + "SELECT cmd_line, clean_line, command_exists, l1_valid, l2_valid, valid FROM ve",
    "v28_finding_rows": _SQL + "SELECT cmd_line, ord::INT AS ord, level::INT AS level, severity, code, subject, expected, given FROM fi",
    "v28_report": _SQL + "SELECT cmd_line, report FROM rp",
    "v8_flag_suggestions": _SQL + "SELECT DISTINCT hi.command, hi.flag::VARCHAR AS flag, hi.suggestion FROM hi JOIN ve USING (i)",
}
