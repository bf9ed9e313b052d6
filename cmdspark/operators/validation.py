"""Validating command lines against a catalogue at three levels, once for each distinct line.

A line's tokens come from one Arrow function; every check after that is an expression over arrays of the
line and of its command's catalogue row, which one join brings. No check shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdspark.functions.batches import append_column
from cmdspark.functions.shipping import ship_package
from cmdspark.functions.similarity import nearest, nearest_of_block
from cmdspark.functions.storage import materialize
from cmdspark.functions.tokens import TOKENS, line_tokens

from .cleaning import clean

#: ``subject`` is what a finding is about; ``expected`` what would be right and ``given`` what there was, where a check has them.
FINDING = "struct<level:int,severity:string,code:string,subject:string,expected:string,given:string>"
#: Warnings for a pair of flags, and for a value together with a small number.
PAIRS = (("run_atpg", "-auto_compression", "-optimize_patterns"),)
LIMITS = (("set_atpg", "-merge", "high", "-abort_limit", 10),)


def finding(level: int, severity: str, code: str, subject: Column, expected: Column | None = None, given: Column | None = None) -> Column:
    values = {"subject": subject, "expected": expected, "given": given}
    texts = [(F.lit(None) if v is None else v).cast("string").alias(k) for k, v in values.items()]
    return F.struct(F.lit(level).alias("level"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), *texts)


def listed(values: Column) -> Column:
    return F.array_join(values, ", ")


def none() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def when_all(condition: Column, *found: Column) -> Column:
    return F.when(condition, F.concat(*found)).otherwise(none())


def one(condition: Column, level: int, severity: str, code: str, subject: Column, expected: Column | None = None, given: Column | None = None) -> Column:
    return F.when(condition, F.array(finding(level, severity, code, subject, expected, given))).otherwise(none())


def each(values: Column, level: int, severity: str, code: str) -> Column:
    return F.coalesce(F.transform(values, lambda v: finding(level, severity, code, v)), none())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it: inside lambdas nothing else shares it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def only_if(shown: Column, found: Column) -> Column:
    """``found``, an array of findings, where ``shown`` says that there may be some.

    Set operations on whole arrays run in generated code and tell for most lines that a check has nothing to
    say; only for the others the check's lambdas run.
    """
    return F.when(shown, found).otherwise(none())


def repeated(values: Column) -> Column:
    """Sorted distinct values that occur more than once."""
    return F.when(F.size(F.array_distinct(values)) == F.size(values), F.array().cast("array<string>")).otherwise(_repeated(values))


def _repeated(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: F.size(F.filter(values, lambda w: w == v)) > 1)))


def unbraced(text: Column) -> Column:
    return F.regexp_replace(text, r"^[{}]+|[{}]+$", "")


def split_line(lines: DataFrame, column: str = "cmd_line") -> DataFrame:
    """Adds command, flags, positionals (level 1), tokens of the raw line and structured items (level 2)."""
    parsed = append_column(lines, "parsed", TOKENS, line_tokens, column)
    rest = F.slice("parsed.plain", F.lit(2), F.greatest(F.lit(0), F.size("parsed.plain") - 1))
    return parsed.withColumns({
        "command": F.get("parsed.plain", F.lit(0)),
        "flags": F.transform(F.filter(rest, lambda t: t.startswith("-")), lambda t: F.split_part(t, F.lit("="), F.lit(1))),
        "positionals": F.filter(rest, lambda t: ~t.startswith("-")),
        "items": F.col("parsed.items"),
        "words": F.filter(F.split(F.coalesce(F.col(column), F.lit("")), r"(?U)\s+"), lambda t: t != ""),
    }).drop("parsed")


def look_up(parsed: DataFrame, catalogue: DataFrame) -> DataFrame:
    """V3: joins (syntax, category, options, rules, types) of the command; ``command_exists``. Spark broadcasts the catalogue if it finds it small."""
    columns = [c for c in ("syntax", "category", "options", "rules", "types") if c in catalogue.columns]
    known = catalogue.select("command", *columns, F.lit(True).alias("known"))
    return parsed.join(known, "command", "left").withColumn("command_exists", F.coalesce("known", F.lit(False))).drop("known")


def level1(found: DataFrame) -> DataFrame:
    """V3, V5 to V7: adds unknown_options, l1 (findings) and l1_valid."""
    options = F.coalesce("options", F.array().cast("array<string>"))
    unknown = F.when(F.size(F.array_except("flags", options)) > 0, F.filter("flags", lambda f: ~F.array_contains(options, f))).otherwise(F.array().cast("array<string>"))
    exists = F.col("command_exists")
    marked = found.withColumn("unknown_options", F.when(exists, unknown).otherwise(F.array().cast("array<string>")))
    return marked.withColumn(
        "l1",
        F.concat(
            one(F.col("command").isNull(), 1, "error", "empty", F.lit(None)),
            one(F.col("command").isNotNull() & ~exists, 1, "error", "unknown_command", F.col("command")),
            when_all(exists, each(repeated(F.col("flags")), 1, "warning", "duplicate_flag")),
            one(exists & (F.size(options) == 0) & (F.size("flags") > 0), 1, "error", "no_flags_accepted", F.col("command")),
            each(F.col("unknown_options"), 1, "error", "unknown_flag"),
        ),
    ).withColumn("l1_valid", exists & (F.size("unknown_options") == 0))


#: Words and names of a block; every pair of blocks is a task, which holds an index of its names.
WORD_BLOCK, NAME_BLOCK = 20_000, 50_000


def compare_names(words: DataFrame, names: DataFrame, word_block: int = WORD_BLOCK, name_block: int = NAME_BLOCK) -> DataFrame:
    """(word, name, ratio, compared): the nearest of ``names`` (name) for each of ``words`` (word), null if none is near, and the pairs compared for it.

    Both are dealt to blocks, and a task has one block of each: words are copied for each block of names,
    and a common catalogue is one. The task finds candidates by an inverted index and compares few of them
    (``NameIndex``). Neither side has a limit; no list of names goes through the driver or the plan.
    """
    ship_package(words.sparkSession)
    words, names = materialize(words.distinct(), "unknown-words"), materialize(names.distinct(), "known-names")
    word_blocks, name_blocks = max(1, -(-words.count() // word_block)), max(1, -(-names.count() // name_block))

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        place = F.pmod(F.xxhash64(*df.columns), F.lit(blocks))
        pairs = df.withColumn(own, place).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))
        return pairs.groupBy("word_place", "name_place")

    left = dealt(words, "word_place", word_blocks, "name_place", name_blocks)
    right = dealt(names, "name_place", name_blocks, "word_place", word_blocks)
    found = left.cogroup(right).applyInArrow(nearest_of_block, "word string, ratio double, name string, compared long")
    best = found.groupBy("word").agg(F.max(F.struct("ratio", "name")).alias("best"), F.sum("compared").alias("compared"))
    return best.select("word", "best.name", "best.ratio", "compared")


def nearest_names(words: DataFrame, names: DataFrame, word_block: int = WORD_BLOCK, name_block: int = NAME_BLOCK) -> DataFrame:
    """(word, name) of the nearest of ``names`` (name) for each of ``words`` (word), if one is near; ties to the larger name."""
    return compare_names(words, names, word_block, name_block).filter("name is not null").select("word", "name")


def suggest(validated: DataFrame, catalogue: DataFrame) -> DataFrame:
    """V4, V8: (command, flag, suggestion) for distinct unknown commands (flag null) and flags of known ones.

    Commands are compared with all names; flags with their own command's options only.
    """
    bad = validated.filter(~F.col("command_exists") & F.col("command").isNotNull()).select(F.col("command").alias("word"))
    commands = nearest_names(bad, catalogue.select(F.col("command").alias("name")))
    flags = validated.select("command", F.explode("unknown_options").alias("flag")).distinct().join(catalogue.select("command", "options"), "command")
    found = append_column(flags, "suggestion", "string", nearest, "flag", "options").filter("suggestion is not null")
    return commands.select(F.col("word").alias("command"), F.lit(None).cast("string").alias("flag"), F.col("name").alias("suggestion")).unionByName(found.select("command", "flag", "suggestion"))


def _used(found: DataFrame) -> DataFrame:
    """Adds used (distinct flags in order), given (flag -> args of its last use) and loose (positionals of level 2)."""
    flags = F.filter("items", lambda i: i["kind"].isin("flag", "flag_arg"))
    out = found.withColumns({"flag_items": flags, "loose": F.transform(F.filter("items", lambda i: i["kind"] == "positional"), lambda i: i["name"])})
    out = out.withColumn("used", F.array_distinct(F.transform("flag_items", lambda i: i["name"])))
    return out.withColumn("given", F.transform("used", lambda n: F.struct(n.alias("flag"), F.element_at(F.filter("flag_items", lambda i: i["name"] == n), -1)["args"].alias("args"))))


def _flag_checks() -> Column:
    """V13 to V16 for each flag used that the syntax declares, in order of use."""
    def check(use: Column, rule: Column) -> Column:
        count, first = F.size(use["args"]), F.coalesce(F.get(use["args"], F.lit(0)), F.lit(""))
        error = lambda code, expected=None, given=None: finding(2, "error", code, use["flag"], expected, given)
        allowed = F.transform(rule["choices"], unbraced)
        return (
            F.when(rule.isNull(), F.lit(None))
            .when((rule["type"] == "boolean") & (count > 0), error("takes_no_argument", F.lit("0"), listed(use["args"])))
            .when(rule["type"].isin("value", "block", "choice") & (count == 0), error("needs_argument", rule["type"]))
            .when((rule["type"] == "value") & (count != rule["n_args"]), error("argument_count", rule["n_args"], count))
            .when((rule["type"] == "block") & (unbraced(first) == ""), error("empty_block", F.lit("{...}"), first))
            .when((rule["type"] == "choice") & (F.size(rule["choices"]) > 0) & ~F.array_contains(allowed, unbraced(first)), error("not_a_choice", listed(rule["choices"]), first))
        )

    rule = lambda use: F.get(F.filter("rules.flags", lambda r: r["flag"] == use["flag"]), F.lit(0))
    declared = F.arrays_overlap("used", F.transform("rules.flags", lambda r: r["flag"]))
    return only_if((F.size("used") > 0) & declared, F.array_compact(F.transform("given", lambda use: let(rule(use), lambda r: check(use, r)))))


def _group_checks() -> Column:
    """Groups of which more than one member is used, as a flag or as a positional."""
    def members(group: Column) -> Column:
        return F.concat(F.filter(group, lambda m: F.array_contains(F.col("used"), m)), F.filter(group, lambda m: F.array_contains(F.col("loose"), m)))

    hit = F.filter(F.transform("rules.mutex", members), lambda found: F.size(found) > 1)
    two = F.size(F.array_intersect(F.flatten("rules.mutex"), F.concat("used", "loose"))) + F.size("loose") > 1  # a positional may stand in a group twice
    return only_if(two, F.transform(hit, lambda found: finding(2, "error", "mutually_exclusive", F.array_join(found, ", "))))


def _positional_checks() -> Column:
    """V18, V19."""
    def check(req: Column) -> Column:
        value = F.get("loose", req["position"])
        return (
            F.when(value.isNull(), finding(2, "error", "missing_positional", req["position"], listed(req["choices"])))
            .when(~F.array_contains(req["choices"], value), finding(2, "error", "bad_positional", value, listed(req["choices"]), value))
        )

    grouped = F.flatten("rules.mutex")
    stray = F.filter("loose", lambda p: ~F.array_contains(grouped, p))
    unexpected = only_if(F.size("loose") > 0, each(stray, 2, "error", "unexpected_positional"))
    return F.when(F.size("rules.positionals") > 0, F.array_compact(F.transform("rules.positionals", check))).otherwise(unexpected)


def level2(checked: DataFrame) -> DataFrame:
    """Adds l2 (findings) and l2_valid; a line whose command has no syntax has no checks here."""
    used = _used(checked)
    ruled = F.col("command_exists") & (F.coalesce(F.col("rules.status"), F.lit("none")) != "none")
    equals = F.filter("words", lambda t: t.startswith("-") & F.contains(t, F.lit("=")))
    names = F.transform("flag_items", lambda i: i["name"])
    checks = F.concat(each(repeated(names), 2, "warning", "duplicate_flag"), _flag_checks(), _group_checks(), _positional_checks())
    l2 = (
        F.when(~ruled, none())
        .when(F.size(equals) > 0, F.array(finding(2, "error", "equals_sign", F.get(equals, F.lit(0)))))
        .otherwise(checks)
    )
    return used.withColumn("l2", F.coalesce(l2, none())).withColumn("l2_valid", F.col("l1_valid") & ~F.exists("l2", lambda f: f["severity"] == "error"))


#: What texts a type accepts; digits may be parted by single underscores, blanks may surround.
_DIGITS = r"[0-9]+(_[0-9]+)*"
TYPE_PATTERNS = {
    "int": rf"^\s*[+-]?{_DIGITS}\s*$",
    "float": rf"(?i)^\s*[+-]?(({_DIGITS}\.?({_DIGITS})?|\.{_DIGITS})(e[+-]?{_DIGITS})?|inf|infinity|nan)\s*$",
    "bool": r"(?i)^(true|false|1|0|yes|no)$",
    "file": r"/|\\|\.[^/]*$",
}


def has_type(value: Column, datatype: Column) -> Column:
    """Whether a text is of the type; types that aren't listed accept anything."""
    out = F.lit(True)
    for name, pattern in TYPE_PATTERNS.items():
        out = F.when(datatype == name, value.rlike(pattern)).otherwise(out)
    return out


def bound(number: Column) -> Column:
    """A limit as it was meant: whole numbers without a fraction."""
    return F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))


def _type_check(use: Column) -> Column:
    """V22 to V25 for one use of a flag with arguments: an array of findings."""
    rule = F.get(F.filter("types", lambda t: t["flag"] == use["name"]), F.lit(0))
    first = F.get(use["args"], F.lit(0))
    return let(rule, lambda r: F.when(r.isNull() | first.isNull(), none()).otherwise(let(unbraced(first), lambda value: _value_check(use["name"], r, first, value))))


def _value_check(name: Column, rule: Column, first: Column, value: Column) -> Column:
    kind = rule["datatype"]
    error = lambda code, expected, given: F.array(finding(3, "error", code, name, expected, given))
    number = F.regexp_replace(F.trim(value), "_", "").try_cast("double")
    tokens = F.filter(F.split(F.substring(first, F.lit(2), F.length(first) - 2), r"(?U)\s+"), lambda t: t != "")
    wrong = F.filter(F.transform(F.arrays_zip(tokens.alias("t"), rule["block_types"].alias("k")), lambda z, i: F.struct(i.alias("i"), z["t"].alias("t"), z["k"].alias("k"), has_type(z["t"], z["k"]).alias("ok"))), lambda z: ~z["ok"])
    block = (
        F.when(rule["block_size"].isNull() | (rule["block_size"] == 0), none())
        .when(~(first.startswith("{") & first.endswith("}")), error("needs_block", F.lit("{...}"), first))
        .when(F.size(tokens) != rule["block_size"], error("block_size", rule["block_size"], F.size(tokens)))
        .otherwise(F.coalesce(F.transform(wrong, lambda z: finding(3, "error", "block_type", F.concat(name, F.lit("["), z["i"].cast("string"), F.lit("]")), z["k"], z["t"])), none()))
    )
    in_range = F.concat(
        one(kind.isin("int", "float") & (number < rule["min"]), 3, "error", "below_min", name, bound(rule["min"]), value),
        one(kind.isin("int", "float") & (number > rule["max"]), 3, "error", "above_max", name, bound(rule["max"]), value),
    )
    return (
        F.when((kind == "enum"), one(~F.array_contains(F.coalesce(rule["choices"], F.array().cast("array<string>")), value), 3, "error", "not_in_enum", name, listed(rule["choices"]), value))
        .when(kind.isNotNull() & ~has_type(value, kind), error("wrong_type", kind, value))
        .otherwise(F.concat(F.when(kind.isNull(), none()).otherwise(F.coalesce(in_range, none())), block))
    )


def level3(checked: DataFrame, pairs=PAIRS, limits=LIMITS) -> DataFrame:
    """Adds l3 (findings) and valid."""
    uses = F.filter("flag_items", lambda i: i["kind"] == "flag_arg")
    warnings = [
        one((F.col("command") == c) & F.array_contains("used", a) & F.array_contains("used", b), 3, "warning", "flags_conflict", F.lit(f"{a} {b}"))
        for c, a, b in pairs
    ] + [
        one((F.col("command") == c) & (value_or_null(uses, a) == x) & value_or_null(uses, b).rlike("^[0-9]+$") & (value_or_null(uses, b).cast("double") < below), 3, "warning", "low_limit", F.lit(f"{a} {b}"))
        for c, a, x, b, below in limits
    ]
    checks = only_if((F.size("types") > 0) & (F.size("used") > 0), F.flatten(F.transform(uses, _type_check)))
    ruled = F.col("command_exists") & F.col("types").isNotNull()
    out = checked.withColumn("l3", F.when(F.col("command_exists"), F.concat(F.when(ruled, F.coalesce(checks, none())).otherwise(none()), *[F.coalesce(w, none()) for w in warnings])).otherwise(none()))
    return out.withColumn("valid", F.col("l2_valid") & ~F.exists("l3", lambda f: f["severity"] == "error"))


def value_or_null(uses: Column, flag: str) -> Column:
    """First argument of the last use of a flag."""
    return F.get(F.try_element_at(F.filter(uses, lambda i: i["name"] == flag), F.lit(-1))["args"], F.lit(0))


def validate(lines: DataFrame, catalogue: DataFrame, column: str = "cmd_line") -> DataFrame:
    """One row per distinct line: the line, clean_line, command, command_exists, syntax, valid, l1, l2, l3.

    ``catalogue`` has (command, syntax, category, options array, rules, types), as ``with_rules`` and
    ``overlay_types`` give it. The raw line's command gives the known flags that cleaning cuts off; all
    three levels then look at the clean line. Null and empty lines are invalid.
    """
    distinct = lines.select(F.col(column).alias("cmd_line")).distinct()
    raw = F.regexp_extract(F.coalesce(F.col("cmd_line"), F.lit("")), r"(?U)^\s*([^ \t]+)", 1)
    known = catalogue.select(F.col("command").alias("raw_command"), F.transform("rules.flags", lambda r: r["flag"]).alias("known_flags"))
    cleaned = distinct.withColumn("raw_command", raw).join(known, "raw_command", "left").withColumn("clean_line", clean(F.col("cmd_line"), F.col("known_flags"))).drop("raw_command", "known_flags")
    done = level3(level2(level1(look_up(split_line(cleaned, "clean_line"), catalogue))))
    return done.select("cmd_line", "clean_line", "command", "command_exists", "category", "syntax", "unknown_options", "l1_valid", "l2_valid", "valid", "l1", "l2", "l3")


def findings(validated: DataFrame) -> DataFrame:
    """(cmd_line, ord, level, severity, code, subject, expected, given), in the order of a report: errors of level 3, 2, 1, then warnings."""
    everything = F.concat("l3", "l2", "l1")
    errors = F.filter(everything, lambda f: f["severity"] == "error")
    warnings = F.filter(everything, lambda f: f["severity"] != "error")
    return validated.select("cmd_line", F.posexplode(F.concat(errors, warnings)).alias("ord", "f")).select("cmd_line", "ord", "f.*")


#: What a finding of each code says; {s}, {e} and {g} are its subject, what was expected and what was given.
MESSAGES = {
    "empty": "Empty command line",
    "unknown_command": "Unknown command: '{s}'",
    "duplicate_flag": "Duplicate flag: {s}",
    "no_flags_accepted": "Command '{s}' does not accept any flags",
    "unknown_flag": "Unknown option: {s}",
    "equals_sign": "'{s}': arguments are separated by a blank, not by '='",
    "takes_no_argument": "Flag '{s}' takes no argument, got: {g}",
    "needs_argument": "Flag '{s}' requires an argument ({e})",
    "argument_count": "Flag '{s}' expects {e} argument(s), got {g}",
    "empty_block": "Flag '{s}' needs a block {e} that isn't empty",
    "not_a_choice": "Flag '{s}' must be one of: {e}; got '{g}'",
    "mutually_exclusive": "Mutually exclusive options: {s}",
    "missing_positional": "Missing positional argument {s}, one of: {e}",
    "bad_positional": "Positional argument '{g}' must be one of: {e}",
    "unexpected_positional": "Unexpected positional argument: '{s}'",
    "not_in_enum": "Flag '{s}' must be one of: {e}; got '{g}'",
    "wrong_type": "Flag '{s}' expects {e}, got '{g}'",
    "below_min": "Flag '{s}' value {g} < min {e}",
    "above_max": "Flag '{s}' value {g} > max {e}",
    "needs_block": "Flag '{s}' requires a block {e}, got '{g}'",
    "block_size": "Flag '{s}' expects {e} values, got {g}",
    "block_type": "Flag '{s}' expects {e}, got '{g}'",
    "flags_conflict": "Flags work against each other: {s}",
    "low_limit": "High effort with a low limit: {s}",
}


def message(f: Column) -> Column:
    """A finding as a sentence; its code where that is unknown."""
    fields = {"{s}": "subject", "{e}": "expected", "{g}": "given"}
    out = f["code"]
    for code, template in MESSAGES.items():
        parts = [F.coalesce(f[fields[x]], F.lit("")) if x in fields else F.lit(x) for x in re.split(r"(\{[seg]\})", template) if x]
        out = F.when(f["code"] == code, F.concat(*parts)).otherwise(out)
    return out


def report(validated: DataFrame, suggestions: DataFrame | None = None) -> DataFrame:
    """(cmd_line, report): a line's verdict, its findings level by level as sentences, suggestions, and the command's syntax.

    ``suggestions`` are those of ``suggest``; the sections are errors and warnings of level 3, 2, 1, in this order.
    """
    own = validated
    hints = F.array().cast("array<string>")
    if suggestions is not None:
        flags = suggestions.filter("flag is not null").groupBy("command").agg(F.map_from_entries(F.collect_list(F.struct("flag", "suggestion"))).alias("flag_hints"))
        names = suggestions.filter("flag is null").select("command", F.col("suggestion").alias("name_hint"))
        own = own.join(flags, "command", "left").join(names, "command", "left")
        near = F.transform(F.array_distinct("unknown_options"), lambda f: F.when(F.try_element_at("flag_hints", f).isNotNull(), F.concat(F.lit("  '"), f, F.lit("': try '"), F.try_element_at("flag_hints", f), F.lit("'"))))
        name = F.when(~F.col("command_exists") & F.col("name_hint").isNotNull(), F.concat(F.lit("  Did you mean: "), F.col("name_hint"), F.lit("?")))
        hints = F.array_compact(F.concat(F.coalesce(near, hints), F.array(name)))

    parts = []
    for level in ("l3", "l2", "l1"):
        parts += [F.filter(level, lambda f: f["severity"] == "error"), F.filter(level, lambda f: f["severity"] != "error")]
    sentences = F.transform(F.concat(*parts), lambda f: F.concat(F.lit("  "), f["severity"], F.lit(" L"), f["level"].cast("string"), F.lit(": "), message(f)))

    head = F.concat(
        F.coalesce("command", F.lit("")),
        F.when(F.col("valid"), F.lit(" VALID")).when(F.col("command").isNotNull() & ~F.col("command_exists"), F.lit(" UNKNOWN COMMAND")).otherwise(F.lit(" INVALID")),
    )
    syntax = F.when(F.coalesce("syntax", F.lit("")) != "", F.concat(F.lit("  Syntax: "), F.col("syntax")))
    lines = F.concat(F.array(head), sentences, hints, F.array(syntax))
    return own.select("cmd_line", F.array_join(F.array_compact(lines), "\n").alias("report"))


def validate_scripts(lines: DataFrame, catalogue: DataFrame) -> DataFrame:
    """V9: level 1 for script lines (script_id, line_no, line): trimmed, blank and # lines dropped."""
    own = lines.withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", "")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    distinct = own.select(F.col("line").alias("cmd_line")).distinct()
    checked = level1(look_up(split_line(distinct), catalogue)).select(F.col("cmd_line").alias("line"), "command", "command_exists", "l1_valid", "unknown_options", "l1")
    return own.join(checked, "line")
