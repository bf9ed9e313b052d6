"""Replaying sessions: transition probabilities, state before each command, warnings and suggestions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import SPLIT_OVER, ordered

RARE = 0.3


@dataclass(frozen=True)
class StateRules:
    """Which commands set and clear a flag, and what to warn of when a command finds flags unset.

    ``sets``: flag -> commands; ``clears``: flag -> commands; ``line_sets``: (flag, commands, text) sets
    the flag if the lower-cased line holds the text; ``warn``: (command, flags that must all be unset, message).
    """

    flags: tuple[str, ...]
    sets: dict[str, tuple[str, ...]]
    clears: dict[str, tuple[str, ...]] = field(default_factory=dict)
    line_sets: tuple[tuple[str, tuple[str, ...], str], ...] = ()
    warn: tuple[tuple[str, tuple[str, ...], str], ...] = ()


#: The rules of the test-generation tool's session.
DEFAULT_RULES = StateRules(
    flags=("netlist_loaded", "model_built", "drc_passed", "clocks_defined", "faults_defined", "patterns_configured", "atpg_configured", "patterns_generated", "spf_loaded"),
    sets={
        "netlist_loaded": ("read_netlist",), "model_built": ("run_build_model", "run_build"), "drc_passed": ("run_drc",), "clocks_defined": ("add_clocks",),
        "faults_defined": ("add_faults",), "patterns_configured": ("set_patterns",), "atpg_configured": ("set_atpg",), "patterns_generated": ("run_atpg",),
    },
    clears={"clocks_defined": ("remove_clocks",), "faults_defined": ("remove_faults",)},
    line_sets=(("spf_loaded", ("read_netlist", "run_drc"), ".spf"),),
    warn=(
        ("run_atpg", ("faults_defined",), "No faults defined — coverage may be limited (use add_faults -all)"),
        ("run_atpg", ("atpg_configured",), "ATPG using default settings (no set_atpg detected)"),
        ("run_atpg", ("model_built",), "ATPG model not built — run run_build_model first"),
        ("report_clocks", ("clocks_defined", "spf_loaded"), "No clocks defined — report may be empty (add_clocks or load SPF)"),
        ("remove_clocks", ("clocks_defined",), "No clocks currently defined — remove_clocks may have no effect"),
        ("write_patterns", ("patterns_generated",), "No patterns generated — write may be empty (run run_atpg first)"),
        ("run_drc", ("netlist_loaded",), "No netlist loaded — run read_netlist first"),
        ("run_build_model", ("netlist_loaded",), "No netlist loaded — run read_netlist first"),
    ),
)


def transition_probability(transitions: DataFrame) -> DataFrame:
    """A1: (from, to, count, prob); prob is the share of the transitions out of ``from``."""
    out = transitions.groupBy("from").agg(F.sum("count").alias("total"))
    return transitions.join(out, "from").select("from", "to", "count", (F.col("count") / F.col("total")).alias("prob"))


def effect(rules: StateRules, flag: str, command: Column, line: Column) -> Column:
    """True where a command sets the flag, false where it clears it, else null."""
    out = F.lit(None).cast("boolean")
    for name, commands, text in rules.line_sets:
        if name == flag:
            out = F.when(command.isin(*commands) & F.contains(F.lower(line), F.lit(text)), F.lit(True)).otherwise(out)
    if flag in rules.sets:
        out = F.when(command.isin(*rules.sets[flag]), F.lit(True)).otherwise(out)
    if flag in rules.clears:
        out = F.when(command.isin(*rules.clears[flag]), F.lit(False)).otherwise(out)
    return out


def replay(log: DataFrame, rules: StateRules = DEFAULT_RULES, split_over: int | None = SPLIT_OVER) -> DataFrame:
    """A2, A4: the log (session_id, seq, command, cmd_line, valid) with each flag and ``prev`` as they were before the row.

    Only valid commands change the state. All flags share one window: one shuffle and one sort by session.
    Sessions of over ``split_over`` rows are replayed chunk by chunk, each with the state that the chunks before leave.
    """
    valid = F.col("valid")
    changes = {flag: F.when(valid, effect(rules, flag, F.col("command"), F.col("cmd_line"))) for flag in rules.flags}
    replayed = ordered(log, ["session_id"], ["seq"], last={**changes, "prev": F.when(valid, F.col("command"))}, split_over=split_over)
    return replayed.withColumns({flag: F.coalesce(flag, F.lit(False)) for flag in rules.flags})


def state_warnings(rules: StateRules, command: Column) -> Column:
    """A3: messages for a command that finds flags unset."""
    found = []
    for name, flags, message in rules.warn:
        unset = command == name
        for flag in flags:
            unset = unset & ~F.col(flag)
        found.append(F.when(unset, F.lit(message)))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def transition_advice(replayed: DataFrame, prob: DataFrame, top: int = 3) -> DataFrame:
    """Adds ``prob``, ``rare`` (a warning) and ``suggestion``.

    The model has at most one row for each pair of commands; Spark broadcasts it if it finds it small.
    """
    rank = F.row_number().over(Window.partitionBy("from").orderBy(F.desc("prob"), "to"))
    best = (
        prob.withColumn("rank", rank).filter(F.col("rank") <= top)
        .groupBy(F.col("from").alias("prev")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "to"))), lambda x: x["to"]), ", ").alias("common"))
    )
    joined = replayed.join(prob.select(F.col("from").alias("prev"), F.col("to").alias("command"), "prob"), ["prev", "command"], "left").join(best, "prev", "left")
    percent = F.format_string("%.0f%%", F.bround(F.col("prob") * 100))
    return joined.withColumns({
        "rare": F.when(F.col("prob") < RARE, F.concat(F.lit("'"), F.col("command"), F.lit("' after '"), F.col("prev"), F.lit("' is rare in typical flows ("), percent, F.lit(")"))),
        "suggestion": F.when(F.col("prob").isNull() & F.col("common").isNotNull(), F.concat(F.lit("'"), F.col("command"), F.lit("' is uncommon after '"), F.col("prev"), F.lit("'. Common next: "), F.col("common"))),
    })


def advice_of(replayed: DataFrame, prob: DataFrame, rules: StateRules = DEFAULT_RULES) -> DataFrame:
    """A3, A5, A6 for rows that carry the state before them: session_id, seq, command, valid, warnings, suggestions."""
    done = transition_advice(replayed, prob)
    none = F.array().cast("array<string>")
    return done.select(
        "session_id", "seq", "command", "valid",
        F.when(F.col("exists"), F.array_compact(F.concat(state_warnings(rules, F.col("command")), F.array("rare")))).otherwise(none).alias("warnings"),
        F.when(F.col("exists"), F.array_compact(F.array("suggestion"))).otherwise(none).alias("suggestions"),
    )


def advise(log: DataFrame, prob: DataFrame, rules: StateRules = DEFAULT_RULES, split_over: int | None = SPLIT_OVER) -> DataFrame:
    """One row per log row: session_id, seq, command, valid, warnings, suggestions.

    ``log`` has (session_id, seq, command, cmd_line, valid, exists); a command that doesn't exist gets no advice.
    """
    return advice_of(replay(log, rules, split_over), prob, rules)


def advice_report(report: Column, warnings: Column, suggestions: Column) -> Column:
    """V28 at level 4: a line's report with the session's warnings and suggestions below it."""
    told = F.concat(F.transform(warnings, lambda w: F.concat(F.lit("  warning L4: "), w)), F.transform(suggestions, lambda x: F.concat(F.lit("  suggestion L4: "), x)))
    return F.concat_ws("\n", report, told)


def final_state(log: DataFrame, rules: StateRules = DEFAULT_RULES) -> DataFrame:
    """One row per session: its flags and its last valid command after the whole log; partial aggregates, no window."""
    last = {
        flag: F.coalesce(F.max_by(e := effect(rules, flag, F.col("command"), F.col("cmd_line")), F.when(F.col("valid") & e.isNotNull(), F.col("seq"))), F.lit(False))
        for flag in rules.flags
    }
    prev = F.max_by("command", F.when(F.col("valid"), F.col("seq"))).alias("prev")
    return log.groupBy("session_id").agg(*[c.alias(k) for k, c in last.items()], prev)
