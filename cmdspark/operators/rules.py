"""Rule tables of a command catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cmdspark.functions.batches import append_column
from cmdspark.functions.syntax import RULES, rules_of

TYPE_RULE = "command string, flag string, datatype string, min double, max double, choices array<string>, block_size int, block_types array<string>"


def with_rules(catalogue: DataFrame) -> DataFrame:
    """The catalogue with a column ``rules``, a struct of flags, mutex, positionals and status.

    Rows are small and each is much work, while a file of many may be one task's: they are dealt to all tasks.
    """
    spark = catalogue.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return append_column(catalogue.repartition(tasks), "rules", RULES, rules_of, "syntax")


#: How an option's line begins in a section text, and a flag in a syntax.
OPTION_LINE, SYNTAX_FLAG = r"(?m)^(-[A-Za-z_][A-Za-z0-9_]*)", r"(?<![^\s\[\]{}<>|])(-[A-Za-z_][A-Za-z0-9_]*)"


def catalogue_of_sections(sections: DataFrame, flags_from: str = "options") -> DataFrame:
    """A catalogue (command, category, syntax, options) of section texts (command, syntax, options text, ...).

    ``flags_from`` "options" takes a command's flags from its options text, which pages often keep
    incomplete; "options+syntax" adds those of its syntax. A section text has no category.
    """
    if flags_from not in ("options", "options+syntax"):
        raise ValueError(f"flags come from options or options+syntax, not from {flags_from}")
    flags = F.regexp_extract_all(F.coalesce("options", F.lit("")), F.lit(OPTION_LINE), F.lit(1))
    if flags_from == "options+syntax":
        flags = F.concat(flags, F.regexp_extract_all(F.coalesce("syntax", F.lit("")), F.lit(SYNTAX_FLAG), F.lit(1)))
    known = sections.filter(F.coalesce("command", F.lit("")) != "")
    return known.select("command", F.lit(None).cast("string").alias("category"), F.when(F.col("syntax") != "", F.col("syntax")).alias("syntax"), F.array_distinct(flags).alias("options"))


def flag_rules(ruled: DataFrame) -> DataFrame:
    """R1 as a table: (command, flag, ord, type, n_args, choices)."""
    return ruled.select("command", F.explode("rules.flags").alias("r")).select("command", "r.*")


def mutex_groups(ruled: DataFrame) -> DataFrame:
    """R2 as a table: (command, group_no, member)."""
    groups = ruled.select("command", F.posexplode("rules.mutex").alias("group_no", "members"))
    return groups.select("command", "group_no", F.explode("members").alias("member"))


def positionals(ruled: DataFrame) -> DataFrame:
    """R3 as a table: (command, position, choices)."""
    return ruled.select("command", F.explode("rules.positionals").alias("r")).select("command", "r.*")


def overlay_types(ruled: DataFrame, type_rules: DataFrame) -> DataFrame:
    """Adds ``types``, an array of the command's type rules for flags that its syntax declares."""
    declared = F.transform("rules.flags", lambda r: r["flag"])
    by_command = type_rules.groupBy("command").agg(F.collect_list(F.struct("flag", "datatype", "min", "max", "choices", "block_size", "block_types")).alias("types"))
    joined = ruled.join(by_command, "command", "left")
    empty = F.array().cast(by_command.schema["types"].dataType)
    return joined.withColumn("types", F.coalesce(F.filter("types", lambda t: F.array_contains(declared, t["flag"])), empty))
