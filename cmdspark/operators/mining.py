"""Mining script texts: blocks, logical lines, command sequences, flags, frequencies, transitions, trigrams.

Functions take and return DataFrames and use built-in functions only. A script is a row (script_id,
text); a sequence is ordered rows (session, pos, command), so that nothing is ever collected whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdspark.functions.bloom import bloom_filter, might_contain
from cmdspark.functions.storage import materialize

from .cleaning import clean
from .scan import SPLIT_OVER, ordered

#: Beginnings of lines that are comments and of lines that belong to other tools, prompts, commands that count as noise, flags.
COMMENT = r"^(#|//|;)"
FOREIGN = r"(?i)^(module|wire|assign|always|initial|set\s+[A-Z]|setenv|bsub|qsub|Command:|vcs)"
PROMPT = r"^(?:TEST-T>|tmax|>)\s*"
NOISE = r"^(report_|get_|man_)"
FLAG = r"-([a-zA-Z_][a-zA-Z0-9_]*)"
MIN_BLOCK = 20


#: What counts as white space at the ends of a line.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Unicode-aware trim, without a pattern: it looks at the ends only."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def blocks(scripts: DataFrame, min_chars: int = MIN_BLOCK) -> DataFrame:
    """(script_id, block_no, block) cut at blank lines, stripped, short ones dropped; numbers count all blocks from 0."""
    text = F.regexp_replace("text", "\r\n", "\n")
    return (
        scripts.select("script_id", F.posexplode(F.split(text, r"\n(?U)\s*\n")).alias("block_no", "block"))
        .withColumn("block", strip(F.col("block")))
        .filter(F.length("block") >= min_chars)
    )


def blocks_of_lines(lines: DataFrame, min_chars: int = MIN_BLOCK, split_over: int | None = SPLIT_OVER) -> DataFrame:
    """T1, T2 for scripts kept as lines (script_id, line_no, line): a running count of blank lines numbers the blocks.

    For scripts too large for one row or one task: a long script is counted chunk by chunk (``scan.ordered``).
    Block numbers differ from those of ``blocks`` where blank lines follow each other. Returns (script_id,
    block_no, line_no, line) of blocks with ``min_chars`` characters.
    """
    blank = F.col("line").rlike(r"(?U)^\s*$")
    numbered = ordered(lines, ["script_id"], ["line_no"], running={"block_no": blank.cast("int")}, split_over=split_over).filter(~blank)
    large = numbered.groupBy("script_id", "block_no").agg((F.sum(F.length("line") + 1) - 1).alias("size")).filter(F.col("size") >= min_chars)
    return numbered.join(large.select(F.col("script_id").alias("own"), F.col("block_no").alias("no")), F.col("script_id").eqNullSafe(F.col("own")) & (F.col("block_no") == F.col("no")), "left_semi")


def logical_lines(parts: DataFrame) -> DataFrame:
    """(script_id, block_no, line_no, line); a line that ends in a backslash goes on in the next, blank lines are dropped."""
    joined = F.regexp_replace("block", r"\\[^\S\n]*(\n|$)", " ")
    lines = parts.select("script_id", "block_no", F.posexplode(F.split(joined, "\n")).alias("line_no", "line"))
    return lines.withColumn("line", strip(F.col("line"))).filter(F.col("line") != "")


def clean_lines(lines: DataFrame) -> DataFrame:
    """Without comments and lines of other tools, one prompt cut off."""
    own = lines.filter(~F.col("line").rlike(COMMENT) & ~F.col("line").rlike(FOREIGN))
    return own.withColumn("line", F.regexp_replace("line", PROMPT, ""))


def match_commands(lines: DataFrame, commands: list[str] | DataFrame) -> DataFrame:
    """Lines with their command, the first of their first three words whose lower case is known; others are dropped.

    A list of names becomes a constant of the plan; a table (command) may have any size, see
    ``match_catalogue``. Every line stays a row of its own.
    """
    words = F.slice(F.split(F.col("line"), r"(?U)\s+", 4), 1, 3)  # the rest of a line isn't split
    lower = F.transform(words, F.lower)
    if isinstance(commands, DataFrame):
        return match_catalogue(lines, lower, commands)
    names = F.array(*[F.lit(c) for c in commands])
    found = F.filter(lower, lambda w: F.array_contains(names, w))
    return lines.withColumn("command", F.get(found, F.lit(0))).filter("command is not null")


def match_catalogue(lines: DataFrame, words: Column, catalogue: DataFrame) -> DataFrame:
    """Lines with the first of their (three) ``words`` that is a command of the catalogue.

    A Bloom filter of the names goes to all tasks and says there which words may be commands: lines without
    any end where they are, before any shuffle. Of the others nearly all have one such word, and one join
    by it decides; where Spark doesn't broadcast the names it splits the words that many lines begin with. Lines
    with several are joined by one after the other.
    """
    known = catalogue.select("command").filter("command is not null").distinct()
    bits, size = bloom_filter(known, "command")
    tried = lines.withColumn("__words", words)
    tried = tried.select(*lines.columns, *[F.get("__words", F.lit(at)).alias(f"__word_{at}") for at in range(3)])
    one, two, three = (F.col(f"__word_{at}") for at in range(3))
    may = [might_contain(F.col("bits"), w, size) for w in (one, two, three)]
    first = F.when(may[0], one).when(may[1], two).when(may[2], three)
    second = F.when(may[0] & may[1], two).when((may[0] | may[1]) & may[2], three)
    third = F.when(may[0] & may[1] & may[2], three)
    asked = tried.crossJoin(F.broadcast(bits)).select(*lines.columns, *[c.alias(f"__try_{k}") for k, c in enumerate((first, second, third))])  # one row
    left = materialize(asked.filter("__try_0 is not null"), "may-be-commands")
    single = left.filter("__try_1 is null").join(known, F.col("__try_0") == F.col("command")).select(*lines.columns, "command")
    several, names = left.filter("__try_1 is not null"), []
    for k in range(3):
        name = known.select(F.col("command").alias(f"__name_{k}"))
        several, names = several.join(name, F.col(f"__try_{k}") == F.col(f"__name_{k}"), "left"), [*names, f"__name_{k}"]
    return single.unionByName(several.withColumn("command", F.coalesce(*names)).filter("command is not null").select(*lines.columns, "command"))


def sequences(lines: DataFrame, split_over: int | None = None) -> DataFrame:
    """(session struct, pos from 0, command) of lines that have a command; a session is a block of a script.

    A block that comes from one text is never long; for blocks of line tables give ``split_over``.
    """
    numbered = ordered(lines, ["script_id", "block_no"], ["line_no"], running={"pos": F.lit(1)}, split_over=split_over)
    return numbered.select("script_id", "block_no", (F.col("pos") - 1).cast("int").alias("pos"), "command")


def line_flags(lines: DataFrame) -> DataFrame:
    """Lines with the array of their distinct flags, dash removed, wherever they stand."""
    return lines.withColumn("flags", F.array_distinct(F.regexp_extract_all("line", F.lit(FLAG), F.lit(1))))


def flag_usage(lines: DataFrame) -> DataFrame:
    """(command, flag, present); each flag of a command once."""
    return line_flags(lines).select("command", F.explode("flags").alias("flag")).distinct().withColumn("present", F.lit(1))


def command_frequency(seq: DataFrame, command: str = "command") -> DataFrame:
    """(command, count)."""
    return seq.groupBy(F.col(command).alias("command")).agg(F.count(F.lit(1)).alias("count"))


def is_noise(command: Column, pattern: str = NOISE) -> Column:
    """T12."""
    return command.rlike(pattern)


def transitions(seq: DataFrame, session: list[str], order: list[str], command: str = "command", noise: str = NOISE, split_over: int | None = SPLIT_OVER) -> DataFrame:
    """(from, to, count) of neighbours in a session of which neither is noise; noise breaks a chain, it isn't bridged.

    Sessions of over ``split_over`` rows are taken chunk by chunk; None says that there are none.
    """
    own = seq.select(*[F.col(c) for c in session], *[F.col(c) for c in order], F.col(command).alias("from"))
    pairs = ordered(own, session, order, following={"to": (F.col("from"), 1)}, split_over=split_over).select("from", "to").filter("to is not null")
    return pairs.filter(~is_noise(F.col("from"), noise) & ~is_noise(F.col("to"), noise)).groupBy("from", "to").agg(F.count(F.lit(1)).alias("count"))


def trigrams(seq: DataFrame, session: list[str], order: list[str], command: str = "command", k: int | None = 30, split_over: int | None = SPLIT_OVER) -> DataFrame:
    """(sequence, count) of three neighbours; the k most frequent, ties by first place (session, order), all if k is None.

    Sessions of over ``split_over`` rows are taken chunk by chunk; None says that there are none.
    """
    own = seq.select(*[F.col(c) for c in session], *[F.col(c) for c in order], F.col(command).alias("first"))
    three = ordered(own, session, order, following={"second": (F.col("first"), 1), "third": (F.col("first"), 2)}, split_over=split_over).filter("third is not null")
    counted = three.groupBy(F.array("first", "second", "third").alias("sequence")).agg(F.count(F.lit(1)).alias("count"), F.min(F.struct(*session, *order)).alias("place"))
    if k is not None:
        counted = counted.orderBy(F.desc("count"), "place").limit(k)
    return counted.select("sequence", "count")


def corpus_stats(seq: DataFrame, session: list[str], command: str = "command") -> DataFrame:
    """One row: scripts_parsed, total_commands, unique_commands, avg_script_length.

    Counted by session and by command first, so that no distinct set is gathered in one task.
    """
    total = seq.groupBy(*session).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("scripts_parsed"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_commands"))
    unique = seq.groupBy(command).agg(F.count(F.lit(1)).alias("n")).agg(F.count(command).alias("unique_commands"))
    mean = F.coalesce(F.round(F.try_divide(F.col("total_commands"), F.col("scripts_parsed")), 2), F.lit(0.0))
    return total.join(unique, F.lit(True)).withColumn("avg_script_length", mean)  # one row each


def top_k(counts: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k rows with the largest count, ties by ``keys``."""
    return counts.orderBy(F.desc("count"), *keys).limit(k)


def mine(scripts: DataFrame, commands: list[str] | DataFrame, cleaned: bool = False) -> DataFrame:
    """(script_id, block_no, pos, command) of scripts; ``cleaned`` has each line cleaned (N1 to N4) before it is matched, so that glued commands count."""
    return sequences(match_commands(script_lines(scripts, cleaned), commands))


def script_lines(scripts: DataFrame, cleaned: bool = False) -> DataFrame:
    """(script_id, block_no, line_no, line) of scripts, ``cleaned`` (N1 to N4) if wanted."""
    lines = clean_lines(logical_lines(blocks(scripts)))
    return lines.withColumn("line", clean(F.col("line"))) if cleaned else lines


def usage_model(lines: DataFrame, commands: list[str] | DataFrame, k: int = 30, noise: str = NOISE, split_over: int | None = SPLIT_OVER) -> dict[str, DataFrame]:
    """All parts of a usage model (meta, frequency, flags, transitions, sequences) of lines (script_id, block_no, line_no, line).

    Lines are matched once and kept as a table, which the parts read.
    """
    matched = materialize(match_commands(lines, commands).select("script_id", "block_no", "line_no", "line", "command"), "matched")
    session, order = ["script_id", "block_no"], ["line_no"]
    return {
        "meta": corpus_stats(matched, session).select("scripts_parsed", "total_commands", "unique_commands", "avg_script_length"),
        "frequency": command_frequency(matched),
        "flags": flag_usage(matched),
        "transitions": transitions(matched, session, order, noise=noise, split_over=split_over),
        "sequences": trigrams(matched, session, order, k=k, split_over=split_over),
    }
