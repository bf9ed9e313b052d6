"""Mining jobs on the given tables: scripts made of documents, sessions of events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cmdspark.operators import advice, mining

#: The small catalogue of words that count as commands in the scripts made of documents.
WORDS = ["the", "of", "and", "to", "in", "de", "la", "le", "der", "die", "und", "el", "los", "que"]
WORD_NOISE = "^(of|und|que)$"
EVENT_NOISE = "^error$"
SESSION, ORDER = ["user_id"], ["ts", "event_id"]
#: Rows from which the jobs on long sessions and scripts cut them, few enough that those of the given tables are cut.
LONG = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scripts: a paragraph is a block, a sentence a line, a comma continues it; some lines get a prompt, a comment sign or a foreign keyword."""
    text = F.col("text")
    for old, new in (("\n", "\n\n"), (". ", ".\n"), (", ", ", \\\n"), ("\nThe ", "\ntmax> The "), ("\nOf ", "\n# Of "), ("\nA ", "\nset a ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("script_id"), text.alias("text"))


def event_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("command"))


def t1_blocks(spark, sf_dir):
    return mining.blocks(scripts(spark, sf_dir)).select("script_id", "block_no", F.length("block").alias("chars"), F.md5("block").alias("block_md5"))


def script_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scripts' lines, nine tenths of the documents one after the other in one script, which no task could take at scale."""
    whole = scripts(spark, sf_dir).select("script_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    script = F.when(F.col("script_id") % 10 == 0, F.col("script_id")).otherwise(F.lit(-1))
    return whole.select(script.alias("script_id"), F.struct(F.col("script_id").alias("doc_id"), F.col("at")).alias("line_no"), "line")


def t1_line_blocks(spark, sf_dir):
    """T1, T2 on a table of lines: blocks by the number of blank lines before them, with their lines and characters."""
    found = mining.blocks_of_lines(script_lines(spark, sf_dir), split_over=LONG)
    return found.groupBy("script_id", "block_no").agg(F.count(F.lit(1)).alias("lines"), (F.sum(F.length("line") + 1) - 1).alias("chars"), F.min("line_no.doc_id").alias("first_doc"))


def t3_logical_lines(spark, sf_dir):
    return mining.logical_lines(mining.blocks(scripts(spark, sf_dir))).select("script_id", "block_no", "line_no", F.md5("line").alias("line_md5"))


def t4_clean_lines(spark, sf_dir):
    lines = mining.clean_lines(mining.logical_lines(mining.blocks(scripts(spark, sf_dir))))
    return lines.select("script_id", "block_no", "line_no", F.md5("line").alias("line_md5"))


def t8_sequences(spark, sf_dir):
    return mining.mine(scripts(spark, sf_dir), WORDS)


def t7_catalogue_match(spark, sf_dir):
    """T7 with the catalogue as a table."""
    return mining.mine(scripts(spark, sf_dir), spark.createDataFrame([(w,) for w in WORDS], "command string"))


def t11_frequency(spark, sf_dir):
    return mining.command_frequency(mining.mine(scripts(spark, sf_dir), WORDS))


def t13_transitions(spark, sf_dir):
    return mining.transitions(mining.mine(scripts(spark, sf_dir), WORDS), ["script_id", "block_no"], ["pos"], noise=WORD_NOISE, split_over=None)


def t14_trigrams(spark, sf_dir):
    top = mining.trigrams(mining.mine(scripts(spark, sf_dir), WORDS), ["script_id", "block_no"], ["pos"], split_over=None)
    return top.select(F.array_join("sequence", " ").alias("sequence"), "count")


def t15_stats(spark, sf_dir):
    return mining.corpus_stats(mining.mine(scripts(spark, sf_dir), WORDS), ["script_id", "block_no"])


def t11_event_frequency(spark, sf_dir):
    return mining.command_frequency(event_sequence(spark, sf_dir))


def t13_event_transitions(spark, sf_dir):
    return mining.transitions(event_sequence(spark, sf_dir), SESSION, ORDER, noise=EVENT_NOISE)


def t14_event_trigrams(spark, sf_dir):
    counts = mining.trigrams(event_sequence(spark, sf_dir), SESSION, ORDER, k=None)
    return counts.select(F.array_join("sequence", " ").alias("sequence"), "count")


def t15_event_stats(spark, sf_dir):
    return mining.corpus_stats(event_sequence(spark, sf_dir), SESSION)


def t16_top_transitions(spark, sf_dir):
    return mining.top_k(t13_event_transitions(spark, sf_dir), 5, "from", "to")


def long_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with nine of ten users as one session."""
    return event_sequence(spark, sf_dir).withColumn("user_id", F.when(F.col("user_id") % 10 == 0, F.col("user_id")).otherwise(F.lit(-1)))


def t8_long_sequences(spark, sf_dir):
    """T8 in long sessions: each event's place in its session."""
    events = long_sequence(spark, sf_dir).select(F.lit(0).alias("script_id"), F.col("user_id").alias("block_no"), F.struct("ts", "event_id").alias("line_no"), "command")
    return mining.sequences(events, split_over=LONG).select("block_no", "pos", "command")


def t13_long_transitions(spark, sf_dir):
    return mining.transitions(long_sequence(spark, sf_dir), SESSION, ORDER, noise=EVENT_NOISE, split_over=LONG)


def t14_long_trigrams(spark, sf_dir):
    counts = mining.trigrams(long_sequence(spark, sf_dir), SESSION, ORDER, k=10, split_over=LONG)
    return counts.select(F.array_join("sequence", " ").alias("sequence"), "count")


def t13_role_transitions(spark, sf_dir):
    return mining.transitions(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role"], command="role")


def a1_transition_probability(spark, sf_dir):
    return advice.transition_probability(t13_event_transitions(spark, sf_dir))


QUERIES = {f.__name__: f for f in (t1_blocks, t1_line_blocks, t3_logical_lines, t4_clean_lines, t7_catalogue_match, t8_sequences, t11_frequency, t13_transitions, t14_trigrams, t15_stats, t11_event_frequency, t13_event_transitions, t14_event_trigrams, t15_event_stats, t16_top_transitions, t8_long_sequences, t13_long_transitions, t14_long_trigrams, t13_role_transitions, a1_transition_probability)}

_BLOCKS = r"""
WITH s0 AS (SELECT doc_id AS script_id, replace(replace(replace(text, chr(10), chr(10) || chr(10)), '. ', '.' || chr(10)), ', ', ', \' || chr(10)) AS x FROM documents),
s1 AS (SELECT script_id, replace(replace(replace(x, chr(10) || 'The ', chr(10) || 'tmax> The '), chr(10) || 'Of ', chr(10) || '# Of '), chr(10) || 'A ', chr(10) || 'set a ') AS x FROM s0),
s2 AS (SELECT script_id, regexp_split_to_array(x, '\n\s*\n') AS parts FROM s1),
s3 AS (SELECT script_id, parts, unnest(range(len(parts))) AS block_no FROM s2),
blocks AS (SELECT * FROM (SELECT script_id, block_no::INT AS block_no, regexp_replace(parts[block_no + 1], '^\s+|\s+$', '', 'g') AS block FROM s3) WHERE length(block) >= 20)
"""
_LINES = _BLOCKS + r""",
l0 AS (SELECT script_id, block_no, string_split(regexp_replace(block, '\\[^\S\n]*(\n|$)', ' ', 'g'), chr(10)) AS parts FROM blocks),
l1 AS (SELECT script_id, block_no, parts, unnest(range(len(parts))) AS line_no FROM l0),
lines AS (SELECT * FROM (SELECT script_id, block_no, line_no::INT AS line_no, regexp_replace(parts[line_no + 1], '^\s+|\s+$', '', 'g') AS line FROM l1) WHERE line <> '')
"""
_CLEAN = _LINES + r""",
clean AS (SELECT script_id, block_no, line_no, regexp_replace(line, '^(TEST-T>|tmax|>)\s*', '') AS line FROM lines
          WHERE NOT regexp_matches(line, '^(#|//|;)')
            AND NOT regexp_matches(line, '(?i)^(module|wire|assign|always|initial|set\s+[a-z]|setenv|bsub|qsub|Command:|vcs)'))
"""
_SEQ = _CLEAN + f""",
m AS (SELECT script_id, block_no, line_no, list_filter(list_transform(regexp_split_to_array(line, '\\s+')[1:3], lambda w: lower(w)), lambda w: list_contains({WORDS!r}, w))[1] AS command FROM clean),
seq AS (SELECT script_id, block_no, (row_number() OVER (PARTITION BY script_id, block_no ORDER BY line_no) - 1)::INT AS pos, command FROM m WHERE command IS NOT NULL)
"""
_PAIRS = """p AS (SELECT {cmd} AS a, lead({cmd}) OVER (PARTITION BY {part} ORDER BY {ord}) AS b FROM {src}),
t AS (SELECT a AS "from", b AS "to", count(*) AS "count" FROM p WHERE b IS NOT NULL AND NOT regexp_matches(a, '{noise}') AND NOT regexp_matches(b, '{noise}') GROUP BY 1, 2)
"""
_THREE = """p AS (SELECT {cmd} AS a, lead({cmd}) OVER w AS b, lead({cmd}, 2) OVER w AS c, {place} AS place FROM {src} WINDOW w AS (PARTITION BY {part} ORDER BY {ord})),
t AS (SELECT a || ' ' || b || ' ' || c AS sequence, count(*) AS "count", min(place) AS place FROM p WHERE c IS NOT NULL GROUP BY 1)
"""
_STATS = """SELECT (SELECT count(*) FROM (SELECT DISTINCT {part} FROM {src})) AS scripts_parsed, count(*) AS total_commands, count(DISTINCT {cmd}) AS unique_commands,
       coalesce(round(count(*)::DOUBLE / nullif((SELECT count(*) FROM (SELECT DISTINCT {part} FROM {src})), 0), 2), 0.0) AS avg_script_length FROM {src}"""
_EVENT = {"cmd": "event_type", "part": "user_id", "ord": "ts, event_id", "src": "events", "noise": EVENT_NOISE, "place": "{'u': user_id, 't': ts, 'e': event_id}"}
_LONG = {**_EVENT, "src": "(SELECT * REPLACE (CASE WHEN user_id % 10 = 0 THEN user_id ELSE -1 END AS user_id) FROM events)"}
_DOC = {"cmd": "command", "part": "script_id, block_no", "ord": "pos", "src": "seq", "noise": WORD_NOISE, "place": "{'s': script_id, 'b': block_no, 'p': pos}"}

SQL = {
    "t1_blocks": _BLOCKS + "SELECT script_id, block_no, length(block) AS chars, md5(block) AS block_md5 FROM blocks",
    "t1_line_blocks": _BLOCKS
    + r""",
b0 AS (SELECT script_id AS doc_id, CASE WHEN script_id % 10 = 0 THEN script_id ELSE -1 END AS script_id, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS line_at FROM s1),
b1 AS (SELECT *, regexp_full_match(line, '\s*') AS blank, sum(regexp_full_match(line, '\s*')::INT) OVER (PARTITION BY script_id ORDER BY doc_id, line_at) AS block_no FROM b0)
SELECT script_id, block_no::BIGINT AS block_no, count(*) AS lines, (sum(length(line) + 1) - 1)::BIGINT AS chars, min(doc_id) AS first_doc FROM b1 WHERE NOT blank GROUP BY 1, 2 HAVING sum(length(line) + 1) - 1 >= 20""",
    "t3_logical_lines": _LINES + "SELECT script_id, block_no, line_no, md5(line) AS line_md5 FROM lines",
    "t4_clean_lines": _CLEAN + "SELECT script_id, block_no, line_no, md5(line) AS line_md5 FROM clean",
    "t7_catalogue_match": _SEQ + "SELECT * FROM seq",
    "t8_sequences": _SEQ + "SELECT * FROM seq",
    "t11_frequency": _SEQ + 'SELECT command, count(*) AS "count" FROM seq GROUP BY command',
    "t13_transitions": _SEQ + "," + _PAIRS.format(**_DOC) + "SELECT * FROM t",
    "t14_trigrams": _SEQ + "," + _THREE.format(**_DOC) + 'SELECT sequence, "count" FROM t ORDER BY "count" DESC, place LIMIT 30',
    "t15_stats": _SEQ + _STATS.format(**_DOC),
    "t11_event_frequency": 'SELECT event_type AS command, count(*) AS "count" FROM events GROUP BY 1',
    "t13_event_transitions": "WITH " + _PAIRS.format(**_EVENT) + "SELECT * FROM t",
    "t14_event_trigrams": "WITH " + _THREE.format(**_EVENT) + 'SELECT sequence, "count" FROM t',
    "t15_event_stats": _STATS.format(**_EVENT),
    "t16_top_transitions": "WITH " + _PAIRS.format(**_EVENT) + 'SELECT * FROM t ORDER BY "count" DESC, "from", "to" LIMIT 5',
    "t8_long_sequences": "SELECT user_id AS block_no, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS pos, event_type AS command FROM " + _LONG["src"],
    "t13_long_transitions": "WITH " + _PAIRS.format(**_LONG) + "SELECT * FROM t",
    "t14_long_trigrams": "WITH " + _THREE.format(**_LONG) + 'SELECT sequence, "count" FROM t ORDER BY "count" DESC, place LIMIT 10',
    "t13_role_transitions": "WITH " + _PAIRS.format(cmd="role", part="conv_id", ord="turn, role", src="conversations", noise=mining.NOISE) + "SELECT * FROM t",
    "a1_transition_probability": "WITH " + _PAIRS.format(**_EVENT) + 'SELECT *, "count" / sum("count") OVER (PARTITION BY "from") AS prob FROM t',
}
