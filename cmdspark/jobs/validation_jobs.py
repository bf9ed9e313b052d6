"""Validation jobs: command lines made of events against a small catalogue, and rule tables of syntaxes made of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cmdspark.operators import mining, rules, validation
from cmdspark.operators.cleaning import clean

from .mining_jobs import table

#: (command, category, syntax, options)
CATALOGUE = [
    ("view", "read", "view -k value [-area {x y}] [-all | -none] [-verbose]", ["-k", "-area", "-all", "-none", "-verbose"]),
    ("click", "act", "click -k value [-mode <fast | slow>] [-verbose]", ["-k", "-mode", "-verbose"]),
    ("purchase", "act", "purchase <card | cash> -k value [-verbose]", ["-k", "-verbose"]),
    ("signup", "act", "signup", []),
    ("error", "state", "", ["-k"]),
]
#: (command, flag, datatype, min, max, choices, block_size, block_types)
TYPE_RULES = [
    ("view", "-k", "int", 5.0, 90.0, None, None, None),
    ("click", "-k", "int", 10.0, None, None, None, None),
    ("click", "-mode", "enum", None, None, ["fast"], None, None),
    ("view", "-area", None, None, None, None, 2, ["int", "string"]),
    ("signup", "-k", "int", 50.0, None, None, None, None),
]
_TAIL = [" -k 3", " -bad 1", " -area {x y}", " -mode=fast", " stray", " -verbose", " -mode slow", " -mode odd", " -all -none", " -area {}", "", " -verbose 1"]


def catalogue(spark: SparkSession) -> DataFrame:
    ruled = rules.with_rules(spark.createDataFrame(CATALOGUE, "command string, category string, syntax string, options array<string>"))
    return rules.overlay_types(ruled, spark.createDataFrame(TYPE_RULES, rules.TYPE_RULE))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, session_id, cmd_line): each event as a command line; its number decides which mistakes it has."""
    e = F.col("event_id")
    tail = F.element_at(F.array(*[F.lit(t) for t in _TAIL]), (e % 12 + 1).cast("int"))
    command = F.when(e % 17 == 0, F.substring("event_type", 2, 99)).otherwise(F.col("event_type"))
    middle = F.when(e % 23 < 3, F.lit(" card")).when(e % 23 == 3, F.lit(" coin")).otherwise(F.lit(""))
    glue = F.when(e % 19 == 0, F.lit("-k ")).otherwise(F.lit(" -k "))
    line = F.concat(command, middle, glue, F.get_json_object("props", "$.k"), tail)
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("session_id"), line.alias("cmd_line"))


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.validate(lines(spark, sf_dir), catalogue(spark))


def _codes(column) -> F.Column:
    return F.array_join(F.array_sort(F.transform(column, lambda f: F.concat(f["severity"], F.lit(":"), f["code"], F.coalesce(F.concat(F.lit(":"), f["subject"]), F.lit(""))))), ",")


def n_clean_lines(spark, sf_dir):
    known = F.when(F.col("cmd_line").startswith("view"), F.array(*[F.lit(x) for x in CATALOGUE[0][3]]))
    return lines(spark, sf_dir).select("event_id", clean(F.col("cmd_line"), known).alias("clean_line"))


def t9_line_flags(spark, sf_dir):
    flagged = mining.line_flags(lines(spark, sf_dir).withColumnRenamed("cmd_line", "line"))
    return flagged.select("event_id", F.array_join(F.array_sort("flags"), " ").alias("flags"))


def t10_flag_usage(spark, sf_dir):
    named = mining.match_commands(lines(spark, sf_dir).withColumnRenamed("cmd_line", "line"), [c[0] for c in CATALOGUE])
    return mining.flag_usage(named)


def v1_tokens(spark, sf_dir):
    parsed = validation.split_line(lines(spark, sf_dir))
    return parsed.select("event_id", "command", F.array_join("flags", " ").alias("flags"), F.array_join("positionals", " ").alias("positionals"))


def v10_structure(spark, sf_dir):
    parsed = validation.split_line(lines(spark, sf_dir)).select("event_id", F.posexplode("items").alias("pos", "i"))
    return parsed.select("event_id", "pos", "i.kind", "i.name", F.array_join("i.args", " ").alias("args"))


def v3_level1(spark, sf_dir):
    return validated(spark, sf_dir).select("cmd_line", "clean_line", "command", "command_exists", "category", "l1_valid", _codes("l1").alias("l1"))


def v9_script_level1(spark, sf_dir):
    script = lines(spark, sf_dir).select(F.col("session_id").alias("script_id"), F.col("event_id").alias("line_no"), F.col("cmd_line").alias("line"))
    done = validation.validate_scripts(script, catalogue(spark))
    return done.select("script_id", "line_no", "command_exists", "l1_valid", F.array_join("unknown_options", " ").alias("unknown"))


def v11_level2(spark, sf_dir):
    return validated(spark, sf_dir).select("cmd_line", "l2_valid", _codes("l2").alias("l2"))


def v22_level3(spark, sf_dir):
    return validated(spark, sf_dir).select("cmd_line", "valid", _codes("l3").alias("l3"))


def v28_findings(spark, sf_dir):
    found = validation.findings(validated(spark, sf_dir))
    return found.groupBy("level", "severity", "code").agg(F.count(F.lit(1)).alias("lines"))


def v4_suggestions(spark, sf_dir):
    known = catalogue(spark)
    return validation.suggest(validated(spark, sf_dir), known)


def part_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue made of parts: brand, type words as a required choice, size, container and two groups in the syntax; some syntaxes are broken or absent."""
    p = F.col("p_partkey")
    words = F.array_join(F.split(F.lower("p_type"), " "), " | ")
    syntax = F.concat(
        F.lit("part_"), p.cast("string"), F.lit(" <"), words, F.lit("> -size n"), F.when(p % 3 == 0, F.lit(" m")).otherwise(F.lit("")),
        F.lit(" [-box {"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit(" ")), F.lit("}] [-cold | -hot] [-unit <mm | cm>] [<new | used>] [-v]"), F.when(p % 7 == 0, F.lit(" [")).otherwise(F.lit("")),
    )
    return table(spark, sf_dir, "part").select(F.concat(F.lit("part_"), p.cast("string")).alias("command"), F.when(p % 11 == 0, F.lit(None)).otherwise(syntax).alias("syntax"))


def r1_flag_rules(spark, sf_dir):
    return rules.flag_rules(rules.with_rules(part_catalogue(spark, sf_dir))).withColumn("choices", F.array_join("choices", "|"))


def r2_mutex_groups(spark, sf_dir):
    return rules.mutex_groups(rules.with_rules(part_catalogue(spark, sf_dir)))


def r3_positionals(spark, sf_dir):
    return rules.positionals(rules.with_rules(part_catalogue(spark, sf_dir))).withColumn("choices", F.array_join("choices", "|"))


def r4_rule_status(spark, sf_dir):
    return rules.with_rules(part_catalogue(spark, sf_dir)).select("command", F.col("rules.status").alias("status"))


QUERIES = {f.__name__: f for f in (t9_line_flags, t10_flag_usage, n_clean_lines, v1_tokens, v10_structure, v3_level1, v9_script_level1, v11_level2, v22_level3, v28_findings, v4_suggestions, r1_flag_rules, r2_mutex_groups, r3_positionals, r4_rule_status)}

_EVENT_LINES = f"""
WITH li AS (SELECT event_id, user_id::VARCHAR AS session_id,
    (CASE WHEN event_id % 17 = 0 THEN substr(event_type, 2) ELSE event_type END) || (CASE WHEN event_id % 23 < 3 THEN ' card' WHEN event_id % 23 = 3 THEN ' coin' ELSE '' END)
    || (CASE WHEN event_id % 19 = 0 THEN '-k ' ELSE ' -k ' END) || json_extract_string(props, '$.k') || {_TAIL!r}[event_id % 12 + 1] AS cmd_line FROM events)
"""
# all lines are clean but for glued flags: no backslash, no white space runs, braces stand alone
_GLUED = r"regexp_replace(cmd_line, '([a-zA-Z_]+)-([a-zA-Z_]+)', '\1 -\2', 'g')"
# blocks as one word, so that splitting at blanks gives the tokens
_TOKENS = """, {dist} tk AS (SELECT {id}, string_split(replace({line}, '{{x y}}', '{{x_y}}'), ' ') AS toks FROM {src}),
u AS (SELECT {id}, toks[1] AS command, unnest(range(2, len(toks) + 1)) AS pos, toks FROM tk),
w AS (SELECT {id}, command, pos::INT AS pos, replace(toks[pos], '{{x_y}}', '{{x y}}') AS tok, sum(CASE WHEN starts_with(toks[pos], '-') THEN 1 ELSE 0 END) OVER (PARTITION BY {id} ORDER BY pos) AS grp FROM u)
"""
_RAW_TOKENS = _TOKENS.format(dist="", id="event_id", line="cmd_line", src="li")
_CLEAN_TOKENS = _TOKENS.format(dist=f"d AS (SELECT DISTINCT cmd_line, {_GLUED} AS clean_line FROM li),", id="cmd_line", line="clean_line", src="d")
_NAMES = "('view', 'read', ['-k', '-area', '-all', '-none', '-verbose']), ('click', 'act', ['-k', '-mode', '-verbose']), ('purchase', 'act', ['-k', '-verbose']), ('signup', 'act', []::VARCHAR[]), ('error', 'state', ['-k'])"
_L1 = _CLEAN_TOKENS + f""",
cat AS (SELECT * FROM (VALUES {_NAMES}) t(command, category, options)),
fl AS (SELECT w.cmd_line, w.command, pos, split_part(tok, '=', 1) AS flag, tok, grp FROM w WHERE starts_with(tok, '-')),
b AS (SELECT d.cmd_line, d.clean_line, tk.toks[1] AS command, cat.command IS NOT NULL AS command_exists, cat.category, cat.options FROM d JOIN tk USING (cmd_line) LEFT JOIN cat ON cat.command = tk.toks[1]),
f1 AS (SELECT cmd_line, 'error:unknown_command:' || command AS f FROM b WHERE NOT command_exists
       UNION ALL SELECT cmd_line, 'warning:duplicate_flag:' || flag FROM fl JOIN b USING (cmd_line) WHERE command_exists GROUP BY cmd_line, flag HAVING count(*) > 1
       UNION ALL SELECT DISTINCT cmd_line, 'error:no_flags_accepted:' || b.command FROM fl JOIN b USING (cmd_line) WHERE command_exists AND len(options) = 0
       UNION ALL SELECT cmd_line, 'error:unknown_flag:' || flag FROM fl JOIN b USING (cmd_line) WHERE command_exists AND NOT list_contains(options, flag)),
g1 AS (SELECT cmd_line, string_agg(f, ',' ORDER BY f) AS l1, bool_or(f LIKE 'error%') AS bad FROM f1 GROUP BY 1),
v1 AS (SELECT b.*, coalesce(l1, '') AS l1, NOT coalesce(bad, false) AS l1_valid FROM b LEFT JOIN g1 USING (cmd_line))
"""
_L2 = _L1 + """,
rl AS (SELECT * FROM (VALUES ('view', '-k', 'value', ''), ('view', '-area', 'block', ''), ('view', '-all', 'boolean', ''), ('view', '-none', 'boolean', ''), ('view', '-verbose', 'boolean', ''),
       ('click', '-k', 'value', ''), ('click', '-mode', 'choice', 'fast|slow'), ('click', '-verbose', 'boolean', ''), ('purchase', '-k', 'value', ''), ('purchase', '-verbose', 'boolean', '')) t(command, flag, type, choices)),
eq AS (SELECT cmd_line, min_by(tok, pos) AS tok FROM w WHERE tok LIKE '-%=%' GROUP BY 1),
ok AS (SELECT * FROM v1 WHERE command_exists AND command <> 'error' AND cmd_line NOT IN (SELECT cmd_line FROM eq)),
us AS (SELECT f.cmd_line, f.command, f.flag, f.pos, count(a.tok) AS n, min_by(a.tok, a.pos) AS arg FROM fl f JOIN ok USING (cmd_line) LEFT JOIN w a ON a.cmd_line = f.cmd_line AND a.grp = f.grp AND a.pos > f.pos GROUP BY 1, 2, 3, 4),
la AS (SELECT * FROM us QUALIFY row_number() OVER (PARTITION BY cmd_line, flag ORDER BY pos DESC) = 1),
ps AS (SELECT w.cmd_line, w.command, tok, row_number() OVER (PARTITION BY w.cmd_line ORDER BY pos) - 1 AS i FROM w JOIN ok USING (cmd_line) WHERE grp = 0),
f2 AS (SELECT eq.cmd_line, 'error:equals_sign:' || tok AS f FROM eq JOIN v1 USING (cmd_line) WHERE command_exists AND command <> 'error'
       UNION ALL SELECT cmd_line, 'warning:duplicate_flag:' || flag FROM us GROUP BY cmd_line, flag HAVING count(*) > 1
       UNION ALL SELECT cmd_line, 'error:' || CASE WHEN type = 'boolean' AND n > 0 THEN 'takes_no_argument' WHEN type <> 'boolean' AND n = 0 THEN 'needs_argument' WHEN type = 'value' AND n <> 1 THEN 'argument_count'
                 WHEN type = 'block' AND trim(arg, '{}') = '' THEN 'empty_block' WHEN type = 'choice' AND NOT list_contains(string_split(choices, '|'), trim(arg, '{}')) THEN 'not_a_choice' END || ':' || flag
                 FROM la JOIN rl USING (command, flag)
       UNION ALL SELECT cmd_line, 'error:mutually_exclusive:-all, -none' FROM la WHERE command = 'view' AND flag IN ('-all', '-none') GROUP BY 1 HAVING count(*) > 1
       UNION ALL SELECT cmd_line, CASE WHEN tok IS NULL THEN 'error:missing_positional:0' WHEN tok NOT IN ('card', 'cash') THEN 'error:bad_positional:' || tok END FROM ok LEFT JOIN (SELECT cmd_line, tok FROM ps WHERE i = 0) USING (cmd_line) WHERE command = 'purchase'
       UNION ALL SELECT cmd_line, 'error:unexpected_positional:' || tok FROM ps WHERE command <> 'purchase' AND tok NOT IN (CASE WHEN command = 'view' THEN '-all' ELSE '' END)),
g2 AS (SELECT cmd_line, string_agg(f, ',' ORDER BY f) AS l2, bool_or(f LIKE 'error%') AS bad FROM f2 WHERE f IS NOT NULL GROUP BY 1),
v2 AS (SELECT v1.*, coalesce(l2, '') AS l2, l1_valid AND NOT coalesce(g2.bad, false) AS l2_valid FROM v1 LEFT JOIN g2 USING (cmd_line))
"""
_L3 = _L2 + """,
al AS (SELECT f.cmd_line, f.command, f.flag, f.pos, CASE WHEN f.tok LIKE '%=%' THEN nullif(split_part(f.tok, '=', 2), '') ELSE min_by(a.tok, a.pos) END AS arg
       FROM fl f JOIN v1 USING (cmd_line) LEFT JOIN w a ON a.cmd_line = f.cmd_line AND a.grp = f.grp AND a.pos > f.pos WHERE command_exists GROUP BY 1, 2, 3, 4, f.tok),
nb AS (SELECT *, trim(arg, '{}') AS v, try_cast(trim(arg, '{}') AS INT) AS i FROM al WHERE arg IS NOT NULL),
f3 AS (SELECT cmd_line, CASE WHEN i IS NULL THEN 'error:wrong_type:-k' WHEN command = 'view' AND i < 5 OR command = 'click' AND i < 10 THEN 'error:below_min:-k' WHEN command = 'view' AND i > 90 THEN 'error:above_max:-k' END AS f
         FROM nb WHERE flag = '-k' AND command IN ('view', 'click')
       UNION ALL SELECT cmd_line, 'error:not_in_enum:-mode' FROM nb WHERE command = 'click' AND flag = '-mode' AND v <> 'fast'
       UNION ALL SELECT cmd_line, CASE WHEN arg = '{}' THEN 'error:block_size:-area' ELSE 'error:block_type:-area[0]' END FROM nb WHERE command = 'view' AND flag = '-area'),
g3 AS (SELECT cmd_line, string_agg(f, ',' ORDER BY f) AS l3 FROM f3 WHERE f IS NOT NULL GROUP BY 1),
v3 AS (SELECT v2.*, coalesce(l3, '') AS l3, l2_valid AND l3 IS NULL AS valid FROM v2 LEFT JOIN g3 USING (cmd_line))
"""
#: The lines and their verdicts at three levels, for other jobs: li and v3.
VALIDATED_SQL = _EVENT_LINES + _L3
_PARTS = """
WITH p AS (SELECT p_partkey AS k, 'part_' || p_partkey AS command, array_to_string(string_split(lower(p_type), ' '), '|') AS choices, p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AS ok FROM part)
"""
_FLAGS = "list_distinct(regexp_extract_all(cmd_line, '-([a-zA-Z_][a-zA-Z0-9_]*)', 1))"
SQL = {
    "t9_line_flags": _EVENT_LINES + f"SELECT event_id, array_to_string(list_sort({_FLAGS}), ' ') AS flags FROM li",
    "t10_flag_usage": _EVENT_LINES
    + f"""SELECT DISTINCT command, unnest({_FLAGS}) AS flag, 1 AS present FROM (SELECT cmd_line, list_filter(string_split(cmd_line, ' ')[1:3], lambda w: lower(w) IN ('view', 'click', 'purchase', 'signup', 'error'))[1] AS command FROM li)
          WHERE command IS NOT NULL""",
    "n_clean_lines": _EVENT_LINES + f"SELECT event_id, {_GLUED} AS clean_line FROM li",
    "v1_tokens": _EVENT_LINES + _RAW_TOKENS
    + """SELECT event_id, command, coalesce(string_agg(CASE WHEN starts_with(tok, '-') THEN split_part(tok, '=', 1) END, ' ' ORDER BY pos), '') AS flags,
         coalesce(string_agg(CASE WHEN NOT starts_with(tok, '-') THEN tok END, ' ' ORDER BY pos), '') AS positionals FROM w GROUP BY 1, 2""",
    "v3_level1": _EVENT_LINES + _L1 + "SELECT cmd_line, clean_line, command, command_exists, category, l1_valid, l1 FROM v1",
    "v11_level2": _EVENT_LINES + _L2 + "SELECT cmd_line, l2_valid, l2 FROM v2",
    "v22_level3": _EVENT_LINES + _L3 + "SELECT cmd_line, valid, l3 FROM v3",
    "v28_findings": _EVENT_LINES + _L3
    + """SELECT level::INT AS level, split_part(f, ':', 1) AS severity, split_part(f, ':', 2) AS code, count(*) AS lines
         FROM (SELECT 1 AS level, f FROM f1 UNION ALL SELECT 2, f FROM f2 UNION ALL SELECT 3, f FROM f3) WHERE f IS NOT NULL GROUP BY 1, 2, 3""",
    "v4_suggestions": _EVENT_LINES + _L1
    + """,
near(command, flag, suggestion) AS (VALUES ('iew', NULL, 'view'), ('lick', NULL, 'click'), ('urchase', NULL, 'purchase'), ('ignup', NULL, 'signup'), ('rror', NULL, 'error'), ('view', '-mode', '-none'), ('click', '-none', '-mode'))
SELECT DISTINCT near.* FROM near JOIN v1 ON v1.command = near.command LEFT JOIN fl ON fl.cmd_line = v1.cmd_line WHERE near.flag IS NULL OR near.flag = fl.flag""",
    "v9_script_level1": _EVENT_LINES + _RAW_TOKENS
    + f""",
cat AS (SELECT * FROM (VALUES {_NAMES}) t(command, category, options)),
un AS (SELECT event_id, string_agg(split_part(tok, '=', 1), ' ' ORDER BY pos) AS unknown FROM w JOIN cat USING (command) WHERE starts_with(tok, '-') AND NOT list_contains(options, split_part(tok, '=', 1)) GROUP BY 1)
SELECT session_id AS script_id, event_id AS line_no, cat.command IS NOT NULL AS command_exists, cat.command IS NOT NULL AND unknown IS NULL AS l1_valid, coalesce(unknown, '') AS unknown
FROM li JOIN tk USING (event_id) LEFT JOIN cat ON cat.command = toks[1] LEFT JOIN un USING (event_id)""",
    "v10_structure": _EVENT_LINES + _RAW_TOKENS
    + """,
f AS (SELECT event_id, grp, pos, split_part(tok, '=', 1) AS name, contains(tok, '=') AS eq, split_part(tok, '=', 2) AS val FROM w WHERE starts_with(tok, '-')),
a AS (SELECT w.event_id, w.grp, string_agg(tok, ' ' ORDER BY w.pos) AS args FROM w JOIN f ON f.event_id = w.event_id AND f.grp = w.grp AND w.pos > f.pos AND NOT eq GROUP BY 1, 2),
it AS (SELECT event_id, 1 AS spot, 'cmd' AS kind, toks[1] AS name, '' AS args FROM tk
       UNION ALL SELECT event_id, pos, CASE WHEN eq OR args IS NOT NULL THEN 'flag_arg' ELSE 'flag' END, name, CASE WHEN eq THEN val ELSE coalesce(args, '') END FROM f LEFT JOIN a USING (event_id, grp)
       UNION ALL SELECT w.event_id, w.pos, 'positional', tok, '' FROM w LEFT JOIN f ON f.event_id = w.event_id AND f.grp = w.grp WHERE w.grp = 0 OR eq AND w.pos > f.pos)
SELECT event_id, (row_number() OVER (PARTITION BY event_id ORDER BY spot) - 1)::INT AS pos, kind, name, args FROM it""",
    "r1_flag_rules": _PARTS
    + """SELECT command, f.flag, f.ord::INT AS ord, f.type, (CASE WHEN f.flag = '-size' AND k % 3 = 0 THEN 2 ELSE f.n END)::INT AS n_args, f.choices
         FROM p, (VALUES ('-size', 0, 'value', 1, ''), ('-box', 1, 'block', 1, ''), ('-cold', 2, 'boolean', 0, ''), ('-hot', 3, 'boolean', 0, ''), ('-unit', 4, 'choice', 1, 'mm|cm'), ('-v', 5, 'boolean', 0, '')) f(flag, ord, type, n, choices) WHERE ok""",
    "r2_mutex_groups": _PARTS + "SELECT command, m.g::INT AS group_no, m.member FROM p, (VALUES (0, '-cold'), (0, '-hot'), (1, 'new'), (1, 'used')) m(g, member) WHERE ok",
    "r3_positionals": _PARTS + "SELECT command, 0::INT AS position, choices FROM p WHERE ok",
    "r4_rule_status": _PARTS + "SELECT command, CASE WHEN k % 11 = 0 THEN 'none' WHEN k % 7 = 0 THEN 'failed' ELSE 'ok' END AS status FROM p",
}
