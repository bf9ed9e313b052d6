"""Jobs on what lies in files: pages, scripts, graphs and models written by Spark and read back, and the advisor on a stream of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cmdspark.functions.storage import fresh_path, materialize
from cmdspark.operators import advice, manual, mining, rules, validation
from cmdspark.sources import manuals, models
from cmdspark.streaming.advisor import advise_stream

from . import command_jobs, manual_jobs, mining_jobs, session_jobs, validation_jobs


def s1_page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual pages written one file each, bytes that are no UTF-8 among them, and read back."""
    folder = fresh_path(spark, "pages")
    pages = manual_jobs.manual_pages(spark, sf_dir)
    broken = F.concat(F.encode(F.substring_index("html", "</h1>", 1), "utf-8"), F.unhex(F.lit("FF")), F.encode(F.expr("substr(html, instr(html, '</h1>'))"), "utf-8"))
    manuals.write_files(pages.select(F.substring_index("path", "/", -1).alias("name"), broken.alias("content")), folder)
    return manual.parse_pages(manuals.read_html(spark, folder)).select("command", "category", "title")


def s3_script_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts written as text files, read back whole and mined."""
    folder = fresh_path(spark, "scripts")
    # a blank line after each script ends its last block
    mining_jobs.scripts(spark, sf_dir).select(F.concat("text", F.lit("\n")).alias("value")).write.option("maxRecordsPerFile", 1000).text(folder)
    return mining.command_frequency(mining.mine(manuals.read_scripts(spark, folder), mining_jobs.WORDS))


def s6_section_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as section texts, a folder each, and read back from there; packed, so that most take one block of disk."""
    folder = fresh_path(spark, "sections")
    manuals.write_section_text(manual_jobs.section_records(spark, sf_dir), folder, "gzip")
    return manual_jobs.sections_read(manuals.read_section_folders(spark, folder))


def _graph_rows(records: DataFrame, index: DataFrame) -> DataFrame:
    """The edges of records and the members of categories, each with whether it leads to a command of the graph."""
    known = models.valid_commands(records).select(F.col("command").alias("dst"), F.lit(True).alias("known"))
    members = index.select(F.col("category").alias("src"), F.col("command").alias("dst"), F.lit("category").alias("kind"))
    return manual.edges(records).unionByName(members).join(known, "dst", "left").select("src", "dst", "kind", F.coalesce("known", F.lit(False)).alias("known"))


def s4_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command records and categories written as graph documents in JSON, a line each, and loaded; self edges dropped."""
    path = fresh_path(spark, "graph")
    models.write_graph_json(manual.latest(manual_jobs.records(spark, sf_dir)), path)
    return _graph_rows(models.load_graph_json(spark, path, lines=True), models.load_categories_json(spark, path, lines=True))


def s4_graph_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from documents laid out over many lines, each of them read by several tasks."""
    path = fresh_path(spark, "graph-text")
    models.write_graph_text(manual.latest(manual_jobs.records(spark, sf_dir)), path)
    return _graph_rows(*models.load_graph_file(spark, path, range_bytes=1 << 17))


def s5_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mined model published part by part and loaded; a part that was never written is empty."""
    path = fresh_path(spark, "model")
    seq = mining_jobs.event_sequence(spark, sf_dir)
    models.write_model({"transitions": mining.transitions(seq, mining_jobs.SESSION, mining_jobs.ORDER, noise=mining_jobs.EVENT_NOISE), "frequency": mining.command_frequency(seq)}, path)
    parts = models.load_model(spark, path)
    counts = parts["frequency"].select(F.col("command").alias("from"), F.col("count").alias("uses"))
    flags = parts["flags"].groupBy(F.col("command").alias("from")).agg(F.count("flag").alias("flags"))
    return advice.transition_probability(parts["transitions"]).join(counts, "from").join(flags, "from", "left").withColumn("flags", F.coalesce("flags", F.lit(0)).cast("int"))


def s5_whole_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five parts of the model of the events' command lines, a user a script, published twice and loaded."""
    path = fresh_path(spark, "model")
    lines = validation_jobs.lines(spark, sf_dir).select(F.col("session_id").alias("script_id"), F.lit(0).alias("block_no"), F.col("event_id").alias("line_no"), F.col("cmd_line").alias("line"))
    model = mining.usage_model(lines, [c[0] for c in validation_jobs.CATALOGUE])
    models.write_model({"frequency": model["frequency"]}, path)
    models.write_model(model, path)
    parts = models.load_model(spark, path)
    facts = {
        "meta": parts["meta"].select(F.stack(F.lit(4), *[x for c in parts["meta"].columns for x in (F.lit(c), F.col(c).cast("double"))]).alias("key", "value")),
        "frequency": parts["frequency"].select(F.col("command").alias("key"), F.col("count").cast("double").alias("value")),
        "flags": parts["flags"].select(F.concat_ws(" ", "command", "flag").alias("key"), F.col("present").cast("double").alias("value")),
        "transitions": parts["transitions"].select(F.concat_ws(" ", "from", "to").alias("key"), F.col("count").cast("double").alias("value")),
        "sequences": parts["sequences"].select(F.array_join("sequence", " ").alias("key"), F.col("count").cast("double").alias("value")),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(part).alias("part"), "key", "value") for part, df in facts.items()])


def s2_section_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' command lines at level 1, against catalogues read from section texts, without and with the flags of the syntax."""
    # as in manuals: a page keeps the text of its first option only
    rows = [(c, s or "", "\n".join(f"{o} : text of {o}" for o in options[:1])) for c, _, s, options in command_jobs.CATALOGUE]
    given = spark.createDataFrame(rows, "command string, syntax string, options string").select("*", *[F.lit("").alias(c) for c in ("title", "description", "examples")])
    folder = fresh_path(spark, "sections")
    manuals.write_section_text(given, folder)
    read = materialize(manuals.read_sections(spark, f"{folder}/*").withColumn("command", F.regexp_extract("path", "command=([^/]*)/", 1)), "sections")
    out = []
    for flags_from in ("options", "options+syntax"):
        checked = validation.validate(command_jobs.lines(spark, sf_dir), rules.overlay_types(rules.with_rules(rules.catalogue_of_sections(read, flags_from)), spark.createDataFrame([], rules.TYPE_RULE)))
        out.append(checked.select(F.lit(flags_from).alias("flags_from"), "cmd_line", "command_exists", "l1_valid", F.array_join("unknown_options", " ").alias("unknown")))
    return out[0].unionByName(out[1])


def _to_end(stream: DataFrame, name: str) -> DataFrame:
    """What a stream of files gives until its input ends."""
    spark, out = stream.sparkSession, fresh_path(stream.sparkSession, name)
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", fresh_path(spark, "stream")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _texts(told: DataFrame) -> DataFrame:
    return told.withColumns({"warnings": F.array_join("warnings", "; "), "suggestions": F.array_join("suggestions", "; ")})


def a9_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as files, read as a stream to its end; the advice of each command."""
    log = session_jobs.event_log(spark, sf_dir)
    stream = spark.readStream.schema(log.schema).parquet(_written(log, "events"))
    prob = materialize(session_jobs.model(spark, sf_dir), "model")
    return _texts(_to_end(advise_stream(stream, prob, session_jobs.RULES, idle_minutes=None), "advice"))


def _written(df: DataFrame, name: str) -> str:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def a9_resumed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first part of the log in one batch, the rest as a stream that goes on from the state which that leaves."""
    log = session_jobs.event_log(spark, sf_dir)
    middle = log.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0]
    first, rest = log.filter(F.col("seq") <= F.lit(middle)), log.filter(F.col("seq") > F.lit(middle))
    prob = materialize(session_jobs.model(spark, sf_dir), "model")
    stream = spark.readStream.schema(log.schema).parquet(_written(rest, "events"))
    told = advise_stream(stream, prob, session_jobs.RULES, idle_minutes=None, initial=advice.final_state(first, session_jobs.RULES))
    return _texts(advice.advise(first, prob, session_jobs.RULES).unionByName(_to_end(told, "advice")))


QUERIES = {f.__name__: f for f in (s1_page_files, s3_script_files, s6_section_files, s4_graph, s4_graph_file, s5_model, s5_whole_model, s2_section_catalogue, a9_stream, a9_resumed_stream)}

_EDGES = manual_jobs.SQL["m15_edges"]
_GRAPH = (
    f"SELECT src, dst, kind, dst IN (SELECT 'page_' || page_id FROM pages) AS known FROM ({_EDGES})"
    + " UNION ALL SELECT category, command, 'category', true FROM (" + manual_jobs._PAGES + "SELECT category, command FROM r WHERE category <> '')"
)
SQL = {
    "s1_page_files": manual_jobs._PAGES + "SELECT command, category, title FROM r",
    "s6_section_files": manual_jobs.SQL["s2_sections"],
    "s3_script_files": mining_jobs.SQL["t11_frequency"],
    "s4_graph": _GRAPH,
    "s4_graph_file": _GRAPH,
    "s5_whole_model": validation_jobs._EVENT_LINES
    + f""",
ma AS (SELECT session_id, event_id, cmd_line, list_filter(string_split(cmd_line, ' ')[1:3], lambda w: lower(w) IN ('view', 'click', 'purchase', 'signup', 'error'))[1] AS command FROM li),
mo AS (SELECT * FROM ma WHERE command IS NOT NULL),
nx AS (SELECT command AS a, lead(command) OVER w AS b, lead(command, 2) OVER w AS c, session_id, event_id FROM mo WINDOW w AS (PARTITION BY session_id ORDER BY event_id))
SELECT 'meta' AS part, unnest(['scripts_parsed', 'total_commands', 'unique_commands', 'avg_script_length']) AS key,
       unnest([count(DISTINCT session_id)::DOUBLE, count(*)::DOUBLE, count(DISTINCT command)::DOUBLE, round(count(*)::DOUBLE / count(DISTINCT session_id), 2)]) AS value FROM mo
UNION ALL SELECT 'frequency', command, count(*)::DOUBLE FROM mo GROUP BY command
UNION ALL SELECT DISTINCT 'flags', command || ' ' || unnest({validation_jobs._FLAGS}), 1.0 FROM mo
UNION ALL SELECT 'transitions', a || ' ' || b, count(*)::DOUBLE FROM nx WHERE b IS NOT NULL GROUP BY a, b
UNION ALL SELECT 'sequences', s, n::DOUBLE FROM (SELECT a || ' ' || b || ' ' || c AS s, count(*) AS n, min({{'s': session_id, 'e': event_id}}) AS place FROM nx WHERE c IS NOT NULL GROUP BY 1 ORDER BY n DESC, place LIMIT 30)""",
    "s2_section_catalogue": command_jobs.FINDINGS_SQL
    + f""",
fr(flags_from) AS (VALUES ('options'), ('options+syntax')),
ca(command, options) AS (VALUES {", ".join(f"({c!r}, {o!r}::VARCHAR[])" for c, _, _, o in command_jobs.CATALOGUE)}),
us AS (SELECT flags_from, ve.cmd_line, command_exists, list_filter(list_transform(regexp_extract_all(clean_line, '(?:^| )(-[^ ]*)', 1), lambda t: split_part(t, '=', 1)),
              lambda t: NOT list_contains(CASE WHEN flags_from = 'options' THEN ca.options[1:1] ELSE ca.options END, t)) AS bad FROM ve LEFT JOIN ca USING (command), fr)
SELECT flags_from, cmd_line, command_exists, command_exists AND len(bad) = 0 AS l1_valid, CASE WHEN command_exists THEN array_to_string(bad, ' ') ELSE '' END AS unknown FROM us""",
    "s5_model": f"""SELECT a."from", a."to", a."count", prob, uses, 0::INT AS flags FROM ({mining_jobs.SQL["a1_transition_probability"]}) a
                    JOIN (SELECT event_type AS "from", count(*) AS uses FROM events GROUP BY 1) u ON u."from" = a."from" """,
    "a9_stream": session_jobs.SQL["a8_advise"],
    "a9_resumed_stream": session_jobs.SQL["a8_advise"],
}
