"""Manual pages to command records, the category index and edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cmdspark.functions.batches import append_column
from cmdspark.functions.html import PAGE, read_pages
from cmdspark.functions.shipping import ship_package

FLAG_START = r"^-[A-Za-z_][A-Za-z0-9_]*"
MENTION = r"\b(?:set|run|report)_[a-z0-9_]+\b"


def command_name(path: Column) -> Column:
    """M2: the file's stem without ``man_``."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return F.replace(stem, F.lit("man_"), F.lit(""))


def category(toc_path: Column) -> Column:
    """M3: the last segment of the path, else empty."""
    return F.coalesce(F.element_at(F.split(toc_path, r"\|"), -1), F.lit(""))


def syntax_text(parts: Column) -> Column:
    """M7: stripped lines of the text nodes, blanks dropped, joined by a space, a blank before ``]`` dropped."""
    lines = F.flatten(F.transform(parts, lambda t: F.split(t, "\n")))
    kept = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    return F.replace(F.array_join(kept, " "), F.lit(" ]"), F.lit("]"))


def option_map(pairs: Column) -> Column:
    """M8: flag -> text of each dt that begins with a flag; of a repeated flag the last counts."""
    flagged = F.filter(F.transform(pairs, lambda p: F.struct(F.regexp_extract(F.trim(p["dt"]), FLAG_START, 0).alias("flag"), p["dd"].alias("dd"))), lambda p: p["flag"] != "")
    last = F.filter(flagged, lambda p, i: ~F.exists(F.slice(flagged, i + 2, F.size(flagged)), lambda q: q["flag"] == p["flag"]))
    return F.map_from_entries(last)


def option_lines(pairs: Column, items: Column) -> Column:
    """M9: ``dt : dd`` of the first list of terms, then every item of the first list of items."""
    terms = F.transform(F.filter(pairs, lambda p: p["dt"] != ""), lambda p: F.concat(p["dt"], F.lit(" : "), p["dd"]))
    return F.array_join(F.concat(terms, F.filter(items, lambda x: x != "")), "\n")


def related(hrefs: Column) -> Column:
    """Distinct sorted names behind links to manual pages."""
    own = F.filter(hrefs, lambda h: h.startswith("man_"))
    return F.array_sort(F.array_distinct(F.transform(own, lambda h: F.replace(F.replace(h, F.lit("man_"), F.lit("")), F.lit(".htm"), F.lit("")))))


def mentions(text: Column, command: Column) -> Column:
    """Distinct sorted command-like words, without the command itself."""
    return F.array_sort(F.array_except(F.regexp_extract_all(text, F.lit(f"({MENTION})"), F.lit(1)), F.array(command)))


def parse_pages(pages: DataFrame) -> DataFrame:
    """One command record per page (path, html), with the flat record's fields and ``error``."""
    raw = append_column(pages.select("path", "html"), "p", PAGE, read_pages, "html", drop=("html",))
    command = command_name(F.col("path"))
    full = F.coalesce(F.col("p.description"), F.lit(""))
    examples = F.coalesce(F.col("p.examples_graph"), F.lit(""))
    return raw.select(
        "path",
        command.alias("command"),
        category(F.col("p.toc_path")).alias("category"),
        F.col("p.title").alias("title"),
        syntax_text(F.col("p.syntax_graph")).alias("syntax"),
        option_map(F.col("p.arguments")).alias("options"),
        option_lines(F.col("p.first_dl"), F.col("p.first_ul")).alias("options_text"),
        F.when(full == "", F.col("p.short")).otherwise(full).alias("description"),
        F.coalesce(F.get(F.filter("p.paragraphs", lambda x: F.length(x) > 20), F.lit(0)), F.lit("")).alias("first_paragraph"),
        examples.alias("examples"),
        F.coalesce(F.col("p.examples_flat"), F.lit("")).alias("examples_flat"),
        related(F.col("p.hrefs")).alias("related"),
        mentions(F.concat(full, F.lit(" "), examples), command).alias("depends_on"),
        F.col("p.error").alias("error"),
    )


def latest(records: DataFrame) -> DataFrame:
    """One record per command: of several pages the last path's; pages that failed are left out."""
    rank = F.row_number().over(Window.partitionBy("command").orderBy(F.desc("path")))
    return records.filter("error is null").withColumn("rank", rank).filter("rank = 1").drop("rank")


def category_index(records: DataFrame) -> DataFrame:
    """Rows (category, command), the empty category left out."""
    return records.filter(F.coalesce("category", F.lit("")) != "").select("category", "command")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(category, n, commands_md5) of rows in order of category and command; no more than a batch is held."""

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([n], pa.int32()), pa.array([digest.hexdigest()])], ["category", "n", "commands_md5"])

    now, n, digest = None, 0, hashlib.md5()
    for batch in batches:
        for category_, command in zip(batch.column("category").to_pylist(), batch.column("command").to_pylist(), strict=True):
            if category_ != now:
                if n:
                    yield row()
                now, n, digest = category_, 0, hashlib.md5()
            digest.update((" " if n else "").encode() + command.encode())
            n += 1
    if n:
        yield row()


def category_digests(index: DataFrame) -> DataFrame:
    """Number of commands and md5 of them in order, a blank between, per category; sorted rows are read as a stream."""
    ship_package(index.sparkSession)
    ordered = index.select("category", "command").repartition("category").sortWithinPartitions("category", "command")
    return ordered.mapInArrow(_digests, "category string, n int, commands_md5 string")


def drop_self_edges(records: DataFrame) -> DataFrame:
    """M15."""
    return records.withColumn("depends_on", F.array_remove("depends_on", F.col("command")))


def edges(records: DataFrame) -> DataFrame:
    """(src, dst, kind) of related and depends_on, without self edges."""
    both = [records.select(F.col("command").alias("src"), F.explode(kind).alias("dst"), F.lit(kind).alias("kind")) for kind in ("related", "depends_on")]
    return both[0].unionByName(both[1]).filter("src <> dst")
