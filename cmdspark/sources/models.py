"""The command graph and the mined usage model on disk."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cmdspark.functions.storage import materialize

from .graph_file import RANGE_BYTES, graph_entries

RECORD = "category string, syntax string, options map<string,string>, description string, examples string, related array<string>, depends_on array<string>"
GRAPH = f"commands map<string,struct<{RECORD.replace(' string', ':string').replace(' map', ':map').replace(' array', ':array').replace(', ', ',')}>>, categories map<string,array<string>>"
MODEL = {
    "meta": "scripts_parsed long, total_commands long, unique_commands long, avg_script_length double",
    "frequency": "command string, count long",
    "flags": "command string, flag string, present int",
    "transitions": "`from` string, `to` string, count long",
    "sequences": "sequence array<string>, count long",
}


def write_graph(records: DataFrame, path: str) -> None:
    """The catalogue as a table."""
    records.write.mode("overwrite").parquet(path)


def graph_documents(records: DataFrame, commands_each: int = 1000) -> DataFrame:
    """(commands, categories) of graph documents of about ``commands_each`` commands, so that no document grows with the catalogue.

    A document's categories list its own commands, in order; commands without a category are in none.
    """
    fields = [f.split(" ")[0] for f in RECORD.split(", ")]
    records = materialize(records, "records")  # they are counted, and dealt twice
    documents = max(1, -(-records.count() // commands_each))
    dealt = records.withColumn("part", F.pmod(F.xxhash64("command"), F.lit(documents)))
    commands = dealt.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("command", F.struct(*fields)))).alias("commands"))
    named = dealt.filter(F.coalesce("category", F.lit("")) != "").groupBy("part", "category").agg(F.array_sort(F.collect_list("command")).alias("members"))
    categories = named.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("category", "members"))).alias("categories"))
    return commands.join(categories, "part", "left").select("commands", F.coalesce("categories", F.create_map().cast("map<string,array<string>>")).alias("categories"))


def write_graph_json(records: DataFrame, path: str, commands_each: int = 1000) -> None:
    """The catalogue as graph documents, one a line."""
    graph_documents(records, commands_each).write.mode("overwrite").json(path)


def write_graph_text(records: DataFrame, path: str, commands_each: int = 1000) -> None:
    """The catalogue as graph documents laid out for readers, an entry on lines of its own."""
    text = F.to_json(F.struct("commands", "categories"), {"pretty": "true"})
    graph_documents(records, commands_each).select(text.alias("value")).write.mode("overwrite").text(path)


def _graph(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    return spark.read.schema(GRAPH).option("multiLine", not lines).json(path)


def load_graph_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(command, category, ...) of a graph kept as one JSON document a file, or a document on each of many ``lines``; self edges dropped."""
    records = _graph(spark, path, lines).select(F.explode("commands").alias("command", "r")).select("command", "r.*")
    return records.withColumn("depends_on", F.array_remove("depends_on", F.col("command")))


def load_categories_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(category, command) of the documents' categories, which together are the index of M14."""
    members = _graph(spark, path, lines).select(F.explode("categories").alias("category", "members"))
    return members.select("category", F.explode("members").alias("command"))


def load_graph_file(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Records (command, category, ...) and index (category, command) of graph documents that are too large for a task; self edges dropped."""
    entries = materialize(graph_entries(spark, path, range_bytes), "graph-entries")
    record = F.from_json("body", f"struct<{RECORD.replace(' string', ':string').replace(' map', ':map').replace(' array', ':array')}>")
    records = entries.filter("kind = 'command'").select(F.col("name").alias("command"), record.alias("r")).select("command", "r.*")
    index = entries.filter("kind = 'category'").select(F.col("name").alias("category"), F.explode(F.from_json("body", "array<string>")).alias("command"))
    return records.withColumn("depends_on", F.array_remove("depends_on", F.col("command"))), index


def valid_commands(records: DataFrame) -> DataFrame:
    """(command)."""
    return records.select("command").distinct()


def _files(spark: SparkSession, path: str):
    """Hadoop's file system for a path, and its class of paths."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    return paths(path).getFileSystem(spark._jsc.hadoopConfiguration()), paths


def _names(spark: SparkSession, folder: str) -> list[str]:
    system, paths = _files(spark, folder)
    return sorted(f.getPath().getName() for f in system.listStatus(paths(folder))) if system.exists(paths(folder)) else []


def versions(spark: SparkSession, path: str) -> dict[int, dict]:
    """The manifests of a model's versions, oldest first; one that isn't written to its end is none."""
    out = {}
    for name in _names(spark, f"{path}/manifests"):
        system, paths = _files(spark, path)
        stream = system.open(paths(f"{path}/manifests/{name}"))
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            out[int(name.removesuffix(".json"))] = json.loads(text)
        except ValueError:
            continue
    return out


def _put_manifest(spark: SparkSession, path: str, manifest: dict) -> int:
    """Write the manifest under the next number that no other writer has taken."""
    system, paths = _files(spark, path)
    taken = [int(n.removesuffix(".json")) for n in _names(spark, f"{path}/manifests") if n.endswith(".json")]
    number = max(taken, default=0) + 1
    while True:
        at = paths(f"{path}/manifests/{number:012d}.json")
        if system.exists(at):
            number += 1
            continue
        stream = system.create(at, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        return number


def write_model(parts: dict[str, DataFrame], path: str, keep: int = 3, grace_hours: float = 24.0) -> int:
    """Publish a model; the number of its version.

    The parts are written to a folder of their own, and a manifest that names them all is put in place
    last: readers see the whole new model or the whole old one, and a writer that fails changes nothing for
    them. Two writers get two versions. Of the versions the last ``keep`` stay; folders that no manifest names
    go after ``grace_hours``, as another writer may be at work in them.
    """
    spark = next(iter(parts.values())).sparkSession
    unknown = set(parts) - set(MODEL)
    if unknown:
        raise ValueError(f"no parts of a model: {', '.join(sorted(unknown))}")
    snapshot = uuid.uuid4().hex
    for name, df in parts.items():
        df.write.parquet(f"{path}/snapshots/{snapshot}/{name}")
    number = _put_manifest(spark, path, {"snapshot": snapshot, "parts": sorted(parts)})
    _expire(spark, path, keep, grace_hours)
    return number


def _expire(spark: SparkSession, path: str, keep: int, grace_hours: float) -> None:
    system, paths = _files(spark, path)
    there = versions(spark, path)
    for number in sorted(there)[:-keep]:  # the manifest first, so that none ever names what is gone
        system.delete(paths(f"{path}/manifests/{number:012d}.json"), False)
        system.delete(paths(f"{path}/snapshots/{there[number]['snapshot']}"), True)
    named = {m["snapshot"] for m in there.values()}
    for name in _names(spark, f"{path}/snapshots"):
        at = paths(f"{path}/snapshots/{name}")
        if name not in named and time.time() - system.getFileStatus(at).getModificationTime() / 1000 > grace_hours * 3600:
            system.delete(at, True)


def load_model(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The parts of the last version, or of a given one; those that it doesn't have load as empty tables, as do all if nothing was published."""
    there = versions(spark, path)
    if version is not None and version not in there:
        raise ValueError(f"no version {version} of the model")
    manifest = there[version or max(there)] if there else {"parts": []}
    return {
        name: spark.read.schema(schema).parquet(f"{path}/snapshots/{manifest['snapshot']}/{name}") if name in manifest["parts"] else spark.createDataFrame([], schema)
        for name, schema in MODEL.items()
    }
