"""Manual pages, section texts and script corpora as DataFrames, and their sinks."""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cmdspark.functions.batches import PIECE_BYTES, PIECE_ROWS
from cmdspark.functions.shipping import ship_package

SECTIONS = ("COMMAND", "TITLE", "DESCRIPTION", "SYNTAX", "OPTIONS", "EXAMPLES")
#: What Spark escapes in the names of partitions' folders, and its name for a value that is null or empty.
ESCAPES, NO_VALUE = str.maketrans({c: f"%{ord(c):02X}" for c in (*map(chr, range(1, 32)), *"\"#%'*/:=?\\\x7f{[]^")}), "__HIVE_DEFAULT_PARTITION__"
#: Folders that a task reads.
TASK_FOLDERS = 2000


def read_html(spark: SparkSession, folder: str, pattern: str = "man_*.htm") -> DataFrame:
    """(path, html) of the files; bytes that aren't UTF-8 are dropped, as are replacement characters that stand for such bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    return files.select("path", text.alias("html"))


def _write_each(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    system, path = fs.FileSystem.from_uri(folder)
    for batch in batches:
        for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
            with system.open_output_stream(f"{path}/{name}") as out:
                out.write(content.as_buffer() if content.is_valid else b"")
        yield batch.select(["name"])


def write_files(files: DataFrame, folder: str) -> int:
    """Write each row's content (name, content binary) as a file of that name under ``folder``; the number of rows. A task that is repeated writes the same files again."""
    ship_package(files.sparkSession)
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return files.mapInArrow(lambda it: _write_each(it, folder), "name string").count()


def parse_sections(texts: DataFrame) -> DataFrame:
    """(path, command, title, description, syntax, options, examples) of section texts (path, value); absent ones are empty."""
    names = "|".join(SECTIONS)
    body = F.regexp_replace("value", "\r\n", "\n")
    fields = []
    for name in SECTIONS:
        found = F.regexp_extract(body, rf"(?s)(?:^|\n){name}:?[ \t]*\n?(.*?)(?=\n(?:{names}):?[ \t]*(?:\n|$)|\n(?:{names}): |$)", 1)
        fields.append(F.regexp_replace(found, r"(?U)^[\s=-]*\n|^\s+|\s+$", "").alias(name.lower()))
    return texts.select("path", *fields)


def read_sections(spark: SparkSession, folder: str) -> DataFrame:
    """S2 from files."""
    texts = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_sections(texts)


def _known(path: JavaObject) -> str | None:
    """The path as an URI, if Arrow knows its file system."""
    uri = path.toUri().toString()
    try:
        fs.FileSystem.from_uri(uri)
    except (pa.ArrowException, OSError):
        return None
    return uri


def _read_each(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """(path, content) of the files in each of the named folders, unpacked as their endings say; few are held at a time."""
    system, path = fs.FileSystem.from_uri(folder)
    paths, contents, size = [], [], 0
    for batch in batches:
        for name in batch.column("name").to_pylist():
            for file in system.get_file_info(fs.FileSelector(f"{path}/{name}")):
                if file.is_file and not file.base_name.startswith((".", "_")):
                    with system.open_input_stream(file.path) as data:
                        contents.append(data.read())
                    paths.append(f"{folder}/{name}/{file.base_name}")
                    size += len(contents[-1])
                if len(paths) >= PIECE_ROWS or size >= PIECE_BYTES:
                    yield pa.RecordBatch.from_pydict({"path": paths, "content": contents})
                    paths, contents, size = [], [], 0
    if paths:
        yield pa.RecordBatch.from_pydict({"path": paths, "content": contents})


def read_section_folders(spark: SparkSession, folder: str) -> DataFrame:
    """S2 from what S6 wrote: the driver lists the folders of commands, tasks list and read their files.

    Spark's reader keeps the states of all files in the driver and takes many times as long for a file; it serves where Arrow doesn't know the file system.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    of = _known(at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at))
    if of is None:
        return read_sections(spark, f"{folder}/*")
    ship_package(spark)
    system, path = fs.FileSystem.from_uri(of)
    names = [x.base_name for x in system.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.Directory and not x.base_name.startswith((".", "_"))]
    folders = spark.createDataFrame(pa.table({"name": pa.array(names, pa.string())})).repartition(len(names) // TASK_FOLDERS + 1)
    files = folders.mapInArrow(lambda it: _read_each(it, of), "path string, content binary")
    return parse_sections(files.select("path", F.col("content").cast("string").alias("value")))


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """S3: (script_id, text), a file each."""
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("script_id"), F.replace(F.make_valid_utf8("value"), F.lit("�"), F.lit("")).alias("text"))


def section_text(records: DataFrame) -> DataFrame:
    """(command, value): one section text per command, empty sections left out."""
    parts = [F.when(F.coalesce(F.col(n.lower()), F.lit("")) != "", F.concat(F.lit(f"{n}:\n"), F.col(n.lower()), F.lit("\n"))) for n in SECTIONS]
    return records.select("command", F.concat_ws("\n", *parts).alias("value"))


def _write_texts(batches: Iterator[pa.RecordBatch], folder: str, compression: str | None) -> Iterator[pa.RecordBatch]:
    """Each text as a file in its command's folder. A name is made of the task, the text and the number of equal ones so far, so a task that is repeated gives the same names; no file shows before it is whole."""
    system, path = fs.FileSystem.from_uri(folder)
    task, equal = TaskContext.get(), Counter()
    for batch in batches:
        for command, value in zip(batch.column("command").to_pylist(), batch.column("value"), strict=True):
            own, text = f"{path}/command={(command or NO_VALUE).translate(ESCAPES)}", value.as_buffer().to_pybytes() + b"\n"
            digest = hashlib.md5(text).digest()
            equal[own, digest] += 1
            name = f"part-{task.partitionId():05d}-{digest.hex()}-{equal[own, digest]}.txt{'.gz' if compression else ''}"
            system.create_dir(own, recursive=True)
            with system.open_output_stream(f"{own}/.{name}.{task.taskAttemptId()}", compression=None) as out:
                out.write(gzip.compress(text, 3, mtime=0) if compression else text)
            system.move(f"{own}/.{name}.{task.taskAttemptId()}", f"{own}/{name}")
        yield batch.select(["command"])


def write_section_text(records: DataFrame, folder: str, compression: str | None = None) -> None:
    """A folder per command, named as by ``partitionBy``, with a file for each record, plain or packed (``gzip``). What was in the folder is replaced once all are written.

    Tasks write the files themselves: Spark's writer takes many times as long for a file and moves each folder from the driver; it serves where Arrow doesn't know the file system.
    The command is a directory name, so its number of values should stay a catalogue's.
    """
    if compression not in (None, "gzip"):
        raise ValueError(f"section texts are plain or packed by gzip, not {compression}")
    spark, texts, hadoop_path = records.sparkSession, section_text(records), records.sparkSession._jvm.org.apache.hadoop.fs.Path
    system = hadoop_path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    target = system.makeQualified(hadoop_path(folder))
    new = hadoop_path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    to = _known(new)
    if to is None:
        texts.write.mode("overwrite").partitionBy("command").text(folder, compression=compression)
        return
    ship_package(spark)
    try:
        system.mkdirs(new)
        texts.mapInArrow(lambda it: _write_texts(it, to, compression), "command string").count()
        system.delete(target, True)
        if not system.rename(new, target):
            raise OSError(f"{new.toString()} can't be renamed to {folder}")
    finally:
        system.delete(new, True)
