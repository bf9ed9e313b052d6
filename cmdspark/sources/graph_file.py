"""A command graph in one JSON document of any size, read by many tasks: byte ranges cut at the borders of its entries."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cmdspark.functions.shipping import ship_package

#: Bytes of a file that a task reads, unless an option says otherwise.
RANGE_BYTES = 16 << 20
_HEAD, _MORE = 1 << 16, 1 << 20
_STRING = rb'"(?:[^"\\]|\\.)*"'
#: The indentation of a document's entries: that of the first key inside the first part.
_INDENT = re.compile(rb"\n[ \t]+" + _STRING + rb"\s*:\s*[{\[][ \t\r]*\n([ \t]+)\"")


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, border: bytes | None):
        self.path, self.start, self.end, self.border = path, start, end, border


def _entries_at(text: str, at: int) -> tuple[str, str, str] | None:
    """(kind, name, body) of the entry whose key begins at ``at``: an object is a command's record, an array a category's commands."""
    decoder = json.JSONDecoder()
    name, end = decoder.raw_decode(text, at)
    begin = re.compile(r"\s*:\s*").match(text, end).end()
    value, end = decoder.raw_decode(text, begin)
    if isinstance(value, dict | list):
        return "command" if isinstance(value, dict) else "category", name, text[begin:end]
    return None


def _cut(stream, part: _Range, size: int) -> Iterator[tuple[str, str, str]]:
    """The entries whose line begins in the range; the last may reach beyond it."""
    border = re.compile(re.escape(part.border))
    length = part.end - part.start
    data = stream.read_at(min(size - part.start, length + len(part.border)), part.start)
    own = [m for m in border.finditer(data) if m.start() < length]
    if not own:
        return
    last = own[-1].end()
    while not (following := border.search(data, last)) and part.start + len(data) < size:
        last = max(last, len(data) - len(part.border))
        data += stream.read_at(min(_MORE, size - part.start - len(data)), part.start + len(data))
    ends = [m.start() for m in own[1:]] + [following.start() if following else len(data)]
    for m, end in zip(own, ends, strict=True):
        entry = _entries_at(data[m.end() - 1 : end].decode(), 0)
        if entry:
            yield entry


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        system, path = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        out = []
        for f in files:
            with system.open_input_file(f.path) as stream:
                indent = _INDENT.search(stream.read_at(min(_HEAD, f.size), 0))
            # a document on one line has no borders that a task could find
            border = b"\n" + indent[1] + b'"' if indent else None
            step = self.bytes if border else max(1, f.size)
            out += [_Range(f.path, a, min(f.size, a + step), border) for a in range(0, f.size, step)]
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(partition.path) as stream:
            if partition.border:
                yield from _cut(stream, partition, stream.size())
                return
            for part in json.loads(stream.read() or b"{}").values():
                for name, value in part.items() if isinstance(part, dict) else ():
                    if isinstance(value, dict | list):
                        yield "command" if isinstance(value, dict) else "category", name, json.dumps(value)


class CommandGraph(DataSource):
    """(kind, name, body) of the entries of graph documents; options path and rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "command_graph"

    def schema(self) -> str:
        return "kind string, name string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def graph_entries(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(kind, name, body) of the documents at ``path``, a file or a folder: commands with their records, categories with their commands, in JSON.

    A file whose entries stand on lines of their own, with any indentation, is read in ranges of
    ``range_bytes``; one on a single line by one task.
    """
    ship_package(spark)
    spark.dataSource.register(CommandGraph)
    return spark.read.format("command_graph").option("path", path).option("rangeBytes", range_bytes).load()
