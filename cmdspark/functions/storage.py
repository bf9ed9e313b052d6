"""Tables that an operator writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
_noted: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or one of our own where it is unset, which serves a local session only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="cmdspark-"))
    return _own_dir[0]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/cmdspark/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    for tables in _noted:
        tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def noted_tables() -> Iterator[list[str]]:
    """The paths of the tables that are materialized in the block, for ``drop_tables`` once nothing reads them any more."""
    tables: list[str] = []
    _noted.append(tables)
    try:
        yield tables
    finally:
        _noted[:] = [x for x in _noted if x is not tables]


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of one's own; those that are gone already are left out."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
