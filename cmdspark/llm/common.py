"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdspark.functions.shipping import ship_package
from cmdspark.functions.storage import fresh_path, materialize

__all__ = ["bound_batches", "crc_fold", "fresh_path", "hot_keys", "materialize", "skew_join", "words_count"]

#: A key is hot when it holds more than one row in HOT_SHARE, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def hot_keys(df: DataFrame, key: str, share: int = HOT_SHARE) -> DataFrame:
    """Keys that hold more than 1/share of the rows of ``df`` (a stored table): under ``share`` rows, whatever the input."""
    total = df.count()
    return materialize(df.groupBy(key).count().filter(F.col("count") * share > F.lit(total)).select(key), "hot")


def bound_batches(df: DataFrame, size: str = "8m") -> DataFrame:
    """Make ready for Python tasks: this package is sent along, and Arrow batches end at ``size`` too unless the session sets its own bound."""
    ship_package(df.sparkSession)
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES, None) is None:
        conf.set(BATCH_BYTES, size)
    return df


def skew_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Inner join on ``key``, of which ``right`` has one row each.

    Rows of hot keys meet their few right rows (under HOT_SHARE by construction) by broadcast; the
    rest is shuffled, and no key of it has more than 1/HOT_SHARE of the rows.
    """
    few = right.join(F.broadcast(hot), key, "left_semi")
    return left.join(F.broadcast(few), key).unionByName(
        left.join(F.broadcast(hot), key, "left_anti").join(right, key)
    )


def words_count(text: Column) -> Column:
    """Number of runs of characters other than x20 and x09 to x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")
