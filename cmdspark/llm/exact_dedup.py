"""Exact deduplication by skew-safe combining, DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, materialize, skew_join


def normalise(text: Column) -> Column:
    """Runs of x20 and x09 to x0D become one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    salts: int = 32,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest.

    Three steps, each of which compares whole normalised texts, because the text is part of the key:
    partial aggregation deduplicates within each input partition; the shuffle merges groups of
    (digest, salt, text); the winners of a digest's salts are then combined over all partitions.
    Only digests that hold more than 1/1000 of the rows are salted, so every other text crosses the
    network once. Rows are joined to their winner by digest alone; digests with more than one text
    (a collision, which ``digest`` may be weak enough to have) are joined by text too.

    Null text equals the empty text. The smallest id of a group stays, nulls after all others; of
    repeated rows with that id just one has ``kept`` true. Other columns are ignored, so their names
    may clash. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalise(F.col(text_col)).alias("norm"))
    keyed = rows.select("id", "norm", digest(F.col("norm")).alias("key"))
    table = materialize(keyed.select("id", "key", F.monotonically_increasing_id().alias("rid")), "dedup-keys")
    hot = hot_keys(table, "key")

    # nulls sort after all ids
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id")))
    salted = (
        keyed.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), "key", "left")
        .withColumn("salt", F.when(F.col("is_hot"), F.pmod(F.xxhash64("id"), F.lit(salts))).otherwise(F.lit(-1)))
        .groupBy("key", "salt", "norm")
        .agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
    )
    # The text travels again for salt winners only. A cold digest has a row here for each of its texts.
    merged = (
        salted.withColumn("content", F.when(F.col("salt") >= 0, F.col("norm")))
        .groupBy("key", "content")
        .agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
    )
    texts = F.sum(F.when(F.col("content").isNull(), F.col("parts")).otherwise(F.lit(1)))
    groups = materialize(
        merged.groupBy("key").agg(F.min("first").alias("first"), F.sum("n").alias("n"), texts.alias("texts")), "dedup-groups"
    )
    clear = _resolve(table, groups.filter("texts = 1"), hot, "key")
    collisions = groups.filter("texts > 1").select("key")
    if not collisions.isEmpty():
        clear = clear.unionByName(_by_text(keyed, collisions))
    return clear.select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        F.col("kept"),
        F.lower(F.hex("key")).alias("digest"),
    )


def _resolve(table: DataFrame, groups: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """Give each row its group's winner; of rows repeating the winner's id the one with the least row number is kept."""
    groups = groups.select(key, F.col("first.id").alias("keep"), "n")
    kept_row = (
        groups.alias("g")
        .join(table.alias("t"), (F.col(f"g.{key}") == F.col(f"t.{key}")) & F.col("g.keep").eqNullSafe(F.col("t.id")))
        .groupBy(F.col(f"g.{key}").alias(key), "keep", "n")
        .agg(F.min("rid").alias("keep_rid"))
    )
    return skew_join(table, kept_row, key, hot).select(
        "id", "keep", "n", (F.col("rid") == F.col("keep_rid")).alias("kept"), "key"
    )


def _by_text(keyed: DataFrame, collisions: DataFrame) -> DataFrame:
    """The rows of digests that several texts share, resolved by the texts themselves."""
    table = materialize(
        keyed.join(collisions, "key", "left_semi").withColumn("rid", F.monotonically_increasing_id()), "dedup-collisions"
    )
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id")))
    groups = table.groupBy("norm").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
    return _resolve(table, groups, hot_keys(table, "norm"), "norm")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).withColumnRenamed("digest", "text_sha256")


OP1_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
