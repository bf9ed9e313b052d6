"""The category index stays rows, and its digests are those of the whole ordered list."""

import hashlib

from cmdspark.operators import manual


def test_digests_over_many_batches(spark):
    rows = [("en", f"page_{i}") for i in range(3000)] + [("de", "b"), ("de", "a"), ("é", "x y"), ("", "none"), (None, "none")]
    index = manual.category_index(spark.createDataFrame(rows, "category string, command string").repartition(5))
    assert dict(index.dtypes) == {"category": "string", "command": "string"}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {r["category"]: (r["n"], r["commands_md5"]) for r in manual.category_digests(index).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = {c: sorted(x for k, x in rows if k == c) for c in ("en", "de", "é")}
    assert got == {c: (len(x), hashlib.md5(" ".join(x).encode()).hexdigest()) for c, x in want.items()}
