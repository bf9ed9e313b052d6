"""Adding a column that Python computes, batch by batch, as an operator of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

from .shipping import ship_package

#: Rows, and about as many bytes of the sources, that are Python values at a time.
PIECE_ROWS, PIECE_BYTES = 256, 1 << 20


def pieces(batch: pa.RecordBatch, *sources: str) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of PIECE_ROWS rows, fewer where the sources' values are large; a row is never cut."""
    size = max(1, sum(batch.column(s).nbytes for s in sources))
    rows = max(1, min(PIECE_ROWS, batch.num_rows * PIECE_BYTES // size))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def append_column(df: DataFrame, name: str, kind: str, function: Callable[..., list], *sources: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``name``, of DDL type ``kind``: what ``function`` gives for the lists of values of ``sources``; without the columns ``drop``.

    All other columns pass as Arrow arrays, a piece of a batch at a time. Unlike a user-defined function in a projection, the optimizer
    never copies or moves it, so each row is computed once.
    """
    ship_package(df.sparkSession)
    data_type = _parse_datatype_string(kind)
    arrow = to_arrow_type(data_type)

    kept = [c for c in df.columns if c not in drop]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, *sources):
                values = function(*[piece.column(s).to_pylist() for s in sources])
                yield piece.select(kept).append_column(name, pa.array(values, type=arrow))

    return df.mapInArrow(run, StructType([*[df.schema[c] for c in kept], *StructType().add(name, data_type).fields]))
