"""One helper for jobs that walk whole texts in Python: Arrow batches in, Arrow batches out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows are handed on in slices of at most this many characters or this many rows.
SLICE_CHARS, SLICE_ROWS = 8_000_000, 4096


def slices(rows: Iterator[tuple], chars: Callable[[tuple], int] = lambda row: 0) -> Iterator[list[tuple]]:
    """Lists of consecutive rows, each bounded in rows and characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += chars(row)
        if size >= SLICE_CHARS or len(held) >= SLICE_ROWS:
            yield held
            held, size = [], 0
    if held:
        yield held


def map_rows(df: DataFrame, make: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str, arrow: pa.Schema) -> DataFrame:
    """``make`` turns an iterator over a partition's rows (tuples) into an iterator over result rows (tuples)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns), strict=True))
        size = lambda row: sum(len(x) for x in row if isinstance(x, str | bytes))
        for part in slices(make(rows), size):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part, strict=True), arrow.types, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)
