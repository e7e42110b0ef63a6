"""Small helpers for functions that Spark runs over Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows that a function looks at together; bounds its Python objects, not its result.
SLICE_ROWS = 1024


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def portions(batches: Iterator[pa.RecordBatch], column: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows, and so many bytes in one column; a longer value has a slice of its own."""
    for batch in batches:
        ends = np.cumsum(longs(pc.binary_length(batch.column(column))))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = min(start + rows, int(np.searchsorted(ends, before + size, "right")))
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def give_back() -> None:
    """Return memory that Arrow and the C library keep for later to the system, where they can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def texts(column: pa.Array) -> list[str]:
    """Strings of a column; NULL counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; NULL counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def longs(column: pa.Array, null: int = 0) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), null).to_numpy(zero_copy_only=False)


def map_batches(
    df: DataFrame, columns: list[str], function: Callable[[pa.RecordBatch], dict], schema: str
) -> DataFrame:
    """Apply ``function`` (batch to columns by name) to slices of the named columns."""

    def run(batches):
        for batch in slices(batches):
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({k: as_array(v) for k, v in function(batch).items()})

    return df.select(*columns).mapInArrow(run, schema)


def as_array(values) -> pa.Array:
    return values if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values)
