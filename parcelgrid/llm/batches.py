"""Arrow batches of text rows, cut to a bounded size, for operators that run numpy or plain Python inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

SLICE_BYTES = 4 << 20

Work = Callable[[pa.RecordBatch], Sequence[pa.Array]]


def keyed(rows: DataFrame, key: str, **columns: Column | str) -> DataFrame:
    """Only the key and the named columns, so that no extra column of the input can clash with a result."""
    return rows.select(
        F.col(key).alias("key"), *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]
    )


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``most_bytes`` of text each, or one row where a row is longer."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(size, dtype=np.int64), 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_rows(
    rows: DataFrame, text: str, make: Callable[[], Work], fields: str, out_key: str, most_bytes: int = SLICE_BYTES
) -> DataFrame:
    """One result row for each row of ``keyed`` rows: the key as ``out_key``, then ``fields`` (a DDL string).

    ``make`` runs once in each task and returns the function that turns a slice into the arrays of ``fields``.
    """
    schema = T.StructType([T.StructField(out_key, rows.schema["key"].dataType), *T.StructType.fromDDL(fields)])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            for part in slices(batch, text, most_bytes):
                work = work or make()
                arrays = [part.column("key"), *work(part)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(run, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a slice in one array, and each text's borders in it; null counts as empty."""
    filled = pc.fill_null(column, "")
    if isinstance(filled, pa.ChunkedArray):
        filled = filled.combine_chunks()
    wide = np.int64 if pa.types.is_large_string(filled.type) else np.int32
    buffers = filled.buffers()
    borders = np.frombuffer(buffers[1], wide)[filled.offset : filled.offset + len(filled) + 1].astype(np.int64)
    first, last = (int(borders[0]), int(borders[-1])) if len(borders) else (0, 0)
    data = np.frombuffer(buffers[2], np.uint8)[first:last] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, borders - first if len(borders) else np.zeros(1, np.int64)
