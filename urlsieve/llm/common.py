"""Helpers shared by the corpus operators: shared-folder tables, text keys, Arrow output batches, span sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.session import fresh_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that outlives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(doc_id: Column, text: Column) -> Column:
    """64-bit key of a row's (id, text).  Rows that agree in both share the key, and everything derived per key
    (repeated spans, token counts) is the same for them, so equal rows need no other identity."""
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")))


def utf8(column: pa.Array) -> list[bytes]:
    """Values of a string column as UTF-8 bytes, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: Bytes of texts and lists that a task takes up at a time; a larger row comes alone.
SLICE_BYTES = 8 << 20


def row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """About how many bytes the texts and lists of each row take."""
    total = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        kind = column.type
        if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(kind):
            total += 32 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return total


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and ``size`` bytes (or one row), so that what a task holds at a
    time follows neither the reader's batch size nor the number of long texts."""
    for batch in batches:
        ends = np.cumsum(row_bytes(batch))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            fits = int(np.searchsorted(ends, before + size, "right"))
            stop = min(max(fits, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop


class Batches:
    """Gather numpy columns and hand them out as record batches of at least ``rows`` rows."""

    def __init__(self, schema: pa.Schema, rows: int = 50_000):
        self.schema, self.rows, self.parts, self.held = schema, rows, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(columns[0]):
            self.parts.append(columns)
            self.held += len(columns[0])
        if self.held >= self.rows:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            arrays = [pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*self.parts), self.schema, strict=True)]
            self.parts, self.held = [], 0
            yield pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as maximal runs (touching intervals join)."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
    return starts[first], np.r_[reach[first[1:] - 1], reach[-1:]]
