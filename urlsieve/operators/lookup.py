"""Lookups of array elements in a key-value table, inside the row.

A table is cut by the hash of its keys into parts of at most ``PART_BYTES``; for a small table that is one part.  A part is
sent to every executor once, indexed once per Python worker, and every Arrow batch looks up its distinct elements only.
The rows never shuffle, so their ids play no role and equal ids stay apart.  Beyond ``PARTS_AT_ONCE`` parts the rows are
written between groups of parts, so a worker never holds more than that many.

Null arrays count as empty.  A key that the table holds twice gives one of its values.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package

PART_BYTES = 32 << 20
ENTRY_BYTES = 32            # what an entry takes beside its key
PARTS_AT_ONCE = 4

_INDEXES: dict[int, tuple[Any, dict]] = {}    # by the broadcast value, which a worker keeps


def _index(entries: tuple[list, list]) -> dict:
    held = _INDEXES.get(id(entries))
    if held is None or held[0] is not entries:
        if len(_INDEXES) >= 2 * PARTS_AT_ONCE:
            _INDEXES.clear()
        held = _INDEXES[id(entries)] = entries, dict(zip(*entries, strict=True))
    return held[1]


def _parts(table: DataFrame, key: str, value: str):
    """The table's parts as broadcast (keys, values); one after the other passes through the driver."""
    size, rows = table.agg(F.sum(F.octet_length(F.col(key).cast("string")).cast("long") + ENTRY_BYTES), F.count(F.lit(1))).first()
    count = min(-(-(size or 0) // PART_BYTES), rows) or 1
    part = F.pmod(F.xxhash64(key), F.lit(count))
    for i in range(count):
        rows = table if count == 1 else table.where(part == i)
        got = rows.select(key, value).toArrow()
        yield table.sparkSession.sparkContext.broadcast((got.column(0).to_pylist(), got.column(1).to_pylist()))


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Elements of all arrays in turn, the row of each, and the length of each row's array."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.list_flatten(lists), np.repeat(np.arange(len(lists)), lengths), lengths


def _found(elements: pa.Array, entries: tuple[list, list], missing: Any) -> list:
    """(codes of the elements, value of each code, ``missing`` where the table has none)."""
    coded = elements.dictionary_encode(null_encoding="encode")
    index = _index(entries)
    return coded.indices, [index.get(x, missing) for x in coded.dictionary.to_pylist()]


def _chained(df: DataFrame, table: DataFrame, key: str, value: str, out: str, start: Column, step: Callable) -> DataFrame:
    """``out`` = ``start``, then ``step(part, out)`` for each part of the table."""
    ship_package(df.sparkSession)
    df = df.withColumn(out, start)
    for i, part in enumerate(_parts(table, key, value)):
        if i and i % PARTS_AT_ONCE == 0:
            if df.isStreaming:
                raise ValueError("the table takes too many parts to look up in a stream")
            df = cut_lineage(df)
        df = df.withColumn(out, step(part, F.col(out)))
    return df


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, source: Column, out: str, missing: Any,
           value_type: str = "int") -> DataFrame:
    """Adds ``out``: the array ``source`` with each element replaced by the table's value for it, or ``missing``."""
    arrow = {"int": pa.int32(), "string": pa.string()}[value_type]

    def step(part, sofar: Column) -> Column:
        @F.arrow_udf(f"array<{value_type}>")
        def replaced(lists: pa.Array, before: pa.Array) -> pa.Array:
            elements, _, lengths = _flat(lists)
            codes, values = _found(elements, part.value, None)
            found = pc.take(pa.array(values, arrow), codes)
            earlier = _flat(before)[0]
            if len(earlier) == len(found):          # what an earlier part has found stays
                found = pc.coalesce(found, earlier)
            return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), found)

        return replaced(source, sofar)

    done = _chained(df, table, key, value, out, F.lit(None).cast(f"array<{value_type}>"), step)
    return done.withColumn(out, F.transform(out, lambda x: F.coalesce(x, F.lit(missing))))


def lookup_sum(df: DataFrame, table: DataFrame, key: str, value: str, source: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of the table's values for the elements of the array ``source`` (0.0 without any)."""

    def step(part, sofar: Column) -> Column:
        @F.arrow_udf("double")
        def summed(lists: pa.Array) -> pa.Array:
            elements, row, lengths = _flat(lists)
            codes, values = _found(elements, part.value, 0.0)
            weights = np.array(values, float)[codes.to_numpy(zero_copy_only=False)] if len(codes) else np.zeros(0)
            return pa.array(np.bincount(row, weights, len(lengths)) if len(lengths) else np.zeros(0))

        return sofar + summed(source)

    return _chained(df, table, key, value, out, F.lit(0.0), step)
