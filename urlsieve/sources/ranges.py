"""Records of text files that many tasks read together, although a record may hold the separator.

A file is read in byte ranges ("blocks") by Spark's text source, which cuts it at every ``separator``: a line feed for CSV, a
closing brace for JSON arrays.  Whether such a cut ends a record depends on all that stands before it in the file, so:

1. every block is scanned for what it does to the state, whatever the state at its start: whether it ends inside quotes
   for either start, and how far it moves the depth of brackets;
2. these effects are composed along the blocks of each file (one row a block: a running sum since the last block that
   ends alike for both starts), which gives the state at the start of each block;
3. every block is scanned again from its known state.  Its whole records are complete; the pieces of a record that
   reaches over blocks are joined by (file, block where it starts).

The table of states has one row per block and is broadcast; the pieces of broken records come from a scan of their own,
at most two a block.  Where all files fit one task, one scan does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package

#: Characters of records that a task hands on at a time.
FLUSH_CHARS = 4 << 20


@dataclass(frozen=True)
class Csv:
    """Quotes open only at the start of a field; a doubled quote is a quote; what follows a closing quote, up to the
    next delimiter, is plain text."""

    delimiter: str = ","
    quote: str = '"'
    separator: str = "\n"

    def step(self, piece: str, inside: bool) -> tuple[bool, int]:
        """Whether the piece ends inside quotes, and its change of depth."""
        quote = self.quote
        if quote not in piece:
            return inside, 0
        at = 0
        while True:
            if inside:
                end = piece.find(quote, at)
                while end >= 0 and piece.startswith(quote, end + 1):
                    end = piece.find(quote, end + 2)
                if end < 0:
                    return True, 0
                at = piece.find(self.delimiter, end + 1) + 1
                if not at:
                    return False, 0
                inside = False
            if not piece.startswith(quote, at):
                at = piece.find(self.delimiter + quote, at) + 1
                if not at:
                    return False, 0
            inside, at = True, at + 1

    def level(self, first: str) -> int:
        return 0


@dataclass(frozen=True)
class Json:
    """Objects of one array a file, or one after the other."""

    separator: str = "}"

    def step(self, piece: str, inside: bool) -> tuple[bool, int]:
        if "\\" in piece:   # an escaped character is neither quote nor bracket
            parts = piece.replace("\\\\", "").replace('\\"', "").split('"')
        else:
            parts = piece.split('"')
        depth = sum(p.count("{") + p.count("[") - p.count("]") for p in parts[inside::2])
        inside ^= len(parts) % 2 == 0
        return inside, depth - (not inside)     # the separator itself

    def level(self, first: str) -> int:
        """Depth between the records of a file that starts like this."""
        return int(first.lstrip("﻿ \t\r\n").startswith("["))


def blocks(spark: SparkSession, path, separator: str) -> DataFrame:
    """(piece, file, block): the pieces of the files, in order within a block."""
    text = spark.read.option("lineSep", separator).text(path)
    return text.select(F.col("value").alias("piece"), F.col("_metadata.file_path").alias("file"),
                       F.col("_metadata.file_block_start").alias("block"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str], list]]:
    """(file, block), the batch's pieces of it, and its other columns' first values."""
    for batch in batches:
        pieces, places = batch.column(0).to_pylist(), list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
        at = 0
        while at < len(pieces):
            stop = at + 1
            while stop < len(pieces) and places[stop] == places[at]:
                stop += 1
            yield places[at], pieces[at:stop], [c[at].as_py() for c in batch.columns[3:]]
            at = stop


def _effects(form) -> Callable:
    """Per block: state at its end if it starts outside and inside quotes, change of depth for both, level of its file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "block", "end0", "depth0", "end1", "depth1", "level"]
        made: dict[tuple, list] = {}
        for place, pieces, _ in _runs(batches):
            e = made.setdefault(place, [False, 0, True, 0, form.level(pieces[0])])
            for piece in pieces:
                end, change = form.step(piece, e[0])
                e[0], e[1] = end, e[1] + change
                end, change = form.step(piece, e[2])
                e[2], e[3] = end, e[3] + change
        if made:
            columns = zip(*((*k, *v) for k, v in made.items()), strict=True)
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return rows


def states(pieces: DataFrame, form) -> DataFrame:
    """(file, block, inside, depth, level): the state at the start of every block."""
    effects = pieces.mapInArrow(_effects(form), "file string, block long, end0 boolean, depth0 long, end1 boolean, depth1 long, level long")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    flips = (F.col("end0") != F.lit(False)) & (F.col("end1") != F.lit(True))        # ends otherwise than it starts
    fixed = F.col("end0") == F.col("end1")                                              # ends alike for both
    counted = effects.withColumn("_flips", F.sum(F.when(~fixed & flips, 1).otherwise(0)).over(order))
    last = F.last(F.when(fixed, F.struct("end0", "_flips")), ignorenulls=True).over(before)
    counted = counted.withColumn("_fixed", last).withColumn("_so_far", F.coalesce(F.lag("_flips").over(order), F.lit(0)))
    since = F.col("_so_far") - F.coalesce(F.col("_fixed._flips"), F.lit(0))
    known = counted.withColumn("inside", F.coalesce(F.col("_fixed.end0"), F.lit(False)) != (since % 2 == 1))
    moved = F.when(F.col("inside"), F.col("depth1")).otherwise(F.col("depth0"))
    return known.select("file", "block", "inside", F.coalesce(F.sum(moved).over(before), F.lit(0)).alias("depth"),
                        F.first("level").over(order).alias("level"))


WHOLE, STARTED, CONTINUED = 0, 1, 2


def _records(form, whole: bool, alone: bool = False) -> Callable:
    """Whole records of each block (``whole``), or the pieces of those that reach over its start or end.  With ``alone``
    blocks are files, and what is left at a file's end is a record."""
    separator = form.separator

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, held, kind, first, inside, depth, level = None, [], WHOLE, False, False, 0, 0

        def flush() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["file", "block", "kind", "first", "record"])

        def left() -> None:     # the block ends within a record
            if held and (alone or not whole):
                out.append((*now, STARTED if kind == WHOLE else kind, first, separator.join(held)))

        size = 0
        for place, pieces, state in _runs(batches):
            if place != now:
                left()
                now, held = place, []
                inside, depth, level = state if state else (False, 0, form.level(pieces[0]))
                kind, first = (WHOLE if not inside and depth <= level else CONTINUED), place[1] == 0
            for piece in pieces:
                held.append(piece)
                inside, change = form.step(piece, inside)
                depth += change
                if not inside and depth <= level:
                    if whole == (kind == WHOLE):
                        out.append((*now, kind, first, separator.join(held)))
                        size += len(out[-1][4])
                    held, kind, first = [], WHOLE, False
                    if size > FLUSH_CHARS:
                        size = 0
                        yield flush()
        left()
        if out:
            yield flush()

    return rows


def records(spark: SparkSession, path, form) -> DataFrame:
    """(file, block, first, record): every record of the files, without its last separator; ``first`` marks a file's
    first record.  What follows the last record of a file counts as a record."""
    ship_package(spark)
    pieces = blocks(spark, path, form.separator)
    schema = "file string, block long, kind int, first boolean, record string"
    columns = "file", "block", "first", "record"
    if pieces.rdd.getNumPartitions() <= 1:      # of the plan; nothing runs
        return pieces.mapInArrow(_records(form, True, alone=True), schema).select(*columns)
    table = states(pieces, form).withColumnsRenamed({"file": "_f", "block": "_b"})
    known = pieces.join(F.broadcast(table), (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")), "left")
    known = known.select("piece", "file", "block", "inside", "depth", "level")
    done = known.mapInArrow(_records(form, True), schema).select(*columns)
    broken = known.mapInArrow(_records(form, False), schema)
    # of a block's two pieces the one that continues a record comes before the one that starts the next
    order = Window.partitionBy("file").orderBy("block", F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = F.last(F.when(F.col("kind") == STARTED, F.col("block")), ignorenulls=True).over(order)
    joined = broken.withColumn("_o", owner).groupBy("file", F.col("_o").alias("block")).agg(
        F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("block", F.col("kind"), "record"))).alias("p"))
    joined = joined.select("file", "block", "first", F.array_join(F.transform("p", lambda x: x["record"]), form.separator).alias("record"))
    return done.unionByName(joined)
