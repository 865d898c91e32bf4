"""Whole-corpus search for repeated windows of ``length`` units (bytes or words), shared by the two removal operators.

Ranks are assigned to synchronised positions (see ``anchors``) instead of all positions:

1. Rank by the chosen gram.  A domain whose gram occurs once is unique and leaves: none of its windows repeats.
2. Rerank by the whole stretch that the domain's windows cover (past the threshold).  A stretch that occurs more than
   once repeats with all of its windows.
3. Stretches that occur once but share their gram (edges of a shared passage, edits of near copies) are resolved window by
   window among the distinct stretches of one gram.  How is the caller's choice (``resolve``), for a gram with at most
   ``HOT`` distinct stretches.  The stretches of a gram with more are spread over the cluster and reranked twice more:
   by the units that ``BLOCK`` neighbouring windows share (unique: all of them leave; equal over all that they cover:
   all of them repeat), then by the windows of the blocks still undecided.

Grams are compared by a rolling hash, which only decides what meets: whatever then counts as equal is equal in the 64-bit
XXH3 of its bytes, too, which is not algebraic and sees every byte (stretches, blocks and windows; windows resolved
within one task are first found by their rolling hash).  Rows are grouped by gram with map-side partial aggregates, and the join back is an ordinary
equi-join that adaptive execution splits when a gram is in a large share of the rows.  Texts are moved compressed,
once for all documents and once more for those with undecided stretches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlsieve.llm import anchors
from urlsieve.llm.common import Batches, materialise, merge_spans, sliced, text_key, utf8

#: Distinct stretches of one gram up to which one task resolves them together.
HOT = 2048
#: Stretches that a task resolves together, apart from those of one gram (a stretch has up to ``length`` windows).
TOGETHER = 4000
#: Neighbouring windows that are ranked together first where a gram has more.
BLOCK = 8


class ByteUnits:
    """A text as its UTF-8 bytes."""

    @staticmethod
    def units(data: bytes) -> np.ndarray:
        return anchors.BYTE_UNITS[np.frombuffer(data, np.uint8)]

    @staticmethod
    def split(data: bytes) -> bytes:
        return data

    @staticmethod
    def hashes(parts: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each stretch of units."""
        digest = xxhash.xxh3_64_intdigest
        return np.array([digest(parts[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64).view(np.int64)

    @staticmethod
    def cut(parts: bytes, start: int, end: int) -> bytes:
        return parts[start:end]

    @staticmethod
    def without(parts: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
        edges = zip([0, *ends.tolist()], [*starts.tolist(), len(parts)], strict=True)
        return b"".join(parts[a:b] for a, b in edges)


class WordUnits:
    """A text as its words: runs of bytes other than 0x20 and 0x09-0x0D."""

    @staticmethod
    def units(data: bytes) -> np.ndarray:
        return np.array(list(map(xxhash.xxh64_intdigest, data.split())), np.uint64)

    @staticmethod
    def split(data: bytes) -> list[bytes]:
        return data.split()

    @staticmethod
    def hashes(parts: list[bytes], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each stretch of units: of its words joined by spaces, which no word holds."""
        at = np.r_[0, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)]
        return ByteUnits.hashes(b" ".join(parts), at[starts], at[ends] - 1)

    @staticmethod
    def cut(parts: list[bytes], start: int, end: int) -> bytes:
        return b" ".join(parts[start:end])

    @staticmethod
    def without(parts: list[bytes], starts: np.ndarray, ends: np.ndarray) -> bytes:
        edges = zip([0, *ends.tolist()], [*starts.tolist(), len(parts)], strict=True)
        return b" ".join(w for a, b in edges for w in parts[a:b])


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """The id itself where ids are unique, else the hash of (id, text): equal rows then share a key, and their spans."""
    ids = docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n"))
    integer = isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType))
    if integer and not ids.where("id is null or n > 1").head(1):
        return F.col(id_col).cast("long")
    return text_key(F.col(id_col), F.col(text_col))


def _domain_rows(unit, length: int) -> Callable:
    schema = pa.schema([("k", pa.int64()), ("g", pa.int64()), ("c", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batches(schema)
        for batch in sliced(batches):
            for k, data in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                lo, hi, g = anchors.domains(unit.units(data), length)
                c = unit.hashes(unit.split(data), lo, hi + length) if len(lo) else g
                yield from out.add(np.full(len(lo), k, np.int64), g, c, lo, hi)
        yield from out.flush()

    return rows


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, as compressed bytes."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in sliced(batches):
        z = pa.array([pack(x) for x in utf8(batch.column(batch.num_columns - 1))], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], z], names=batch.schema.names)


def _groups(batches: Iterator[pa.RecordBatch], many: int = TOGETHER) -> Iterator[list[tuple]]:
    """Rows sorted by their first column, in lists that hold whole groups and about ``many`` rows, whatever a batch holds."""
    held: list[tuple] = []
    for batch in sliced(batches, rows=max(many // 4, 1)):
        held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
        if len(held) >= many:
            at = len(held) - 1
            while at and held[at - 1][0] == held[-1][0]:
                at -= 1
            if at:
                yield held[:at]
                held = held[at:]
    if held:
        yield held


def _twice(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which pairs occur more than once."""
    order = np.lexsort((h, g))
    same = (g[order][1:] == g[order][:-1]) & (h[order][1:] == h[order][:-1])
    hit = np.zeros(len(order), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    return hit


def equal_windows(unit, length: int) -> Callable:
    """Resolver: windows of one gram's stretches with equal hashes, found by sorting (gram, window) pairs."""

    def repeated(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        hashes = [anchors.window_hashes(unit.units(r[3]), length) for r in rows]
        n = np.array([len(h) for h in hashes])
        row = np.repeat(np.arange(len(rows)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        g, h = np.array([r[0] for r in rows], np.int64)[row], np.concatenate(hashes)
        hit = _twice(g, h)
        found = np.flatnonzero(hit)     # candidates get the hash of their bytes; they come row by row
        for own in np.split(found, np.flatnonzero(np.diff(row[found])) + 1) if len(found) else []:
            h[own] = unit.hashes(unit.split(rows[row[own[0]]][3]), at[own], at[own] + length)
        hit[found] = _twice(g[found], h[found])
        yield from zip(row[hit].tolist(), at[hit].tolist(), strict=True)

    return repeated


def _resolved(repeated: Callable) -> Callable:
    schema = pa.schema([("k", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batches(schema)
        for held in _groups(batches):
            held = list({(r[0], r[1], r[2]): r for r in held}.values())  # equal rows of the input bring equal stretches
            hits = np.array(sorted(repeated(held)), np.int64).reshape(-1, 2)
            if len(hits):  # runs of neighbouring window starts
                first = np.flatnonzero(np.r_[True, (hits[1:, 0] != hits[:-1, 0]) | (hits[1:, 1] != hits[:-1, 1] + 1)])
                last = np.r_[first[1:] - 1, len(hits) - 1]
                k, lo = (np.array([r[j] for r in held], np.int64)[hits[first, 0]] for j in (1, 2))
                yield from out.add(k, lo + hits[first, 1], lo + hits[last, 1])
        yield from out.flush()

    return rows


def _block_rows(unit, length: int) -> Callable:
    schema = pa.schema([(n, pa.int64()) for n in ("g", "b", "core", "whole", "k", "lo", "i0", "i1")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batches(schema)
        for batch in sliced(batches):
            for g, k, lo, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = unit.split(data)
                b, first, last, core, whole = anchors.blocks(unit.units(data), length, g, BLOCK, lambda a, z, p=parts: unit.hashes(p, a, z))
                same = [np.full(len(b), x, np.int64) for x in (g, k, lo)]
                yield from out.add(same[0], b, core, whole, same[1], same[2], first + lo, last + lo)
        yield from out.flush()

    return rows


def _window_rows(unit, length: int) -> Callable:
    schema = pa.schema([("g", pa.int64()), ("h", pa.int64()), ("k", pa.int64()), ("lo", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batches(schema)
        for batch in sliced(batches):
            for g, k, lo, data, open_blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.concatenate([np.arange(x["i0"], x["i1"] + 1) for x in open_blocks])
                h = unit.hashes(unit.split(data), at - lo, at - lo + length)
                yield from out.add(np.full(len(h), g, np.int64), h, np.full(len(h), k, np.int64), at)
        yield from out.flush()

    return rows


def _crowded(parts: DataFrame, unit, length: int) -> DataFrame:
    """(k, lo, hi) of repeated window starts among the stretches of grams with more than ``HOT`` of them."""
    parts = parts.select("g", "k", "lo", "data").repartition("k", "lo")
    names = "g", "b", "core"
    blocks = parts.mapInArrow(_block_rows(unit, length), ", ".join(f"{n} long" for n in (*names, "whole", "k", "lo", "i0", "i1")))
    place = F.struct("k", "i0")
    ranks = blocks.groupBy(*names).agg(F.min(place).alias("a"), F.max(place).alias("z"), F.min("whole").alias("w0"), F.max("whole").alias("w1"))
    ranks = ranks.where("a.k <> z.k or a.i0 <> z.i0").select(*names, (F.col("w0") == F.col("w1")).alias("equal"))
    ranked = materialise(blocks.join(ranks, [*names]).select("k", "lo", "i0", "i1", "equal"), "blocks")
    undecided = ranked.where("not equal").groupBy("k", "lo").agg(F.collect_set(F.struct("i0", "i1")).alias("blocks"))
    windows = parts.join(undecided, ["k", "lo"]).select("g", "k", "lo", "data", "blocks").mapInArrow(
        _window_rows(unit, length), "g long, h long, k long, lo int")
    twice = windows.groupBy("g", "h").agg(F.min(F.struct("k", "lo")).alias("a"), F.max(F.struct("k", "lo")).alias("z"))
    twice = twice.where("a.k <> z.k or a.lo <> z.lo").select("g", "h")
    found = ranked.where("equal").select("k", F.col("i0").cast("int").alias("lo"), F.col("i1").cast("int").alias("hi"))
    return found.unionByName(windows.join(twice, ["g", "h"]).select("k", "lo", F.col("lo").alias("hi")))


def _stretches(unit, length: int) -> Callable:
    schema = pa.schema([("g", pa.int64()), ("k", pa.int64()), ("lo", pa.int32()), ("data", pa.binary()), ("hot", pa.bool_())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in sliced(batches):
            held = []
            for k, z, items in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                parts = unit.split(unpack(z))
                held += [(x["g"], k, x["lo"], unit.cut(parts, x["lo"], x["hi"] + length), x["hot"]) for x in items if x["g"] is not None]
                if len(held) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)

    return rows


def _starts_to_spans(items: list[dict] | None, length: int, decided: bool) -> tuple[np.ndarray, np.ndarray]:
    own = [x for x in items or [] if not decided or x["g"] is None]
    return np.array([x["lo"] for x in own], np.int64), np.array([x["hi"] for x in own], np.int64) + length


def _finish(unit, length: int, finish: Callable, fields: list[tuple], last: bool) -> Callable:
    """(carried columns.., z, items[, more]) to carried columns.., result columns.., z and items of what is undecided."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in sliced(batches):
            carried = batch.num_columns - (3 if last else 2)
            z, items = batch.column(carried).to_pylist(), batch.column(carried + 1).to_pylist()
            more = batch.column(carried + 2).to_pylist() if last else [None] * len(z)
            results, left = [], []
            for data, found, extra in zip(z, items, more, strict=True):
                if not last and any(x["g"] is not None for x in found or []):
                    results.append(None)
                    left.append(True)
                    continue
                left.append(False)
                a, b = _starts_to_spans(found, length, True), _starts_to_spans(extra, length, False)
                starts, ends = merge_spans(np.r_[a[0], b[0]], np.r_[a[1], b[1]])
                results.append(finish(unit, unit.split(unpack(data)), starts, ends))
            columns = [pa.array([r and r[j] for r in results], kind) for j, (_, kind) in enumerate(fields)]
            names = [*batch.schema.names[:carried], *(n for n, _ in fields)]
            arrays = [*batch.columns[:carried], *columns]
            if not last:
                arrays += [pa.array([x if y else None for x, y in zip(c, left, strict=True)], batch.schema.types[carried + j])
                           for j, c in enumerate((z, items))]
                names += ["_z", "_items"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows


def remove_repeats(
    docs: DataFrame, id_col: str, text_col: str, carry: list[str], unit, length: int, finish: Callable,
    fields: list[tuple], resolve: Callable | None = None,
) -> DataFrame:
    """One row per input row: ``carry`` columns and what ``finish(unit, parts, starts, ends)`` returns for the row's
    units and the maximal runs covered by windows of ``length`` units that also start anywhere else in ``docs``.

    ``fields`` are (name, Arrow type) of the result columns; ``resolve(unit, length)`` makes the resolver of step 3.
    """
    spark = docs.sparkSession
    key = _row_key(docs, id_col, text_col)
    texts = docs.select(key.alias("k"), F.col(text_col).alias("t"))
    found = texts.mapInArrow(_domain_rows(unit, length), "k long, g long, c long, lo int, hi int")
    grams = materialise(found.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "grams")
    ranked = materialise(found.join(grams, "g").select("k", "lo", "hi", "g", "c"), "ranked")

    classes = ranked.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("k", "lo", "hi")).alias("r"))
    classes = materialise(classes, "stretches")
    sizes = classes.groupBy("g").agg((F.count("*") > HOT).alias("hot"), F.min("n").alias("least")).where("least = 1")
    none = F.lit(None).cast("long").alias("g"), F.lit(False).alias("hot")
    items = ranked.join(classes.where("n > 1").select("g", "c"), ["g", "c"]).select("k", "lo", "hi", *none)
    items = items.unionByName(classes.join(sizes, "g").select("r.k", "r.lo", "r.hi", "g", "hot"))
    items = items.groupBy("k").agg(F.collect_set(F.struct("lo", "hi", "g", "hot")).alias("_items"))

    carried = [F.col(c).alias(f"c{i}_{c}") for i, c in enumerate(carry)]  # own names, whatever the caller's columns are called
    packed = docs.select(*carried, key.alias("_k"), F.col(text_col).alias("_z"))
    names = [f"c{i}_{c}" for i, c in enumerate(carry)]
    packed_schema = T.StructType([*packed.schema.fields[:-1], T.StructField("_z", T.BinaryType())])
    joined = packed.mapInArrow(_packed, packed_schema).join(items.withColumnRenamed("k", "_k").hint("shuffle_hash"), "_k", "left")
    results = T.StructType([T.StructField(n, T.StringType() if k == pa.string() else T.BinaryType() if k == pa.binary() else
                                          T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
                                          if pa.types.is_list(k) else T.LongType()) for n, k in fields])
    joined = joined.select(*names, "_k", "_z", "_items")
    work = materialise(joined.mapInArrow(
        _finish(unit, length, finish, fields, last=False),
        T.StructType([*joined.schema.fields[:-2], *results.fields, *joined.schema.fields[-2:]])), "work")

    open_rows = work.where("_z is not null")
    parts = open_rows.select("_k", "_z", "_items").mapInArrow(
        _stretches(unit, length), "g long, k long, lo int, data binary, hot boolean")
    parts = materialise(parts, "undecided")
    cool = parts.where("not hot").select("g", "k", "lo", "data").repartition("g").sortWithinPartitions("g")
    more = cool.mapInArrow(_resolved((resolve or equal_windows)(unit, length)), "k long, lo int, hi int")
    if parts.where("hot").head(1):
        more = more.unionByName(_crowded(parts.where("hot"), unit, length))
    more = more.groupBy("k").agg(F.collect_set(F.struct("lo", "hi")).alias("_more")).withColumnRenamed("k", "_k")
    late = open_rows.select(*names, "_k", "_z", "_items").join(more.hint("shuffle_hash"), "_k", "left").select(*names, "_z", "_items", "_more")
    late = late.mapInArrow(_finish(unit, length, finish, fields, last=True),
                           T.StructType([*late.schema.fields[:-3], *results.fields]))
    done = work.where("_z is null").select(*names, *results.names)
    out = done.unionByName(late)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, carry, strict=True)), *results.names)
