"""Fill-in-middle transformation as a pyarrow.compute pipeline over record batches.

Per batch: texts are split into units (lines with their line feed) as a list array, the list is flattened with the
parent row of each unit, a unit's ordinal is its place after its row's first unit, units are filtered by role (prefix,
middle, suffix), the lists of each role are rebuilt from the parents and joined to one piece a row.  The two cuts, the
form and its share come from the hex sha256 of ``<seed>:<id>``, so a row's result depends on its id and text only.

Memory follows the slice (see ``common.sliced``): at most some megabytes of text, or one text, at a time.

Defined cases: a null text is empty; an empty text, one that holds a sentinel, or one left out by ``rate`` is plain (the
text itself); a null id is hashed as an empty number; repeated rows give the same result each; an empty table gives an
empty result; other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsieve.llm.common import sliced

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _remainder(x: pa.Array, by: pa.Array | pa.Scalar) -> pa.Array:
    return pc.subtract(x, pc.multiply(pc.divide(x, by), by))


def line_units(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """Units of all texts in turn, the row of each, its ordinal in its row, and the number of units of each row."""
    lines = pc.split_pattern(texts, "\n")
    flat, parent = pc.list_flatten(lines), pc.list_parent_indices(lines)
    count = pc.list_value_length(lines).cast(pa.int64())
    before = pc.subtract(pc.cumulative_sum(count), count)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(before, parent))
    last = pc.equal(ordinal, pc.subtract(pc.take(count, parent), 1))
    unit = pc.binary_join_element_wise(flat, pc.if_else(last, "", "\n").cast(flat.type), pa.scalar("", flat.type))
    real = pc.not_equal(unit, "")  # what follows a last line feed is no unit
    unit, parent, ordinal = unit.filter(real), parent.filter(real), ordinal.filter(real)
    return unit, parent, ordinal, pa.array(np.bincount(parent.to_numpy(), minlength=len(texts)))


def _joined(unit: pa.Array, parent: pa.Array, role: pa.Array, rows: int) -> pa.Array:
    """The units of one role, joined per row."""
    sizes = np.bincount(parent.filter(role).to_numpy(), minlength=rows)
    lists = pa.LargeListArray.from_arrays(np.r_[0, np.cumsum(sizes)], unit.filter(role))
    return pc.binary_join(lists, pa.scalar("", unit.type))


def rearranged(texts: pa.Array, hashes: list[pa.Array], rate: int, spm: int) -> list[pa.Array]:
    """(n, form, prefix_chars, middle_chars, output) of texts without nulls."""
    unit, parent, ordinal, n = line_units(texts)
    a, b = (_remainder(h, pc.add(n, 1)) for h in hashes[:2])
    low, high = (pc.take(x, parent) for x in (pc.min_element_wise(a, b), pc.max_element_wise(a, b)))
    first, after = pc.less(ordinal, low), pc.greater_equal(ordinal, high)
    between = pc.and_not(pc.less(ordinal, high), first)
    prefix, middle, suffix = (_joined(unit, parent, role, len(texts)) for role in (first, between, after))

    plain = pc.or_(pc.equal(texts, ""), pc.greater_equal(_remainder(hashes[2], pa.scalar(100)), rate))
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(texts, mark))
    swapped = pc.less(_remainder(hashes[3], pa.scalar(100)), spm)
    p, s, m, none = (pa.scalar(x, texts.type) for x in (PREFIX, SUFFIX, MIDDLE, ""))
    output = pc.if_else(plain, texts, pc.if_else(
        swapped, pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none),
        pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)))
    form = pc.if_else(plain, "plain", pc.if_else(swapped, "spm", "psm"))
    chars = [pc.if_else(plain, None, pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
    return [n, form, *chars, output.cast(pa.string())]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) per row of ``docs``.

    ``rate`` is the percentage of texts that are rearranged, ``spm`` the percentage of those with the suffix first.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            # a compact copy, as some kernels misread the offsets of slices
            texts = pc.fill_null(batch.column(1).take(pa.array(np.arange(batch.num_rows))).cast(pa.large_string()), "")
            columns = rearranged(texts, batch.columns[2:], rate, spm)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    id_type = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The original text, from the output and its form alone: a rearranged output holds each sentinel once."""

    def part(text: Column, mark: str, number: int) -> Column:
        return F.split_part(text, F.lit(mark), F.lit(number))

    def tail(text: Column) -> Column:
        return F.substring(text, 1 + len(PREFIX), 2**31 - 1)

    psm = F.concat(tail(part(output, SUFFIX, 1)), part(output, MIDDLE, 2), part(part(output, SUFFIX, 2), MIDDLE, 1))
    spm = F.concat(part(part(output, PREFIX, 2), MIDDLE, 1), part(output, MIDDLE, 2), tail(part(output, PREFIX, 1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_in_middle_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """The rows of ``fill_in_middle`` with the hashes of the output and of the text rebuilt from it, instead of the output."""
    out = fill_in_middle(docs, id_col, text_col, seed, rate, spm)
    return out.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
