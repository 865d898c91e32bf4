"""Exact ranks, cut points and running aggregates without one-task windows.

``row_number() over (order by k)`` with no partition (or partitioned by a
two-valued label, or by a run holding most rows) runs in one or two tasks.
The helpers here give the same results as the plain windows:

* :func:`distributed_rank` -- the order is cut into buckets by a column that
  never decreases along it; per-bucket counts (bounded by the bucket count)
  give offsets and the row number runs inside (partition, bucket) groups.
* :func:`with_segments` -- when only a few cut ranks matter (samples,
  splits): the cut keys of all partition values are found together by radix
  selection over the key's digits, and rows compare with a table of them.
* :func:`quantile_cells` -- buckets of about equal counts along an order,
  whatever its distribution, from a quantile sketch.
* :func:`partition_rank`, :func:`hot_cells` -- per-partition ranks that cut
  only the hot partition values (more than a million rows) into cells.
* :func:`running_agg` -- running min/max/sum with a carry from earlier cells.
* :func:`join_on` -- null-safe joins.  Small tables are written first, so Spark
  knows their size and decides what to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

HASH_BUCKET_HEX = 4       # md5 order keys: 16^4 = 65,536 buckets
CELLS, SKETCH_K = 512, 4096     # cells of about equal counts; the sketch errs by less than half a cell
RADIX_HEX = 2             # digits of an md5 key that a round of radix selection reads
SORT_ROWS = 1_000_000     # rows of one partition value that a task sorts at the end of it


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` with null-safe equality (a null partition value
    is a group of its own, as in a SQL window)."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def md5_order_key(seed: int, key) -> Column:
    """Reproducible shuffle key: md5 of ``seed|key`` (same text in DuckDB)."""
    k = F.col(key) if isinstance(key, str) else key
    missing = F.raise_error(F.lit("a row id is null: seeded orders need one on every row")).cast("string")
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(k.cast("string"), missing)))


def hash_bucket(order_key: Column, hex_digits: int = HASH_BUCKET_HEX) -> Column:
    """Bucket = leading hex digits of an md5 order key (monotone in the key)."""
    return F.conv(F.substring(order_key, 1, hex_digits), 16, 10).cast("int")


def _search(bounds: Column, value: Column, cells: int) -> Column:
    """How many of the ascending ``bounds`` are at most ``value`` (binary search)."""
    steps = [1 << i for i in reversed(range((cells - 1).bit_length()))]
    fits = lambda at, s: (at + s <= F.size(bounds)) & (F.get(bounds, at + s - 1) <= value)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(fits(at, s), at + s).otherwise(at))


def _bounds(value: Column, cells: int) -> Column:
    """Aggregate: ``cells - 1`` values that cut the rows into parts of about equal counts."""
    ranks = F.expr("array(" + ", ".join(f"{i / cells!r}D" for i in range(1, cells)) + ")")
    return F.kll_sketch_get_quantile_bigint(F.kll_sketch_agg_bigint(value, SKETCH_K), ranks)


def quantile_cells(df: DataFrame, value: str, tie: str | None = None, part: Sequence[str] = (),
                   cells: int | None = None, out: str = "_bkt") -> DataFrame:
    """Adds ``out``: a number that never decreases along (``value``, ``tie``) within a
    partition value, and that each partition value's rows share about equally.

    The cuts are quantiles of ``value`` from a KLL sketch, so bursts and outliers do not
    matter.  A value that fills more than a cell alone is cut further by the quantiles of
    ``tie`` among its rows.  Both columns must be integers without nulls.  One row of
    bounds per partition value, one per heavy value (at most ``cells`` of a partition value).
    """
    cells, part = cells or CELLS, list(part)
    v = F.col(value).cast("long")
    bounds = df.groupBy(*part).agg(_bounds(v, cells).alias("_bounds"))
    if part:
        bounds = cut_lineage(bounds)
        tagged = join_on(df, bounds, part, "left")
    else:       # one array of ``cells - 1`` numbers
        found = bounds.first()[0] or []
        tagged = df.withColumn("_bounds", F.expr("array(" + ", ".join(f"{x}L" for x in found) + ")").cast("array<bigint>"))
    tagged = tagged.withColumn(out, _search(F.col("_bounds"), v, cells).cast("long") * (cells + 1)).drop("_bounds")
    if tie is None:
        return tagged
    if part:
        twice = F.array_distinct(F.filter("_bounds", lambda x, i: (i > 0) & (F.get("_bounds", i - 1) == x)))
        heavy = bounds.select(*part, F.explode(twice).alias("_heavy"))
        if not heavy.head(1):
            return tagged
    else:
        values = sorted({(x,) for x, y in zip(found, found[1:]) if x == y})
        if not values:
            return tagged
        heavy = df.sparkSession.createDataFrame(values, "_heavy long")
    t = F.col(tie).cast("long")
    inner = join_on(df.select(*part, v.alias("_heavy"), t.alias("_t")), heavy, [*part, "_heavy"])
    inner = cut_lineage(inner.groupBy(*part, "_heavy").agg(_bounds(F.col("_t"), cells).alias("_inner")))
    tagged = join_on(tagged.withColumn("_heavy", v), inner, [*part, "_heavy"], "left")
    sub = F.when(F.col("_inner").isNull(), F.lit(cells)).otherwise(_search(F.col("_inner"), t, cells))
    return tagged.withColumn(out, F.col(out) + sub).drop("_heavy", "_inner")


def distributed_rank(df: DataFrame, order: Sequence[Column | str], bucket: Column,
                     partition_by: Sequence[str] = (), rank_col: str = "rank",
                     keep_below: int | None = None) -> DataFrame:
    """Add ``rank_col`` = row_number() over (partition by … order by …).

    ``bucket`` must be non-decreasing along ``order`` within a partition.
    ``keep_below``: drop rows whose rank would exceed it before the per-bucket
    window runs (buckets that start past the limit never get sorted).
    """
    part = list(partition_by)
    b = df.withColumn("_bkt", bucket)
    counts = b.groupBy(*part, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*part).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part, "_bkt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    if keep_below is not None:
        offsets = offsets.where(F.col("_off") < keep_below)
    # offsets has at most (#partition values x #buckets) rows.  Without partition columns
    # that is the number of buckets, which this module bounds (65,536 hash buckets, CELLS^2
    # cells); with them it is written, so that Spark knows its size and decides
    joined = join_on(b, cut_lineage(offsets) if part else F.broadcast(offsets), [*part, "_bkt"])
    within = Window.partitionBy(*part, "_bkt").orderBy(*order)
    out = joined.withColumn(rank_col, F.col("_off") + F.row_number().over(within))
    if keep_below is not None:
        out = out.where(F.col(rank_col) <= keep_below)
    return out.drop("_bkt", "_off")


def running_agg(df: DataFrame, partition_by: Sequence[str], order: Sequence[str], bucket: Column,
                value: str, fn: str = "min", out: str = "running", exclusive: bool = True) -> DataFrame:
    """Running min / max / sum of ``value`` along ``order`` within a partition,
    computed in (partition, bucket) groups plus a carry from earlier buckets.

    ``exclusive``: rows strictly before the current one (null for the first).
    The carry table has at most (#partitions x #buckets) rows and one window
    group per partition of at most #buckets rows, so a partition holding most
    of the data is still spread over every bucket.
    """
    agg = {"min": F.min, "max": F.max, "sum": F.sum}[fn]
    part = list(partition_by)
    b = df.withColumn("_bkt", bucket)
    per = b.groupBy(*part, "_bkt").agg(agg(value).alias("_bv"))
    prev = Window.partitionBy(*part).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    # only cells with an earlier cell carry a value: single-cell partitions drop out here
    carry = per.select(*part, "_bkt", agg("_bv").over(prev).alias("_carry")).where(F.col("_carry").isNotNull())
    j = join_on(b, cut_lineage(carry), [*part, "_bkt"], "left")
    end = -1 if exclusive else Window.currentRow
    w = Window.partitionBy(*part, "_bkt").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    inner = agg(value).over(w)
    if fn == "min":
        comb = F.least(inner, F.col("_carry"))
    elif fn == "max":
        comb = F.greatest(inner, F.col("_carry"))
    else:
        comb = F.coalesce(inner, F.lit(0)) + F.coalesce(F.col("_carry"), F.lit(0))
    return j.withColumn(out, comb).drop("_bkt", "_carry")


def cut_table(df: DataFrame, key: str, tie: str, partition_by: Sequence[str], cut_ranks,
              sort_rows: int | None = None) -> DataFrame:
    """(partition columns, _k0, _t0, _k1, _t1, …): the (key, tie) at each cut rank of each partition value.

    Radix selection for all partition values and cuts at once.  A round counts the rows
    of the cells that hold a cut by the key's next digits, which finds each cut's next
    cell and its rank there; only rows of those cells go on to the next round (one in
    256 per cut), until a cell is small enough to sort.  The table itself is read twice:
    for the first counts, and for the rows of the first cells.  ``key`` is a hex digest.
    A cut rank below 1 gives an empty key (all rows above), one past the end null (none).
    """
    limit = sort_rows or SORT_ROWS
    part = list(partition_by) or ["_all"]           # without partition columns all rows are of one value
    own = [F.col(c) for c in partition_by] or [F.lit(0).alias("_all")]
    rows = df.select(*own, F.col(key).alias("_key"), F.col(tie).alias("_tie"))
    digits, cuts = 0, None
    while True:
        digits += RADIX_HEX
        cell, previous = F.substring("_key", 1, digits), F.substring("_key", 1, digits - RADIX_HEX)
        counts = rows.groupBy(*part, previous.alias("_prefix"), cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
        group = Window.partitionBy(*part, "_prefix")
        before = group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        if cuts is None:
            ranks = [c.cast("long") for c in cut_ranks(F.col("_total"))]
            found = offsets.withColumn("_total", F.sum("_n").over(group)).select("*", F.posexplode(F.array(*ranks)).alias("_cut", "_rank"))
        else:
            found = join_on(offsets, cuts.drop("_n"), [*part, "_prefix"])
        here = (F.col("_rank") > F.col("_off")) & (F.col("_rank") <= F.col("_off") + F.col("_n"))
        found = found.where(here | ((F.col("_rank") <= 0) & (F.col("_off") == 0)))      # the latter: above every row
        cuts = cut_lineage(found.select(*part, F.when(F.col("_rank") > 0, F.col("_cell")).otherwise("").alias("_prefix"), "_cut",
                                        F.when(F.col("_rank") > 0, F.col("_rank") - F.col("_off")).otherwise(0).alias("_rank"), "_n")
                           if digits == RADIX_HEX else
                           found.select(*part, F.col("_cell").alias("_prefix"), "_cut", (F.col("_rank") - F.col("_off")).alias("_rank"), "_n"))
        if digits == RADIX_HEX:
            all_cuts, cuts = cuts, cuts.where("_rank > 0")
        cells = cuts.select(*part, "_prefix").distinct()
        rows = join_on(rows.withColumn("_prefix", cell), cells, [*part, "_prefix"], "left_semi").drop("_prefix")
        if (cuts.agg(F.max("_n")).first()[0] or 0) <= limit or digits >= 32:
            break
        rows = cut_lineage(rows)
    prefix = F.substring("_key", 1, digits).alias("_prefix")
    order = Window.partitionBy(*part, "_prefix").orderBy("_key", "_tie")
    sorted_rows = rows.select("*", prefix).withColumn("_rank", F.row_number().over(order).cast("long"))
    at = join_on(sorted_rows, cuts.drop("_n"), [*part, "_prefix", "_rank"]).select(*part, "_cut", "_key", "_tie")
    low = all_cuts.where("_rank = 0").select(*part, "_cut", F.lit("").alias("_key"), F.lit(None).cast(df.schema[tie].dataType).alias("_tie"))
    pick = lambda c, i: F.max(F.when(F.col("_cut") == i, F.col(c)))
    picked = at.unionByName(low).groupBy(*part).agg(
        *[x for i in range(len(ranks)) for x in (pick("_key", i).alias(f"_k{i}"), pick("_tie", i).alias(f"_t{i}"))])
    return cut_lineage(picked if partition_by else picked.drop("_all"))


def with_segments(df: DataFrame, key: str, tie: str, partition_by: Sequence[str], cut_ranks,
                  out: str = "_seg", sort_rows: int | None = None) -> DataFrame:
    """Adds ``out``, the segment number of each row for rank cut points.

    Rows are ordered by (``key``, ``tie``), unique within each partition value;
    ``cut_ranks(n)`` maps the partition's row count (a Column) to a list of ranks
    r1 <= r2 <= ...  A row gets segment 0 if its rank <= r1, 1 if <= r2, and so on.
    Nothing is collected: rows compare with their partition value's row of the cut
    table (an ordinary join, which Spark broadcasts while the table's files are small;
    without partition columns it is one row, read as a scalar)."""
    part = list(partition_by)
    cuts = cut_table(df, key, tie, part, cut_ranks, sort_rows)
    names = [c for c in cuts.columns if c not in part]
    if part:
        joined = join_on(df, cuts, part, "left")
    else:
        joined = df.withColumns({c: cuts.select(c).scalar() for c in names})
    seg = F.lit(0)
    for i in range(len(names) // 2):
        k, t = F.col(f"_k{i}"), F.col(f"_t{i}")
        above = (F.col(key) > k) | ((F.col(key) == k) & (F.col(tie) > t))
        seg = seg + F.when(above, 1).otherwise(0)
    return joined.withColumn(out, seg).drop(*names)


HOT_ROWS = 1_000_000     # a partition value with more rows than this is split into cells


def hot_cells(df: DataFrame, partition_by: Sequence[str], order_num: str, hot_rows: int = HOT_ROWS,
              cells: int | None = None, out: str = "_bkt", tie: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Tag rows with a cell that splits only hot partition values.

    One count per partition value; those with more than ``hot_rows`` rows (at most
    total / hot_rows of them) get cells of about equal counts along (``order_num``,
    ``tie``) (see :func:`quantile_cells`), every other row cell 0.  Returns (tagged
    rows, hot partition values or None when there are none).
    """
    part = list(partition_by)
    sizes = df.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    hot = cut_lineage(sizes.where(F.col("_n") > hot_rows).select(*part))
    if hot.limit(1).count() == 0:
        return df.withColumn(out, F.lit(0).cast("long")), None
    split = quantile_cells(join_on(df, hot, part, "left_semi"), order_num, tie, part, cells, out)
    rest = join_on(df, hot, part, "left_anti").withColumn(out, F.lit(0).cast("long"))
    return rest.unionByName(split), hot


def partition_rank(df: DataFrame, partition_by: Sequence[str], order: Sequence[str], order_num: str,
                   rank_col: str = "rank", hot_rows: int = HOT_ROWS, cells: int | None = None,
                   tie: str | None = None) -> DataFrame:
    """row_number() over (partition by … order by …), splitting only the hot
    partition values (see :func:`hot_cells`); only their cells get offsets,
    every other value is numbered inside its own single group.
    ``order_num`` (then ``tie``, where given) must be integers that never decrease along ``order``."""
    part = list(partition_by)
    tagged, hot = hot_cells(df, part, order_num, hot_rows, cells, tie=tie)
    if hot is None:
        w = Window.partitionBy(*part).orderBy(*order)
        return df.withColumn(rank_col, F.row_number().over(w).cast("long"))
    counts = join_on(tagged.select(*part, "_bkt"), hot, part).groupBy(*part, "_bkt").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*part).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(counts.select(*part, "_bkt", F.coalesce(F.sum("_c").over(before), F.lit(0))
                                        .alias("_off")))
    joined = join_on(tagged, offsets, [*part, "_bkt"], "left")
    within = Window.partitionBy(*part, "_bkt").orderBy(*order)
    ranked = joined.withColumn(rank_col, F.coalesce(F.col("_off"), F.lit(0)) + F.row_number().over(within))
    return ranked.drop("_bkt", "_off")
