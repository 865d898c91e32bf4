"""Seeded exact sample, stratified split, balanced down-sample.

No ``rand()``: the order of a row is ``md5(seed|row_id)``, reproducible and
the same in SQL engines.  Cut points come from radix selection over the digits
of that key (:func:`with_segments`), for all labels at once: nothing is collected,
and no step runs in one task even when one label holds most rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import distributed_rank, hash_bucket, md5_order_key, with_segments

DEFAULT_SEED = 42
DEFAULT_SAMPLE = 100_000
DEFAULT_PER_CLASS = 2_000
TEST_FRACTION_DIVISOR = 5      # test 20 %, then validation 20 % of the rest


def sample_n(df: DataFrame, n: int = DEFAULT_SAMPLE, seed: int = DEFAULT_SEED,
             row_id: str = "row_id") -> DataFrame:
    """Exactly ``n`` rows if the table is larger, else all rows.

    The n-th smallest md5 key is found by radix selection; the sample is then a filter."""
    keyed = df.withColumn("_k", md5_order_key(seed, row_id))
    return with_segments(keyed, "_k", row_id, [], lambda total: [F.lit(n)]).where("_seg = 0").drop("_k", "_seg")


def stratified_split(df: DataFrame, seed: int = DEFAULT_SEED, label: str = "label",
                     row_id: str = "row_id") -> DataFrame:
    """Per label, first ceil(n/5) by md5 order -> test, next
    ceil((n - test)/5) -> validation, rest -> train.  Adds ``split``.

    Rows compare with the two cut keys of their label, a table that is joined."""
    d = TEST_FRACTION_DIVISOR

    def cuts(total):
        t = F.ceil(total / d)
        return [t, t + F.ceil((total - t) / d)]

    keyed = df.withColumn("_k", md5_order_key(seed, row_id))
    seg = F.col("_seg")
    split = F.when(seg == 0, "test").when(seg == 1, "validation").otherwise("train")
    return with_segments(keyed, "_k", row_id, [label], cuts).withColumn("split", split).drop("_k", "_seg")


def balanced_sample(df: DataFrame, per_class: int = DEFAULT_PER_CLASS, seed: int = DEFAULT_SEED,
                    label: str = "label", row_id: str = "row_id", labels=(0, 1)) -> DataFrame:
    """At most ``per_class`` rows of each of ``labels``; rows with another label
    are of no class and go (a filter on per-label cut
    keys), then a reproducible shuffle position (``position``, 1-based) over
    the union -- at most labels x per_class rows."""
    keyed = df.where(F.col(label).isin(*labels)).withColumn("_k", md5_order_key(seed, row_id))
    picked = with_segments(keyed, "_k", row_id, [label], lambda total: [F.lit(per_class)]).where("_seg = 0").drop("_k", "_seg")
    picked = picked.withColumn("_k", md5_order_key(seed + 1, row_id))
    shuffled = distributed_rank(picked, ["_k", row_id], hash_bucket(F.col("_k")), rank_col="position")
    return shuffled.drop("_k")


def sample_reduction(original: DataFrame, sampled: DataFrame, label: str = "label") -> DataFrame:
    """Sizes before and after, per class after, and % reduction, in one
    aggregate over the tagged union (no join)."""
    u = (original.select(F.lit(0).alias("_s"), F.col(label).alias("_l"))
         .unionByName(sampled.select(F.lit(1).alias("_s"), F.col(label).alias("_l"))))
    agg = u.agg(
        F.count(F.when(F.col("_s") == 0, 1)).alias("original_rows"),
        F.count(F.when(F.col("_s") == 1, 1)).alias("sampled_rows"),
        F.count(F.when((F.col("_s") == 1) & (F.col("_l") == 1), 1)).alias("sampled_positives"),
        F.count(F.when((F.col("_s") == 1) & (F.col("_l") == 0), 1)).alias("sampled_negatives"))
    red = F.coalesce(F.try_divide(F.col("sampled_rows").cast("double"), F.col("original_rows")), F.lit(1.0))
    return agg.withColumn("reduction_pct", (F.lit(1.0) - red) * F.lit(100.0))
