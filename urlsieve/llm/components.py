"""Connected components of a link table by alternating star contraction.

Each round links every node's larger neighbours, then its smaller ones, to the least node around it; stars remain
after O(log^2 n) rounds.  Every step is a grouped minimum (partial aggregates before the shuffle) and an equi-join,
and each round's links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsieve.llm.common import materialise


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).head()
    return row.n, row.s


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of a link, root being the least node of its component."""
    big, small = F.greatest(u, v), F.least(u, v)
    links = materialise(links.select(big.alias("u"), small.alias("v")).where("u <> v").distinct(), "links")
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        links = materialise(star.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        after = _state(links)
        if after == state:
            break
        state = after
    members = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
