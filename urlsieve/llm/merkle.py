"""Merkle manifest of a dataset, with levels kept as concatenated strings.

Leaves get their place in their group's order by a range sort and counts per range.  ``BLOCK`` consecutive leaves, aligned
at multiples of it, form a block; each of its tree levels is one string of 64-digit nodes.  SQL's fixed-width substrings of
a level hash its parents, and the substrings that flank a node are its siblings.  The roots of the blocks are the leaves of
the next round, until one root a group is left; the groups' roots then form a tree of their own.  A block is a power of two
wide, so every run of two nodes lies within one block and no task holds more than a block.

Rounds go up with roots alone, then down again from the top, where each block passes the path above it to its leaves.  Blocks
are made anew for that and never written: a reader takes up thousands of rows at a time, so written rows are one leaf or one
root each, without siblings.

A node without a partner is hashed alone, at every level on which its tree still has other nodes.

Defined cases: a null in any hashed column is written ``-``; null ids come first in their group's order, the null group is
the first; rows that share an id are ordered by their leaf, and equal rows are leaves of their own; a row with a null id
is never tampered with; an empty table gives an empty result; other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlsieve.llm.common import materialise

#: Levels that one block spans, and nodes in it.
DEPTH = 8
BLOCK = 1 << DEPTH
DIGITS = 64


def _h(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` if null, else UTF-8 byte count, ``:``, value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _node(level: Column, at: Column) -> Column:
    """The node at a place of a level, empty past its end."""
    return F.substring(level, at * DIGITS + 1, F.lit(DIGITS))


def _levels(leaves: Column, height: Column) -> Column:
    """The level strings of a block, from its leaves (one string) up, ``height`` levels above them."""

    def above(level: Column) -> Column:
        runs = F.ceil(F.octet_length(level) / (2 * DIGITS)).cast("int")
        parents = F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(F.substring(level, i * (2 * DIGITS) + 1, F.lit(2 * DIGITS)), 256))
        return F.array_join(parents, "").cast("binary")

    steps = F.slice(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(1), height)
    return F.aggregate(steps, F.array(leaves), lambda made, _: F.concat(made, F.array(above(F.element_at(made, -1)))))


def _siblings(levels: Column, at: Column, height: Column) -> Column:
    """(sibling, whether it stands on the left) on each level of a block below its root, for the leaf at a place."""

    def one(i: Column) -> Column:
        place = F.call_function("shiftright", at, i)
        return F.struct(_node(F.element_at(levels, i + 1), place.bitwiseXOR(F.lit(1))).cast("string").alias("node"),
                        (place.bitwiseAND(F.lit(1)) == 1).alias("left"))

    return F.transform(F.slice(F.sequence(F.lit(0), F.lit(DEPTH - 1)), F.lit(1), height), one)


def folded(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(siblings, leaf, lambda node, s: F.when(s["left"], _h(s["node"], node)).otherwise(_h(node, s["node"])))


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with columns ``at``, the place in the group's order from 0, and ``n``, the group's rows, and written: a range
    sort gives every row a range number, counts of (group, range) the offsets, and row numbers run inside a range."""
    row = "_row"
    rows = materialise(rows.withColumn(row, F.monotonically_increasing_id()), name)  # equal rows are spread by it, too
    ranges = materialise(rows.repartitionByRange(group, *order, row).withColumn("_range", F.spark_partition_id()), name + "-ranges")
    sizes = ranges.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    offsets = sizes.select(F.col(group).alias("_g"), F.col("_range").alias("_r"),
                           (F.sum("_n").over(Window.partitionBy(group).orderBy("_range")) - F.col("_n")).alias("_before"),
                           F.sum("_n").over(Window.partitionBy(group)).alias("n"))
    inside = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order, row)) - 1
    numbered = ranges.withColumn("at", inside)
    out = numbered.join(offsets, numbered[group].eqNullSafe(offsets["_g"]) & (numbered["_range"] == offsets["_r"]))
    out = out.withColumn("at", F.col("at") + F.col("_before")).drop(row, "_range", "_g", "_r", "_before")
    return materialise(out, name + "-places")


def _blocks(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row per block of the rows (grp, at, n, node): grp, block, n, items (place in the block, node and the columns to
    keep), height, leaves as one string."""
    block = F.floor(F.col("at") / BLOCK).cast("long").alias("block")
    item = F.struct(F.pmod(F.col("at"), F.lit(BLOCK)).cast("int").alias("at"), "node", *keep)
    made = rows.groupBy("grp", block).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(item)).alias("items"))
    needed = F.ceil(F.log2(F.size("items"))).cast("int")
    made = made.withColumn("height", F.when(F.col("n") > BLOCK, F.lit(DEPTH)).otherwise(needed))
    return made.withColumn("leaves", F.array_join(F.transform("items", lambda x: x["node"]), "").cast("binary"))


def rounds(rows: DataFrame, name: str) -> list[DataFrame]:
    """``rows`` (grp, at, n, node), the roots of their blocks in the same form, the roots of those, and so on to one row a
    group."""
    out = [rows]
    while len(out) == 1 or out[-1].where("at > 0").head(1):
        root = F.element_at(_levels(F.col("leaves"), F.col("height")), -1).cast("string")
        roots = _blocks(out[-1], []).select("grp", F.col("block").alias("at"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), root.alias("node"))
        out.append(materialise(roots, f"{name}-{len(out)}"))
    return out


def proofs(made: list[DataFrame], above: DataFrame, keep: list[str]) -> DataFrame:
    """(grp, at, node, siblings, the columns to keep) per row of the first of the rounds ``made``, and the further columns of
    ``above`` (grp, at, siblings), which holds the path above each row of the last."""
    extra = [c for c in above.columns if c not in ("grp", "at", "siblings")]
    for k in range(len(made) - 2, -1, -1):
        kept = [] if k else keep
        up = above.select("grp", F.col("at").alias("block"), F.col("siblings").alias("up"), *extra)
        # Spark sizes ``up`` without its siblings, so it is never left to choose a broadcast
        blocks = _blocks(made[k], kept).join(up.hint("shuffle_hash"), ["grp", "block"])
        # the array of one binds the levels: as a column they could be put into the inner function and made for each item
        items = F.transform(F.array(_levels(F.col("leaves"), F.col("height"))), lambda levels: F.transform("items", lambda x: F.struct(
            *(x[c].alias(c) for c in ["at", "node", *kept]), F.concat(_siblings(levels, x["at"], F.col("height")), F.col("up")).alias("siblings"))))  # noqa: B023
        rows = blocks.select("grp", "block", *extra, F.explode(F.element_at(items, 1)).alias("x"))
        above = rows.select("grp", (F.col("block") * BLOCK + F.col("x.at")).alias("at"), *(f"x.{c}" for c in ["node", *kept, "siblings"]), *extra)
    return above


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang",
             columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot, root, siblings (from the leaf to the root), claim.

    ``claim`` is the leaf of the row as ``tampered`` changes it (columns by name); without it, the leaf.
    """
    leaf = _h(*(field(F.col(c)) for c in columns))
    claim = _h(*(field((tampered or {}).get(c, F.col(c))) for c in columns))
    changed = F.lit(False)
    for c, value in (tampered or {}).items():
        changed = changed | ~value.eqNullSafe(F.col(c))
    name = F.col(group_col).cast("string")
    group = F.when(name.isNull(), "").otherwise(F.concat(F.lit("+"), name))  # in the order of names, the null group first
    leaves = docs.select(F.col(id_col).alias("id"), group.alias("grp"), leaf.alias("node"), F.when(changed, claim).alias("claim"))
    trees = rounds(ranked(leaves, "grp", ["id", "node"], "leaves"), "blocks")
    subroots = trees[-1].select(F.col("grp").alias("of"), "node")
    top = rounds(ranked(subroots.withColumn("grp", F.lit("")), "grp", ["of"], "subroots"), "top")
    none = F.array().cast("array<struct<node:string,left:boolean>>")
    above = proofs(top, top[-1].select("grp", "at", none.alias("siblings"), F.col("node").alias("root")), ["of"])
    above = above.select(F.col("of").alias("grp"), F.lit(0).cast("long").alias("at"), "siblings", "root", F.col("node").alias("subroot"))
    rows = proofs(trees, above, ["id", "claim"])
    return rows.select(F.col("id").alias(id_col), F.col("node").alias("leaf"), "subroot", "root", "siblings",
                       F.coalesce("claim", "node").alias("claim"))


def verified_manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", every: int = 7) -> DataFrame:
    """The manifest's digest columns, and each row checked against the root; where ``every`` divides the crc32 of the id,
    the row checked has one character more in ``n_chars``."""
    hit = F.coalesce(F.crc32(F.col(id_col).cast("string")) % every == 0, F.lit(False))
    tampered = {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    columns = (id_col, "source", group_col, "n_chars", "text")
    rows = manifest(docs, id_col, group_col, columns, tampered)
    rows = rows.withColumn("folded_root", folded(F.col("claim"), F.col("siblings")))
    proof = F.sha2(F.array_join(F.transform("siblings", lambda s: s["node"]), ""), 256)
    return rows.select(id_col, "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))
