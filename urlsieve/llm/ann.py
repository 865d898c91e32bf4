"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue, exact reranking.

Trees split at the median of random projections.  They are fitted on a bounded sample (``SAMPLE`` vectors of least
hash) and then index every vector.  A query keeps one queue over all trees, ordered by the summed squared margins of the
splits it would have to cross, and takes leaves from it until they hold ``share`` of the sample and ``k`` + 1 vectors of
it, or there are no more.  Vectors of a leaf meet
the queries that chose it in blocks of at most ``BLOCK`` rows a side, and are scored exactly (inner products in double
precision of the original vectors).

For the largest inner product of vectors of unequal length, the trees see each vector with one more component that
brings all to the largest length, and queries with a zero there.

``share`` sets recall against work.  Directions that are spread evenly, as in the given tables, are the hard case: the
README has the measured recall.  Equal vectors are indexed once, with the ``k`` + 1 smallest of their ids, which is all
that a result of ``k`` can hold.

Defined cases: vectors that are null, zero, or hold null or non-finite components, rows with a null id, and vectors of
other than the most common length take no part; rows with the query's id are its own; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlsieve.llm.common import materialise

TREES, LEAVES, SHARE, SAMPLE, BLOCK = 2, 128, 0.8, 1 << 16, 4096


@dataclass
class Tree:
    """Splits in breadth-first order: node i has children 2i + 1 and 2i + 2; leaves follow the splits."""

    normals: np.ndarray
    cuts: np.ndarray
    members: list[np.ndarray]  # sample rows of each leaf

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.normals.T - self.cuts

    def leaf(self, x: np.ndarray) -> np.ndarray:
        side, node, n = self.margins(x) >= 0, np.zeros(len(x), int), len(self.cuts)
        for _ in range((n + 1).bit_length() - 1):
            node = 2 * node + 1 + side[np.arange(len(x)), node]
        return node - n


def grow(sample: np.ndarray, leaves: int, seed: int) -> Tree:
    """A tree of ``leaves`` leaves (a power of two)."""
    rng = np.random.default_rng(seed)
    normals, cuts = rng.normal(size=(leaves - 1, sample.shape[1])), np.zeros(leaves - 1)
    normals /= np.linalg.norm(normals, axis=1, keepdims=True)
    rows = [np.arange(len(sample))]
    for node in range(leaves - 1):
        at = sample[rows[node]] @ normals[node]
        if len(at):  # between two values, so that rounding moves no vector
            low, high = np.partition(at, [max(len(at) // 2 - 1, 0), len(at) // 2])[[max(len(at) // 2 - 1, 0), len(at) // 2]]
            cuts[node] = (low + high) / 2 if len(at) > 1 else low - 1
        rows += [rows[node][at < cuts[node]], rows[node][at >= cuts[node]]]
    return Tree(normals, cuts, rows[leaves - 1 :])


@dataclass
class Forest:
    trees: list[Tree]
    length: float  # the largest of any vector
    size: int  # of the sample

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(self.length**2 - (x * x).sum(axis=1), 0))]

    def choose(self, query: np.ndarray, share: float, least: int) -> list[tuple[int, int]]:
        """(tree, leaf) pairs from the shared queue until they hold ``share`` of the sample and ``least`` vectors of it, or
        all pairs."""
        x = np.r_[query, 0.0][None]
        margins = [t.margins(x)[0].tolist() for t in self.trees]
        seen, queue, out = np.zeros(self.size, bool), [(0.0, t, 0) for t in range(len(self.trees))], []
        while queue and seen.sum() < max(share * self.size, least):
            cost, t, node = heapq.heappop(queue)
            own = margins[t]
            while node < len(own):
                m = own[node]
                near, far = (2 * node + 2, 2 * node + 1) if m >= 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (cost + m * m, t, far))
                node = near
            out.append((t, node - len(own)))
            seen[self.trees[t].members[node - len(own)]] = True
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _distinct(vectors: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """(v, ids): each usable vector once with its ``k`` + 1 smallest ids."""
    x = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    infinite = F.lit(float("inf"))
    rows = rows.where(~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == infinite)) & F.exists(x, lambda c: c != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head()
    rows = rows.where(F.size("v") == (common.n if common else 0)).distinct()
    order = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    return rows.withColumn("rank", order).where(F.col("rank") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def fit_forest(distinct: DataFrame, trees: int = TREES, leaves: int = LEAVES, sample: int = SAMPLE, seed: int = 42) -> Forest:
    length = distinct.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))).head()[0]
    rows = distinct.select("v").orderBy(F.xxhash64("v")).limit(sample).toArrow()
    forest = Forest([], float(np.sqrt(length or 0.0)), rows.num_rows)
    if rows.num_rows:
        lifted = forest.lifted(_matrix(rows.column(0)))
        forest.trees = [grow(lifted, leaves, seed + t) for t in range(trees)]
    return forest


def _index_rows(forest, leaves: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = forest.value.lifted(_matrix(batch.column(0)))
                at = np.stack([t.leaf(x) + i * leaves for i, t in enumerate(forest.value.trees)], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.tolist(), pa.list_(pa.int32()))], names=["v", "ids", "leaf"])

    return rows


def _query_rows(forest, leaves: int, share: float, least: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = [[t * leaves + n for t, n in forest.value.choose(q, share, least)] for q in _matrix(batch.column(1))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.list_(pa.int32()))], names=["query_id", "q", "leaf"])

    return rows


def _block_scores(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def scores(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and vectors.num_rows:
            x, ids = _matrix(vectors.column("v")), vectors.column("ids").to_pylist()
            first = np.array([i[0] for i in ids])
            q, names = _matrix(queries.column("q")), queries.column("query_id").to_pylist()
            for at in range(0, len(q), 512):
                part = q[at : at + 512] @ x.T
                bar = np.partition(part, max(len(x) - k - 1, 0), axis=1)[:, max(len(x) - k - 1, 0)]
                for row, least, name in zip(part, bar.tolist(), names[at : at + 512], strict=True):
                    near = np.flatnonzero(row >= least)  # k + 1 vectors, or more on ties
                    near = near[np.lexsort((first[near], -row[near]))][: k + 1]
                    found = [(-float(row[j]), i) for j in near.tolist() for i in ids[j] if i != name]
                    out += [(name, i, -s) for s, i in sorted(found)[:k]]
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return scores


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, trees: int = TREES,
            leaves: int = LEAVES, share: float = SHARE, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each row where ``is_query`` (a
    condition on the id as column ``id``), ties to the smaller id."""
    spark = vectors.sparkSession
    distinct = materialise(_distinct(vectors, id_col, vector_col, k), "vectors")
    forest = spark.sparkContext.broadcast(fit_forest(distinct, trees, leaves, sample))  # bounded by sample and trees
    kind = distinct.schema["v"].dataType.simpleString()
    index = distinct.mapInArrow(_index_rows(forest, leaves), f"v {kind}, ids array<long>, leaf array<int>")
    index = index.select("v", "ids", F.explode("leaf").alias("leaf"))
    wanted = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(is_query)
    usable = distinct.select("v").distinct()
    queries = wanted.join(usable, "v", "left_semi").select(F.col("id").alias("query_id"), F.col("v").alias("q")).distinct()
    # a number of partitions of its own, as adaptive execution would merge the few bytes of queries into one task
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    queries = queries.repartition(spread, "query_id").mapInArrow(
        _query_rows(forest, leaves, share, k + 1), f"query_id long, q {kind}, leaf array<int>")
    queries = materialise(queries, "queries").select("query_id", "q", F.explode("leaf").alias("leaf"))

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("int").alias(name))  # a row per leaf

    sizes = materialise(blocks(queries, "nq").join(blocks(index, "nv"), "leaf"), "leaves")
    sizes = F.broadcast(sizes)
    left = queries.join(sizes, "leaf").select(
        "leaf", F.pmod(F.xxhash64("query_id"), "nq").alias("bq"), F.explode(F.sequence(F.lit(0), F.col("nv") - 1)).alias("bv"), "query_id", "q")
    right = index.join(sizes, "leaf").select(
        "leaf", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("bq"), F.pmod(F.xxhash64("v"), "nv").alias("bv"), "v", "ids")
    keys = [F.col("leaf").cast("long"), F.col("bq").cast("long"), F.col("bv").cast("long")]
    left = left.select(F.xxhash64(*keys).alias("cell"), "query_id", "q")
    right = right.select(F.xxhash64(*keys).alias("cell"), "v", "ids")
    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(_block_scores(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
