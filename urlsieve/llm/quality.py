"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with a temperature.

Random indexing: each word bucket owns a sparse random index vector (``NONZERO`` entries of +1 or -1, from a hash); a
word's vector is the sum of the index vectors of its neighbours, itself included, over the whole corpus.  Words are
hashed to ``BUCKETS`` buckets, so the word vectors are a table of fixed size (1 MB) that is summed in integers by an
ordinary grouped sum and may be sent to every task.  Tokens are runs of letters, digits, marks or line feeds, with case;
a word equal to the one before it is a token of its own kind.

A document's features are the mean of its tokens' vectors.  A network of one hidden layer is fitted on the driver to a
bounded sample of labelled ids (``max_labels``, those of least id hash), one row each, and its temperature to labelled rows
that the fit did not see.  Scoring reads nothing but the text.

Defined cases: null and empty texts have the zero vector and get the network's score for it; labels that are null,
not 0 or 1, or contradictory for one id are not used; of rows that share a labelled id the one of least text hash is fitted; an empty table gives an empty result; without usable labels of
both kinds the fit raises ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsieve.llm.anchors import BYTE_UNITS, _sums, mix
from urlsieve.llm.common import materialise, sliced, utf8

BUCKETS, DIMS, NONZERO, REACH = 1 << 13, 32, 2, 2
THRESHOLD = 0.7
MAX_LABELS = 20_000
_CHUNK = 1 << 20

_CLASS = np.full(256, 3, np.uint8)  # marks
_CLASS[[9, 11, 12, 13, 32]] = 0
_CLASS[10] = 4
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[128:] = 1


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each bucket's index vector."""
    h = mix(np.arange(1, BUCKETS * NONZERO + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(BUCKETS, NONZERO)
    return (h % np.uint64(DIMS)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def tokens(data: bytes) -> np.ndarray:
    """Bucket of each token of a text."""
    out = []
    for at in range(0, len(data), _CHUNK):  # a run across a chunk edge counts as two
        x = np.frombuffer(data, np.uint8, min(_CHUNK, len(data) - at), at)
        kind = _CLASS[x]
        first = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
        last = np.r_[first[1:], len(x)]
        word = kind[first] > 0
        first, last = first[word], last[word]
        sums, inverse = _sums(BYTE_UNITS[x])
        hashes = mix((sums[last] - sums[first]) * inverse[first])
        bucket = (hashes % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
        bucket[1:][hashes[1:] == hashes[:-1]] = 0
        out.append(bucket)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's share of every bucket's vector."""
    places, signs = index_vectors()
    total = np.zeros(BUCKETS * DIMS)

    def add(texts: list[np.ndarray]) -> None:
        gap = np.full(REACH, -1)
        row = np.concatenate([y for x in texts for y in (x, gap)])
        for shift in range(-REACH, REACH + 1):
            a, b = (row[shift:], row[: len(row) - shift]) if shift >= 0 else (row[:shift], row[-shift:])
            both = (a >= 0) & (b >= 0)
            a, b = a[both], b[both]
            for j in range(NONZERO):
                total[:] += np.bincount(a * DIMS + places[b, j], signs[b, j], BUCKETS * DIMS)

    held, size = [], 0
    for batch in sliced(batches):
        for data in utf8(batch.column(0)):
            held.append(tokens(data))
            size += len(held[-1])
            if size >= 200_000:
                add(held)
                held, size = [], 0
    if held:
        add(held)
    sums = total.astype(np.int64).reshape(BUCKETS, DIMS)
    some = np.flatnonzero(sums.any(axis=1))
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(sums[some, j]) for j in range(DIMS))],
                                         names=["bucket", *(f"v{j}" for j in range(DIMS))])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit-length vector of each bucket, from all of ``docs``."""
    names = [f"v{j}" for j in range(DIMS)]
    parts = docs.select(F.col(text_col).alias("t")).mapInArrow(_contexts, ", ".join(f"{n} long" for n in ["bucket", *names]))
    sums = materialise(parts.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)), "vectors").toPandas()
    vectors = np.zeros((BUCKETS, DIMS))
    vectors[sums["bucket"].to_numpy()] = sums[names].to_numpy(float)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1)).astype(np.float32)


def pooled(data: bytes, vectors: np.ndarray) -> np.ndarray:
    buckets = tokens(data)
    if not len(buckets):
        return np.zeros(DIMS, np.float32)
    total = np.zeros(DIMS)
    for at in range(0, len(buckets), 1 << 16):
        total += vectors[buckets[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
    return (total / len(buckets)).astype(np.float32)


@dataclass
class Network:
    """Two layers: tanh units, then one logit, divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4, seed: int = 42) -> Network:
    """Adam on the logistic loss, in batches of 256."""
    rng = np.random.default_rng(seed)
    scale = np.maximum(x.std(axis=0), 1e-6)
    net = Network(x.mean(axis=0), scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
                  rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    z = (x - net.mean) / scale
    for epoch in range(epochs):
        now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        order = rng.permutation(len(z))
        for at in range(0, len(z), 256):
            rows = order[at : at + 256]
            h = np.tanh(z[rows] @ params[0] + params[1])
            error = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -500, 500))) - y[rows]) / len(rows)
            back = np.outer(error, params[2]) * (1 - h * h)
            grads = [z[rows].T @ back + decay * params[0], back.sum(axis=0), h.T @ error + decay * params[2], np.array([error.sum()])]
            step += 1
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                p -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(params[3][0])
    return net


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least logistic loss on held-back rows, by golden-section search over its log."""

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    low, high, ratio = np.log(0.5), np.log(20), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _feature_rows(vectors: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = [pooled(d, vectors) for d in utf8(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(x, pa.list_(pa.float32()))], names=["id", "y", "h", "x"])

    return rows


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network

    def score(self, docs: DataFrame, text_col: str = "text", score_col: str = "score") -> DataFrame:
        """All columns of ``docs`` and the score."""
        model, at, names = docs.sparkSession.sparkContext.broadcast(self), docs.columns.index(text_col), [*docs.columns, score_col]

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = model.value
            for batch in sliced(batches):
                x = np.array([pooled(d, m.vectors) for d in utf8(batch.column(at))]).reshape(-1, DIMS)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m.network.scores(x), pa.float64())], names=names)

        from pyspark.sql import types as T

        return docs.mapInArrow(rows, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_labels: int = MAX_LABELS, folds: int = 4, fold: int = 2) -> QualityModel:
    """Word vectors from all of ``docs``; the network from one row each of at most ``max_labels`` labelled ids outside the
    held-out fold, a quarter of them (by id hash) kept for the temperature."""
    vectors = word_vectors(docs, text_col)
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    usable = usable.where(~held_out(F.col("id"), folds, fold)).groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z")
    sample = materialise(usable.select("id", "y").orderBy(F.xxhash64("id"), "id").limit(max_labels), "labelled")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    rows = texts.join(F.broadcast(sample), "id").select("id", "y", F.xxhash64("t").alias("h"), "t")  # at most max_labels rows are broadcast
    rows = rows.mapInArrow(_feature_rows(vectors), f"id {docs.schema[id_col].dataType.simpleString()}, y int, h long, x array<float>")
    rows = rows.groupBy("id", "y").agg(F.min(F.struct("h", "x")).alias("least")).select("id", "y", F.col("least.x").alias("x"))  # and collected
    got = rows.withColumn("late", F.pmod(F.xxhash64(F.lit("temperature"), "id"), F.lit(4)) == 0).orderBy("id", "x").toPandas()
    y = got["y"].to_numpy(float)
    if len(set(y)) < 2:
        raise ValueError("labelled rows of both kinds are needed")
    x, late = np.stack(got["x"].to_numpy()).astype(float), got["late"].to_numpy()
    if len(set(y[~late])) < 2 or not late.any():
        late = np.zeros(len(y), bool)
    network = fit(x[~late], y[~late])
    if late.any():
        network.temperature = temperature(network.logits(x[late]), y[late])
    return QualityModel(vectors, network)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) per row of ``docs``."""
    if not docs.select(id_col).head(1):
        empty = docs.select(F.col(id_col), F.lit(False).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
        return empty.limit(0)
    model = train(docs, labels, id_col, text_col)
    scored = model.score(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "t")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
