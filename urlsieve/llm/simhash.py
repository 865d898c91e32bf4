"""SimHash near-dedup by multi-index hashing.

A document's fingerprint has a bit set where over half of its shingles' XXH64 values have it.  Fingerprints link at
``distance`` or fewer differing bits; a document's component is the smallest id reachable over links.

Multi-index hashing: the 64 bits are cut into ``segments``; fingerprints within ``distance`` bits agree in one segment
up to ``distance // segments`` bits.  So for each segment the table holds every fingerprint under its segment value,
each fingerprint probes the small Hamming ball around its own value, and matches are verified over all 64 bits.  A
link between values that differ is probed from the larger value only, so a ball of radius one costs about half.

Equal fingerprints are one class before any probing, so copies cost nothing.  A bucket with more than ``HOT`` classes
(a large family of near copies) is not paired up: its members meet instead under the points of small balls around
the rest of the fingerprint.  Two values within d bits share a point within ``d // 2`` bits of one and ``d - d // 2``
of the other, and any two that share such a point are within d bits, so linking all members of a point to one of them
gives the same components with work in proportion to the members.

Components are found by min-label propagation with pointer jumping over the link table, written out each round.

Defined cases: null and empty texts have no words and fingerprint zero, linked like any other; rows with equal ids
each get their own fingerprint; a null id takes part and its component is the smallest non-null id reachable (null if
there is none); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urlsieve.llm.common import materialise, sliced, utf8
from urlsieve.llm.components import components

SHINGLE = 3
DISTANCE = 3
SEED = 42
SEGMENTS = 2
#: Classes in one bucket up to which they are paired up.
HOT = 64

_LOWER = bytes(range(256)).lower()
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint of a UTF-8 text (A-Z lower-cased, words split at 0x20 and 0x09-0x0D)."""
    words = data.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, j], minlength=256) @ _BITS for j in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            values = np.array([fingerprint(x, shingle) for x in utf8(batch.column(batch.num_columns - 1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values)], names=[*batch.schema.names[:-1], "fp"])

    return rows


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) per row."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(
        _fingerprints(shingle), f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def _ball(bits: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` set bits, fewest first."""
    masks, ring = [0], [0]
    for _ in range(radius):
        ring = [m | 1 << b for m in ring for b in range(m.bit_length(), bits)]
        masks += ring
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, hot: int = HOT) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column ``fp``): each within ``distance`` bits, and enough of them
    that any two fingerprints within ``distance`` are connected.

    Spark sizes probes, members and visits as before their masks, many times too small, so their joins are merge joins by
    hint and never a broadcast."""
    width, radius, near = 64 // segments, distance // segments, distance // 2
    found = None
    for s in range(segments):
        bits = width if s < segments - 1 else 64 - width * (segments - 1)
        part = F.shiftrightunsigned("fp", s * width).bitwiseAND(F.lit((1 << bits) - 1))
        table = prints.select(part.alias("part"), "fp")
        masks = F.lit([m for m in _ball(bits, radius)])
        probes = table.select("part", F.explode(masks).alias("mask"), F.col("fp").alias("probe"))
        probes = probes.where(F.col("part").bitwiseXOR(F.col("mask")) <= F.col("part")).select(
            F.col("part").bitwiseXOR(F.col("mask")).alias("part"), F.bit_count("mask").alias("off"), "probe")
        crowded = table.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("part", F.lit(True).alias("crowded"))
        crowded = materialise(crowded, "crowded")
        pairs = table.join(crowded, "part", "left_anti").join(probes.hint("merge"), "part").where(
            ((F.col("off") > 0) | (F.col("fp") < F.col("probe")))
            & (F.bit_count(F.col("fp").bitwiseXOR(F.col("probe"))) <= distance))
        both = pairs.select(F.col("fp").alias("u"), F.col("probe").alias("v"))

        # crowded buckets: members and probers meet under points around the bits outside the segment
        place = [b for b in range(64) if not s * width <= b < s * width + bits]

        def spread(m: int) -> int:
            return _signed(sum(1 << place[i] for i in range(len(place)) if m >> i & 1))

        outside = _signed(~(((1 << bits) - 1) << s * width) & ((1 << 64) - 1))
        far = sorted(((m.bit_count(), spread(m)) for m in _ball(64 - bits, distance - near)))
        members = table.join(crowded, "part", "left_semi").select(
            "part", "fp", F.explode(F.lit([m for _, m in far])).alias("mask")).select(
            "part", "fp", F.col("fp").bitwiseXOR(F.col("mask")).bitwiseAND(F.lit(outside)).alias("point"),
            (F.bit_count("mask") <= near).alias("near"))
        visits = probes.where("off > 0").join(crowded, "part", "left_semi").select(
            "part", F.col("probe").alias("fp"), "off", F.explode(F.lit([m for _, m in far])).alias("mask"))
        visits = visits.where(F.bit_count("mask") + F.col("off") + near <= distance).select(
            "part", "fp", F.col("fp").bitwiseXOR(F.col("mask")).bitwiseAND(F.lit(outside)).alias("point"), F.lit(False).alias("near"))
        met = members.unionByName(visits)
        heads = members.where("near").groupBy("part", "point").agg(F.min("fp").alias("head"))
        met = met.join(heads.hint("merge"), ["part", "point"]).where("fp <> head")
        both = both.unionByName(met.select(F.col("fp").alias("u"), F.col("head").alias("v")))
        found = both if found is None else found.unionByName(both)
    return found


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                              distance: int = DISTANCE, segments: int = SEGMENTS, hot: int = HOT) -> DataFrame:
    """(id_col, fingerprint, component_id) per row of ``docs``."""
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = materialise(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = components(links(classes.select("fp"), distance, segments, hot))
    grouped = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "root").select("fp", "component_id")
    return prints.join(named.hint("merge"), "fp").select(  # all rows: several times larger in memory than written
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                       distance: int = DISTANCE) -> DataFrame:
    """One row of each group: that with the smallest id, and of rows with equal ids the one with the least text hash.  Rows
    are told apart by id and text, so rows that share an id are each kept or dropped by their own group.  Rows with a null
    id stay, as nothing names them."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    name, text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    row = F.when(name.isNotNull(), F.struct(name.alias("i"), F.xxhash64(text).alias("h")))
    groups = near_duplicate_components(own.select(row.alias("id"), text.alias("t")), "id", "t", shingle, distance)
    heads = materialise(groups.where("id = component_id").groupBy("id").agg(F.count("*").alias("n")).select("id.i", "id.h", "n"), "heads")
    kept = own.withColumn("i", name).withColumn("h", F.xxhash64(text)).join(heads.select("i", "h").hint("shuffle_hash"), ["i", "h"], "left_semi")
    if heads.where("n > 1").head(1):  # the same id and text again
        order = F.row_number().over(Window.partitionBy("i", "h").orderBy("h"))
        kept = kept.withColumn("rank", order).where("rank = 1")
    return kept.select(*names).unionByName(own.where(name.isNull())).toDF(*docs.columns)
