"""The training-data pipeline over ``documents``: quality, near copies, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that ``run`` writes to the shared folder and reads again as
the next stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.llm import decontamination, packing, quality, simhash, suffix_array_dedup
from urlsieve.llm.common import materialise, read_table


def _unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.7 or more); of an empty table, none."""
    if not docs.head(1):
        return docs
    score = _unused(docs, "quality_score")
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return model.score(docs, score_col=score).where(F.col(score) >= quality.THRESHOLD).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: that with the smallest id."""
    return simhash.keep_one_per_group(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes or more that also start elsewhere; a document of nothing else goes."""
    kept, spans = _unused(docs, "kept_text"), _unused(docs, "removed_spans")
    out = suffix_array_dedup.remove_repeated_bytes(docs, kept_col=kept, spans_col=spans)
    out = out.where((F.size(spans) == 0) | (F.trim(kept) != ""))
    columns = {"text": F.col(kept), "n_chars": F.length(kept).cast("long")}
    return out.select(*(columns.get(c, F.col(c)).alias(c) for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack),
]

#: The classifier's fit and the column generation are not SQL; tests hold each stage against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
