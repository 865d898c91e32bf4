"""Derived views over the driver tables (same definitions as the oracle SQL).

No table holds phishing labels or model answers, so labelled inputs are
derived from the given tables; every view grows with its source table.

* urls      pages:  page_id AS row_id, url, label = url LIKE '%://blog.%'
* raw_urls  pages:  page_id, url, status text (as a CSV source would give)
* texts     documents ⋈ labels: doc_id AS row_id, text, toxic AS label
* scored    orders: o_orderkey AS row_id, synthetic url, true_label, layer1_confidence
* history   events: user_id AS run_id, epoch = row number by (ts, event_id), losses
"""

from __future__ import annotations

import hashlib
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import epoch_micros
from ..operators import cascade as H
from ..operators.ranking import partition_rank
from ..session import cut_lineage

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls_of(table(spark, sf_dir, "pages"))


def urls_of(pages: DataFrame) -> DataFrame:
    """The urls view of a pages table or stream."""
    return pages.select(F.col("page_id").alias("row_id"), "url",
                        F.when(F.col("url").like("%://blog.%"), 1).otherwise(0).alias("label"))


def raw_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    status = F.when(F.col("url").like("%://blog.%"), "phishing").otherwise("legitimate")
    return p.select("page_id", "url", status.alias("status"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return d.join(lab, "doc_id").select(F.col("doc_id").alias("row_id"), "text",
                                        F.col("toxic").alias("label"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    url = F.concat(F.lit("http://c"), (F.col("o_custkey") % 500).cast("string"),
                   F.lit(".example.com/o/"), (F.col("o_orderkey") % 97).cast("string"))
    return o.select(F.col("o_orderkey").alias("row_id"), url.alias("url"),
                    (F.col("o_orderstatus") == "F").cast("int").alias("true_label"),
                    (F.col("o_totalprice") / F.lit(500000.0)).alias("layer1_confidence"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One training run per user: epoch = 1.. in (ts, event_id) order.

    The epoch number is a per-run rank; a run with more than a million events
    is cut into time cells, so even a run holding most events is numbered by
    many tasks, while small runs stay single groups."""
    e = table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("user_id").alias("run_id"), "value", "props")
    e = e.withColumn("_t", epoch_micros("ts", e.schema["ts"].dataType))
    ranked = partition_rank(e, ["run_id"], ["_t", "event_id"], "_t", rank_col="epoch", tie="event_id")
    return cut_lineage(ranked.select(
        "run_id", F.col("epoch").cast("int").alias("epoch"), "ts",
        (F.get_json_object("props", "$.k").cast("double") / F.lit(100.0)).alias("train_loss"),
        F.col("value").alias("val_loss"),
        (F.lit(1.0) / (F.lit(1.0) + F.col("value"))).alias("accuracy")))


# Answers of the rule scorer, picked by md5(url) mod 5.
RULE_ANSWERS = (
    "Phishing: suspicious keywords",
    "Legitimate: no indicators",
    "legitimate site, not phishing",
    "phishing:legitimate: unclear phishing",
    "no verdict",
)


class RuleScorer:
    """A layer-2 scorer for queries and tests: the prompt followed by one of
    :data:`RULE_ANSWERS` picked by the first 16 bits of md5(url) mod 5.
    Deterministic, so a recomputed task gives the same answer."""

    def load(self):
        return self

    def generate(self, urls: pd.Series, instruction: str) -> tuple[list, list]:
        out, err = [], []
        for u in urls:
            if u is None:
                out.append(None)
                err.append("url is null")
                continue
            k = int(hashlib.md5(u.encode("utf-8")).hexdigest()[:4], 16) % len(RULE_ANSWERS)
            out.append(f"<|user|>\n{instruction}\nURL: {u}<|end|>\n{H.ASSISTANT_TAG}{RULE_ANSWERS[k]}")
            err.append(None)
        return out, err


def rule_responses(worklist: DataFrame, instruction: str = H.DEFAULT_INSTRUCTION, url: str = "url") -> DataFrame:
    """The rule scorer as native expressions (same text as :class:`RuleScorer`)."""
    k = F.pmod(F.conv(F.substring(F.md5(F.col(url)), 1, 4), 16, 10).cast("int"), F.lit(len(RULE_ANSWERS)))
    answers = F.array(*[F.lit(a) for a in RULE_ANSWERS])
    resp = F.concat(H.render_prompt(F.lit(instruction), F.col(url)), F.element_at(answers, k + 1))
    return worklist.select(url, resp.alias("response"),
                           F.when(F.col(url).isNull(), F.lit("url is null")).alias("error"))


def rule_layer2(worklist: DataFrame) -> DataFrame:
    """Layer 2 = the rule answers, parsed (H4-H6)."""
    return H.layer2_results(rule_responses(worklist))
