"""The cascade over arriving files (X1, X2) with Structured Streaming.

* X2 ``stream_cascade``: each micro-batch of scored urls goes through the
  cascade in ``foreachBatch`` and lands in a parquet folder, one
  ``batch=<id>`` sub-folder per micro-batch written with overwrite, so a
  retried batch replaces its own output (idempotent sink).  Layer 2 runs only
  on the band, and on a url once per stream (H3): its answers are a table with
  a version per micro-batch, and only urls without an earlier answer are asked.
* X2 ``stream_url_cascade``: raw urls, scored inside the stream with saved
  weights (in the row, no state), then routed and joined to saved answers.
* X1 ``stream_stats``: a second stream over that folder keeps the running
  cascade counters (the totals the batch code accumulates over calls) as a
  one-group ``complete``-mode aggregate; its state is one row whatever the
  input size.

Checkpoints and outputs live under the shared folder (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import tokenizer
from ..operators import cascade as H
from ..operators import layer1 as M
from ..session import cut_lineage

FINAL_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("layer1_confidence", T.DoubleType()), T.StructField("layer1_prediction", T.IntegerType()),
    T.StructField("used_layer2", T.BooleanType()), T.StructField("final_prediction", T.IntegerType()),
    T.StructField("layer2_explanation", T.StringType()), T.StructField("decision_maker", T.StringType()),
    T.StructField("true_label", T.IntegerType()), T.StructField("batch", T.LongType())])


def scored_stream(spark: SparkSession, orders_glob: str, max_files_per_trigger: int | None = None,
                  schema: T.StructType | None = None) -> DataFrame:
    """Streaming scored urls derived from an orders file source (same columns
    as the batch ``scored`` view plus layer1_prediction).  A file source
    needs a schema up front; without one it is read from the files once."""
    schema = schema or spark.read.parquet(orders_glob).schema
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    o = r.parquet(orders_glob)
    url = F.concat(F.lit("http://c"), (F.col("o_custkey") % 500).cast("string"),
                   F.lit(".example.com/o/"), (F.col("o_orderkey") % 97).cast("string"))
    conf = F.col("o_totalprice") / F.lit(500000.0)
    return o.select(F.col("o_orderkey").alias("row_id"), url.alias("url"),
                    (F.col("o_orderstatus") == "F").cast("int").alias("true_label"),
                    conf.alias("layer1_confidence"),
                    (conf > 0.5).cast("int").alias("layer1_prediction"))


ANSWER_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("layer2_prediction", T.IntegerType()),
    T.StructField("layer2_explanation", T.StringType()), T.StructField("layer2_confidence", T.DoubleType()),
    T.StructField("batch", T.LongType())])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def batch_answers(routed: DataFrame, layer2_fn, path: str, batch_id: int, url: str = "url") -> DataFrame:
    """Answers for the routed urls of a micro-batch.  ``path`` holds those of the stream, a folder
    ``batch=<id>`` each; urls that an earlier batch has answered are not asked again.  A batch that
    is run again finds its own complete answers and asks nothing."""
    spark = routed.sparkSession
    worklist = H.layer2_worklist(routed, url)
    own = os.path.join(path, f"batch={batch_id}")
    if not _exists(spark, os.path.join(own, "_SUCCESS")):
        asked = worklist
        if _exists(spark, path):
            earlier = spark.read.schema(ANSWER_SCHEMA).parquet(path).where(F.col("batch") < batch_id).select(F.col("url").alias("_u"))
            asked = worklist.join(earlier, F.col(url).eqNullSafe(F.col("_u")), "left_anti")
        layer2_fn(asked).select(F.col(url).alias("url"), "layer2_prediction", "layer2_explanation", "layer2_confidence") \
            .write.mode("overwrite").parquet(own)
    answers = spark.read.schema(ANSWER_SCHEMA).parquet(path).where(F.col("batch") <= batch_id).drop("batch")
    needed = worklist.select(F.col(url).alias("_u"))
    return answers.join(needed, F.col("url").eqNullSafe(F.col("_u")), "left_semi").withColumnRenamed("url", url)


def stream_cascade(stream: DataFrame, layer2_fn, out_path: str, checkpoint: str,
                   threshold: float = H.DEFAULT_BAND, answers_path: str | None = None) -> None:
    """Cascade per micro-batch; runs until the available input is done.  ``answers_path``
    (next to the output by default) keeps layer 2's answers over batches and restarts."""
    answers_path = answers_path or out_path.rstrip("/") + "-answers"

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        routed = cut_lineage(H.route(batch, threshold), "routed")
        l2 = cut_lineage(batch_answers(routed, layer2_fn, answers_path, batch_id), "answers") if layer2_fn is not None else None
        final = H.combine(routed, l2)
        (final.select("row_id", *H.FINAL_COLUMNS, "true_label")
         .write.mode("overwrite").parquet(os.path.join(out_path, f"batch={batch_id}")))

    q = (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def final_stream(spark: SparkSession, path: str) -> DataFrame:
    """The X2 output folder as a stream of final rows."""
    return spark.readStream.schema(FINAL_SCHEMA).parquet(path)


def running_counters(final: DataFrame) -> DataFrame:
    """The H9 counters as one aggregate (batch or streaming input)."""
    u = F.col("used_layer2")
    return final.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count(F.when(~u & (F.col("layer1_prediction") == 0), 1)).alias("layer1_legitimate"),
        F.count(F.when(u, 1)).alias("layer1_suspicious"),
        F.count(F.when(u, 1)).alias("layer2_processed"),
        F.count(F.when(F.col("final_prediction") == 1, 1)).alias("final_phishing"),
        F.count(F.when(F.col("final_prediction") != 1, 1)).alias("final_legitimate"))


def stream_stats(final: DataFrame, out_path: str, checkpoint: str) -> None:
    """Cumulative counters in complete mode; each trigger rewrites the
    one-row result."""

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out_path)

    q = (running_counters(final).writeStream.outputMode("complete").foreachBatch(per_batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def with_efficiency(counters: DataFrame) -> DataFrame:
    eff = F.try_divide((F.col("total_processed") - F.col("layer2_processed")).cast("double") * 100,
                       F.col("total_processed").cast("double"))
    return counters.withColumn("efficiency_pct", eff)


def stream_cascade_static(stream: DataFrame, layer2: DataFrame, out_path: str, checkpoint: str,
                          threshold: float = H.DEFAULT_BAND) -> None:
    """X2 as a stream-static join: routed stream rows left-joined (null-safe on
    url) to a saved table of layer-2 answers, appended to a parquet sink.
    No per-batch code; suits answers computed ahead (e.g. by a nightly U1
    job).  The file sink with its checkpoint is exactly-once."""
    final = H.combine(H.route(stream, threshold), layer2)
    q = (final.select("row_id", *H.FINAL_COLUMNS, "true_label").writeStream.format("parquet")
         .option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def stream_url_cascade(stream: DataFrame, model: M.TokenModel, layer2: DataFrame, out_path: str, checkpoint: str,
                       threshold: float = H.DEFAULT_BAND, keep: tuple[str, ...] = ("row_id",)) -> None:
    """X2 from raw urls: T1, M2 with saved weights, H1 and H8 in one stateless plan, appended to
    a parquet sink.  The weights are looked up inside the row, so the stream is neither grouped
    nor shuffled for scoring and needs no watermark; a url may arrive any number of times."""
    tokens = stream.withColumn("tokens", tokenizer(model.tok)(F.col("url")))
    bias = model.bias.first()[0]        # one number, saved with the model
    scored = M.score_layer1(tokens, M.TokenModel(model.weights, bias))
    final = H.combine(H.route(scored, threshold), layer2)
    q = (final.select(*keep, *H.FINAL_COLUMNS).writeStream.format("parquet")
         .option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
