"""Evaluation of cascade results.

One aggregate over the result table yields every count (confusion cells of
both predictions, the layer-2 subset, corrections and mistakes); all metrics
are arithmetic on that single row.  Inputs: true_label, final_prediction,
layer1_prediction, used_layer2 (taken as given, never re-derived), url, row_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layer1 import binary_counts, metric_columns, ratio

EXAMPLES_PER_KIND = 3
EXAMPLE_URL_CHARS = 60
LABEL_TEXT = {0: "Legitimate", 1: "Phishing"}


def evaluation_counts(final: DataFrame, truth: str = "true_label") -> DataFrame:
    """The single aggregate all E-operators read.  Without a truth column
    there is nothing to evaluate: the aggregate is taken over no rows and
    every metric operator returns an empty result."""
    if truth not in final.columns:
        final = final.withColumn(truth, F.lit(None).cast("int")).where(F.lit(False))
    y, f, l1, u = F.col(truth), F.col("final_prediction"), F.col("layer1_prediction"), F.col("used_layer2")
    changed = u & (l1 != f)
    counts = final.agg(
        F.count(F.lit(1)).alias("total"),
        *binary_counts(y, f, "h_"), *binary_counts(y, l1, "l_"),
        *binary_counts(F.when(u, y), F.when(u, f), "s_"),
        F.count(F.when(u & (l1 == y), 1)).alias("s_l1_correct"),
        F.count(F.when(u, 1)).alias("routed"),
        F.count(F.when(changed & (f == y), 1)).alias("corrections"),
        F.count(F.when(changed & (f != y), 1)).alias("mistakes"),
        F.count(F.when(y == 0, 1)).alias("y0"), F.count(F.when(y == 1, 1)).alias("y1"),
        F.count(F.when(f == 0, 1)).alias("f0"), F.count(F.when(f == 1, 1)).alias("f1"),
        F.count(F.when(l1 == 0, 1)).alias("p0"), F.count(F.when(l1 == 1, 1)).alias("p1"))
    return counts.where(F.col("total") > 0)


def _metrics(prefix: str) -> dict[str, Column]:
    return metric_columns(*(F.col(prefix + c) for c in ("tp", "fp", "fn", "tn")))


def _named(m: dict[str, Column]) -> list[Column]:
    return [v.alias(k) for k, v in m.items()]


def metrics_overall(final: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1, AUC of final_prediction."""
    c = evaluation_counts(final)
    return c.select(*_named(_metrics("h_")), *[F.col("h_" + k).alias(k) for k in ("tp", "fp", "fn", "tn")])


def metrics_layer1(final: DataFrame) -> DataFrame:
    """The same for layer1_prediction."""
    c = evaluation_counts(final)
    return c.select(*_named(_metrics("l_")), *[F.col("l_" + k).alias(k) for k in ("tp", "fp", "fn", "tn")])


def metrics_layer2_subset(final: DataFrame) -> DataFrame:
    """Rows routed to layer 2: count, accuracy gain over layer 1, P/R/F1.
    No row when nothing was routed."""
    c = evaluation_counts(final)
    m = _metrics("s_")
    gain = ratio(F.col("s_tp") + F.col("s_tn") - F.col("s_l1_correct"), F.col("routed"))
    return c.where(F.col("routed") > 0).select(
        F.col("routed").alias("count"), gain.alias("accuracy_improvement"),
        m["precision"].alias("precision_layer2"),
        m["recall"].alias("recall_layer2"),
        m["f1_score"].alias("f1_layer2"))


def metrics_efficiency(final: DataFrame) -> DataFrame:
    """Total, resolved by layer 1, processed by layer 2, both as %."""
    c = evaluation_counts(final)
    return c.select(
        F.col("total").alias("total_samples"),
        (F.col("total") - F.col("routed")).alias("layer1_resolved"),
        F.col("routed").alias("layer2_processed"),
        F.try_divide((F.col("total") - F.col("routed")) * 100.0, F.col("total"))
        .alias("efficiency_percentage"),
        F.try_divide(F.col("routed") * 100.0, F.col("total")).alias("layer2_usage_percentage"))


METRIC_NAMES = ("accuracy", "precision", "recall", "f1_score")


def metrics_improvement(final: DataFrame) -> DataFrame:
    """E5: hybrid minus layer 1 for accuracy, precision, recall, F1."""
    c = evaluation_counts(final)
    h, l1 = _metrics("h_"), _metrics("l_")
    return c.select(*[(h[k] - l1[k]).alias(f"{k}_improvement") for k in METRIC_NAMES])


def model_comparison(final: DataFrame) -> DataFrame:
    """Metric x {layer1, hybrid, improvement} (the bar-chart data)."""
    c = evaluation_counts(final)
    h, l1 = _metrics("h_"), _metrics("l_")
    wide = c.select(*[F.struct(F.lit(k).alias("metric"), l1[k].alias("layer1"),
                               h[k].alias("hybrid"),
                               (h[k] - l1[k]).alias("improvement")).alias(k)
                      for k in METRIC_NAMES])
    return wide.select(F.explode(F.array(*[F.col(k) for k in METRIC_NAMES])).alias("r")).select("r.*")


def confusion_matrix(final: DataFrame) -> DataFrame:
    """Model, actual, predicted, n for both predictions, all four cells
    present (zero-filled) -- one aggregate, unpivoted, no join."""
    c = evaluation_counts(final)
    cells = []
    for model, p in (("layer1", "l_"), ("hybrid", "h_")):
        for actual, predicted, cell in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")):
            cells.append(F.struct(F.lit(model).alias("model"), F.lit(actual).alias("actual"),
                                  F.lit(predicted).alias("predicted"), F.col(p + cell).alias("n")))
    return c.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def error_reduction(final: DataFrame) -> DataFrame:
    """False positives / negatives of layer 1 vs hybrid, reduction and %
    of max(baseline, 1).  Only when both classes occur for both predictions."""
    c = evaluation_counts(final)
    both_l = ((F.col("y0") + F.col("p0")) > 0) & ((F.col("y1") + F.col("p1")) > 0)
    both_h = ((F.col("y0") + F.col("f0")) > 0) & ((F.col("y1") + F.col("f1")) > 0)
    fp_red = F.col("l_fp") - F.col("h_fp")
    fn_red = F.col("l_fn") - F.col("h_fn")
    return c.where(both_l & both_h).select(
        F.col("l_fp").alias("fp_layer1"), F.col("h_fp").alias("fp_hybrid"), fp_red.alias("fp_reduction"),
        (fp_red * 100.0 / F.greatest(F.col("l_fp"), F.lit(1))).alias("fp_reduction_pct"),
        F.col("l_fn").alias("fn_layer1"), F.col("h_fn").alias("fn_hybrid"), fn_red.alias("fn_reduction"),
        (fn_red * 100.0 / F.greatest(F.col("l_fn"), F.lit(1))).alias("fn_reduction_pct"))


def layer2_effect(final: DataFrame) -> DataFrame:
    """Routed rows, corrections, mistakes, net rate %.  No row when
    nothing was routed."""
    c = evaluation_counts(final)
    net = (F.col("corrections") - F.col("mistakes")) * 100.0 / F.col("routed")
    return c.where(F.col("routed") > 0).select(
        F.col("routed").alias("layer2_samples"), "corrections", "mistakes",
        net.alias("net_improvement_pct"))


def top_k_per_group(df: DataFrame, group: str, order: list[str], k: int, spread: int = 256) -> DataFrame:
    """Exact first ``k`` rows per group without a one-task window: keep the
    first k inside each of ``spread`` hash slices of a group, then rank the
    at most ``k * spread`` survivors of each group."""
    sl = F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(spread))
    w1 = Window.partitionBy(group, "_slice").orderBy(*order)
    pre = df.withColumn("_slice", sl).withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k)
    w2 = Window.partitionBy(group).orderBy(*order)
    return pre.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k).drop("_slice", "_r1")


def layer2_examples(final: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Up to three corrections and three mistakes (table order), url cut
    to 60 characters, layer decisions as text."""
    y, f, l1 = F.col("true_label"), F.col("final_prediction"), F.col("layer1_prediction")
    changed = final.where(F.col("used_layer2") & (l1 != f))
    kind = F.when(f == y, F.lit("correction")).otherwise(F.lit("mistake"))
    ex = changed.select(row_id, "url", "layer1_prediction", "final_prediction", kind.alias("kind"))
    top = top_k_per_group(ex, "kind", [row_id], EXAMPLES_PER_KIND)
    text = lambda c: F.when(F.col(c) == 1, LABEL_TEXT[1]).otherwise(LABEL_TEXT[0])
    return top.select("kind", F.col("rank").cast("int").alias("rank"), row_id,
                      F.concat(F.substring("url", 1, EXAMPLE_URL_CHARS), F.lit("...")).alias("url_head"),
                      text("layer1_prediction").alias("layer1"), text("final_prediction").alias("layer2"))


def evaluation_report(final: DataFrame) -> DataFrame:
    """The text report as ordered lines (line_no, line)."""
    c = evaluation_counts(final)
    h, l1, s = _metrics("h_"), _metrics("l_"), _metrics("s_")
    # rounded by arithmetic, so that every engine prints the same digits
    fixed = lambda x, k: F.floor(x * F.lit(10.0**k) + F.lit(0.5)) / F.lit(10.0**k)
    f4 = lambda x: F.format_string("%.4f", fixed(x, 4))
    sgn4 = lambda x: F.format_string("%+.4f", fixed(x, 4))
    f1d = lambda x: F.format_string("%.1f", fixed(x, 1))
    lines: list[Column] = [F.lit("CASCADE EVALUATION"), F.lit("-" * 40),
                           F.lit("FINAL DECISIONS")]
    names = (("Accuracy:  ", "accuracy"), ("Precision: ", "precision"), ("Recall:    ", "recall"),
             ("F1-Score:  ", "f1_score"), ("AUC-ROC:   ", "auc_roc"))
    lines += [F.concat(F.lit(n), f4(h[k])) for n, k in names]
    lines.append(F.lit("LAYER 1 ALONE"))
    lines += [F.concat(F.lit(n), f4(l1[k])) for n, k in names]
    routed = F.col("routed") > 0
    gain = ratio(F.col("s_tp") + F.col("s_tn") - F.col("s_l1_correct"), F.col("routed"))
    lines += [F.when(routed, F.lit("ROWS GIVEN TO LAYER 2")),
              F.when(routed, F.concat(F.lit("Rows: "), F.col("routed").cast("string"))),
              F.when(routed, F.concat(F.lit("Accuracy gained: "), sgn4(gain))),
              F.when(routed, F.concat(F.lit("Their precision: "), f4(s["precision"]))),
              F.when(routed, F.concat(F.lit("Their recall:    "), f4(s["recall"]))),
              F.when(routed, F.concat(F.lit("Their F1-score:  "), f4(s["f1_score"])))]
    eff = F.try_divide((F.col("total") - F.col("routed")) * 100.0, F.col("total"))
    use = F.try_divide(F.col("routed") * 100.0, F.col("total"))
    lines += [F.lit("WORK"),
              F.concat(F.lit("Rows in all: "), F.col("total").cast("string")),
              F.concat(F.lit("Decided by layer 1: "), (F.col("total") - F.col("routed")).cast("string")),
              F.concat(F.lit("Given to layer 2: "), F.col("routed").cast("string")),
              F.concat(F.lit("Share of layer 1: "), f1d(eff), F.lit("%")),
              F.concat(F.lit("Share of layer 2: "), f1d(use), F.lit("%")),
              F.lit("GAIN OVER LAYER 1"),
              F.concat(F.lit("Accuracy: "), sgn4(h["accuracy"] - l1["accuracy"])),
              F.concat(F.lit("F1-score: "), sgn4(h["f1_score"] - l1["f1_score"]))]
    arr = F.array(*[F.struct(F.lit(i + 1).alias("line_no"), x.alias("line")) for i, x in enumerate(lines)])
    return c.select(F.explode(arr).alias("r")).select("r.*").where(F.col("line").isNotNull())
