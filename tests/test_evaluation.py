"""E1–E11 on the 5-row scored sample (goldens worked out by hand)."""

import math

import pytest

from urlsieve.operators import evaluation as E

ROWS = [  # url, layer1_confidence, layer1_prediction, used_layer2, final_prediction, decision_maker, true_label
    (1, "https://orchard.example.org", 0.12, 0, False, 0, "BiGRU", 0),
    (2, "http://parcel-desk.example.net", 0.81, 1, True, 0, "Phi3", 1),
    (3, "https://harbour.example.org", 0.23, 0, False, 0, "BiGRU", 0),
    (4, "http://prize-wallet.example.net", 0.93, 1, False, 1, "BiGRU", 1),
    (5, "https://meadow.example.org", 0.17, 0, False, 0, "BiGRU", 0),
]
DDL = ("row_id long, url string, layer1_confidence double, layer1_prediction int, used_layer2 boolean, "
       "final_prediction int, decision_maker string, true_label int")


@pytest.fixture(scope="module")
def final(spark):
    return spark.createDataFrame(ROWS, DDL)


def test_overall_and_layer1(final):
    o = E.metrics_overall(final).first()
    assert (o.tp, o.fp, o.fn, o.tn) == (1, 0, 1, 3)
    assert o.accuracy == 0.8 and o.precision == 1.0 and o.recall == 0.5
    assert math.isclose(o.f1_score, 2 / 3) and o.auc_roc == 0.75
    l1 = E.metrics_layer1(final).first()
    assert (l1.tp, l1.fp, l1.fn, l1.tn) == (2, 0, 0, 3)
    assert l1.accuracy == l1.precision == l1.recall == l1.f1_score == l1.auc_roc == 1.0


def test_layer2_subset_and_efficiency(final):
    s = E.metrics_layer2_subset(final).first()
    assert (s["count"], s.accuracy_improvement, s.precision_layer2, s.recall_layer2, s.f1_layer2) == (1, -1.0, 0, 0, 0)
    e = E.metrics_efficiency(final).first()
    assert (e.total_samples, e.layer1_resolved, e.layer2_processed) == (5, 4, 1)
    assert e.efficiency_percentage == 80.0 and e.layer2_usage_percentage == 20.0


def test_effect_and_reduction(final):
    x = E.layer2_effect(final).first()
    assert (x.layer2_samples, x.corrections, x.mistakes, x.net_improvement_pct) == (1, 0, 1, -100.0)
    r = E.error_reduction(final).first()
    assert (r.fp_layer1, r.fp_hybrid, r.fp_reduction, r.fp_reduction_pct) == (0, 0, 0, 0.0)
    assert (r.fn_layer1, r.fn_hybrid, r.fn_reduction, r.fn_reduction_pct) == (0, 1, -1, -100.0)


def test_confusion_and_comparison(final):
    cm = {(r.model, r.actual, r.predicted): r.n for r in E.confusion_matrix(final).collect()}
    assert len(cm) == 8 and sum(v for (m, _, _), v in cm.items() if m == "hybrid") == 5
    assert cm[("hybrid", 1, 0)] == 1 and cm[("layer1", 0, 1)] == 0
    mc = {r.metric: r for r in E.model_comparison(final).collect()}
    assert math.isclose(mc["accuracy"].improvement, -0.2)
    imp = E.metrics_improvement(final).first()
    assert math.isclose(imp.f1_score_improvement, 2 / 3 - 1)


def test_examples_and_report(final):
    ex = E.layer2_examples(final).collect()
    assert [(r.kind, r.rank, r.layer1, r.layer2) for r in ex] == [("mistake", 1, "Phishing", "Legitimate")]
    assert ex[0].url_head == "http://parcel-desk.example.net..."
    lines = [r.line for r in E.evaluation_report(final).orderBy("line_no").collect()]
    assert "Accuracy:  0.8000" in lines and "Given to layer 2: 1" in lines
    assert "Share of layer 1: 80.0%" in lines and "Accuracy gained: -1.0000" in lines


def test_nothing_routed_gives_no_subset_rows(spark):
    df = spark.createDataFrame([r[:4] + (False,) + r[5:] for r in ROWS], DDL)
    assert E.metrics_layer2_subset(df).count() == 0 and E.layer2_effect(df).count() == 0


def test_examples_top_k_is_exact(spark):
    from pyspark.sql import functions as F
    df = spark.range(0, 2000).select(F.col("id").alias("row_id"), F.lit("http://u").alias("url"),
                                     F.lit(0).alias("layer1_prediction"), F.lit(True).alias("used_layer2"),
                                     F.lit(1).alias("final_prediction"), (F.col("id") % 2).cast("int").alias("true_label"))
    got = {(r.kind, r.rank): r.row_id for r in E.layer2_examples(df).collect()}
    assert got == {("correction", 1): 1, ("correction", 2): 3, ("correction", 3): 5,
                   ("mistake", 1): 0, ("mistake", 2): 2, ("mistake", 3): 4}
