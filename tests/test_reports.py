"""Content checks of the JSON report, the text report and the logistic regression."""

import json
import math

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _own():
    """Queries other than the corpus operators', which have tests of their own."""
    return {k: q for k, q in E.queries().items() if k not in E.LLM_QUERIES}


def test_metrics_json_leaves_absent_groups_out(spark, tmp_path):
    from urlsieve.operators import evaluation as Ev
    from urlsieve.sources import files as S

    ddl = "row_id long, url string, layer1_prediction int, used_layer2 boolean, final_prediction int, true_label int"
    for routed in (False, True):
        final = spark.createDataFrame([(1, "u", 1, routed, 1, 1), (2, "v", 0, False, 0, 1)], ddl)
        groups = {"overall": Ev.metrics_overall(final), "layer2_samples": Ev.metrics_layer2_subset(final)}
        path = S.write_metrics_json(groups, str(tmp_path / str(routed)))
        report = json.loads(spark.read.text(path, wholetext=True).first()[0])
        assert report["overall"] == Ev.metrics_overall(final).first().asDict()
        assert ("layer2_samples" in report) == routed
        assert {(r.grp, r.metric): r.value for r in S.read_metrics_json(spark, path).collect()} == {
            (g, m): v for g, ms in report.items() for m, v in ms.items()}


def test_evaluation_report_lines_equal_python_formatting(spark):
    q = _own()
    lines = [r.line for r in q["evaluation_report"](spark, SF).orderBy("line_no").collect()]
    o = q["metrics_overall"](spark, SF).first()
    l1 = q["metrics_layer1"](spark, SF).first()
    eff = q["metrics_efficiency"](spark, SF).first()
    assert f"Accuracy:  {o.accuracy:.4f}" == lines[lines.index("FINAL DECISIONS") + 1]
    assert f"AUC-ROC:   {l1.auc_roc:.4f}" in lines
    assert f"Share of layer 1: {eff.efficiency_percentage:.1f}%" in lines
    assert f"F1-score: {o.f1_score - l1.f1_score:+.4f}" in lines
    assert f"Rows in all: {eff.total_samples}" in lines


def test_logreg_scores_are_probabilities(spark):
    rows = _own()["train_logreg"](spark, SF).collect()
    assert rows and all(0.0 <= r.layer1_confidence <= 1.0 and not math.isnan(r.layer1_confidence) for r in rows)
    assert all(r.layer1_prediction == int(r.layer1_confidence > 0.5) for r in rows)


def test_newton_ends_at_the_optimum(spark):
    from urlsieve.operators import layer1 as M

    rows = [(float(i % 13 - 6), int((i * 7919) % 101 < 50 + 4 * (i % 13 - 6))) for i in range(2000)]
    model = M.train_logistic(spark.createDataFrame(rows, "log_odds double, label int"))

    def loss(a, b):
        return sum(math.log1p(math.exp(-(a * z + b) * (1 if y else -1))) for z, y in rows) + (a * a + b * b) * M.RIDGE / 2

    best = loss(model.slope, model.intercept)
    assert model.gradient < 1e-9 * 2000 and model.slope > 0.1
    assert all(loss(model.slope + da, model.intercept + db) > best for da, db in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)))
    apart = M.train_logistic(spark.createDataFrame([(-50.0, 0), (50.0, 1)] * 50, "log_odds double, label int"))
    assert apart.gradient < 1e-7 and 0 < apart.slope < 10       # separable rows: the ridge keeps it finite


def test_hashed_logreg_scores_are_probabilities(spark):
    from urlsieve.operators import layer1 as M

    df = spark.createDataFrame([(i, ["a", "x"] if i % 2 else ["b"], i % 2) for i in range(40)], "row_id int, tokens array<string>, label int")
    rows = M.score_logreg(df, M.train_logreg(df)).collect()
    assert all(r.layer1_prediction == r.label and 0 < r.layer1_confidence < 1 for r in rows)


def test_every_query_has_an_oracle():
    assert set(_own()) <= set(E.oracle_sql())
    assert len(_own()) >= 76
