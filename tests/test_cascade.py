"""H1–H11 and U1 on small inputs."""

import math

import pandas as pd
from pyspark.sql import functions as F

from urlsieve.operators import cascade as H
from urlsieve.plans import fixtures as fx
from urlsieve.plans import flows

PARSE_GOLDEN = [
    ("Phishing: x", 1), ("Legitimate: no phishing", 0), ("phishing: legitimate:", 1),
    ("legitimate: phishing: phishing:", 0), ("", 0), ("benign", 0), ("Legitimate: a", 0),
    ("a legitimate: phishing: phishing: x", 0), ("this is not phishing but legitimate", 1),
    ("legitimate", 0), ("phishing:legitimate: phishing", 1),
]


def test_parse_answer_golden(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(PARSE_GOLDEN)], "i int, a string")
    got = {r.i: r.p for r in df.select("i", H.parse_answer("a").alias("p")).collect()}
    assert [got[i] for i in range(len(PARSE_GOLDEN))] == [w for _, w in PARSE_GOLDEN]


def test_extract_answer(spark):
    texts = ["<|user|>\nq<|end|>\n<|assistant|>\n  Phishing: yes \n", "no tag here ", "a<|assistant|>\nb<|assistant|>\nc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.a for r in df.select("i", H.extract_answer("t").alias("a")).collect()}
    assert got == {0: "Phishing: yes", 1: "no tag here", 2: "c"}


def test_route_band_strict_and_nan(spark):
    vals = [0.3, 0.30001, 0.5, 0.69999, 0.7, float("nan"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, c double")
    got = {r.i: r.b for r in df.select("i", H.route_band("c").alias("b")).collect()}
    assert got == {0: False, 1: True, 2: True, 3: True, 4: False, 5: False, 6: None}


def _scored(spark, rows):
    return spark.createDataFrame(rows, "row_id long, url string, layer1_confidence double, true_label int") \
        .withColumn("layer1_prediction", (F.col("layer1_confidence") > 0.5).cast("int"))


def test_combine_duplicates_and_policies(spark):
    rows = [(1, "http://x.com", 0.1, 0), (2, "http://y.com", 0.5, 1), (3, "http://y.com", 0.6, 1),
            (4, "http://z.com", 0.9, 1), (5, None, 0.4, 0)]
    s = _scored(spark, rows)
    calls = []

    def l2(wl):
        calls.append(wl)
        return wl.select("url", F.lit(1).alias("layer2_prediction"), F.lit("because").alias("layer2_explanation"))

    out = {r.row_id: r for r in H.cascade(s, l2).collect()}
    assert len(out) == 5                                   # no row multiplied by the duplicate url
    assert calls[0].count() == 2                           # y.com once, plus the null url
    assert out[2].decision_maker == "Phi3" and out[2].final_prediction == 1
    assert out[5].decision_maker == "Phi3"                 # null url still joined (null-safe)
    assert out[1].layer2_explanation == "Not analyzed by Layer 2" and out[1].decision_maker == "BiGRU"
    ref = {r.row_id: r for r in H.cascade(s, None).collect()}
    assert ref[3].final_prediction == 0 and ref[3].layer2_explanation == "Model not available"
    keep = {r.row_id: r for r in H.cascade(s, None, on_missing="layer1").collect()}
    assert keep[3].final_prediction == 1 and keep[3].decision_maker == "BiGRU"


def test_stats_and_listing(spark):
    rows = [(1, "http://x.com", 0.1, 0), (2, "http://y.com", 0.5, 1), (3, "http://z.com", 0.9, 1)]
    final = flows.fixture_cascade(_scored(spark, rows), fx.rule_layer2)
    st = H.cascade_stats(final).first()
    assert st.total_processed == st.layer1_legitimate + st.layer1_suspicious + 1
    assert math.isclose(st.efficiency_pct, 200 / 3)
    lst = {r.row_id: r for r in H.result_listing(final).collect()}
    assert lst[1].explanation is None and lst[2].explanation is not None


class Boom:
    name = "boom"

    def load(self):
        raise RuntimeError("no weights")


class Flaky:
    name = "flaky"

    def load(self):
        return self

    def generate(self, urls: pd.Series, instruction):
        if len(urls) > 1:
            raise RuntimeError("batch failed")
        u = urls.iloc[0]
        if "bad" in u:
            raise ValueError("cannot score")
        return ["<|assistant|>\nPhishing: " + u], [None]


def test_plugin_scorer_errors(spark):
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import test modules
    wl = spark.createDataFrame([("http://ok.com",), ("http://bad.com",)], "url string").repartition(1)
    out = {r.url: r for r in H.layer2_results(H.plugin_responses(wl, Flaky())).collect()}
    assert out["http://ok.com"].layer2_prediction == 1 and out["http://ok.com"].layer2_confidence == 1.0
    assert out["http://bad.com"].layer2_explanation == "Error: cannot score"
    assert out["http://bad.com"].layer2_prediction == 0 and out["http://bad.com"].layer2_confidence == 0.0
    dead = H.layer2_results(H.plugin_responses(wl, Boom())).collect()
    assert all(r.layer2_explanation == "Error: no weights" for r in dead)


def test_rule_scorer_native_equals_python(spark):
    wl = spark.createDataFrame([(f"http://c{i}.example.com/o/{i % 97}",) for i in range(300)], "url string")
    a = fx.rule_responses(wl).select("url", "response")
    b = H.plugin_responses(wl, fx.RuleScorer()).select("url", "response")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _py_parse(answer: str) -> int:
    """The H5 rule written from its contract, for the property test."""
    low = answer.lower()
    head = low[:20]
    if "phishing" in low and "legitimate:" not in head:
        return 1
    if "legitimate" in low and "phishing:" not in head:
        return 0
    return 1 if low.count("phishing") > low.count("legitimate") else 0


def test_parse_answer_matches_rule_on_random_answers(spark):
    import random
    rnd = random.Random(3)
    parts = ["phishing", "Phishing:", "legitimate", "Legitimate:", "LEGITIMATE", ": ", " ", "not ", "x", "site",
             "phishingphishing", "legit", "\n"]
    answers = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 8))) for _ in range(400)]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string")
    got = {r.i: r.p for r in df.select("i", H.parse_answer("a").alias("p")).collect()}
    bad = [(a, got[i], _py_parse(a)) for i, a in enumerate(answers) if got[i] != _py_parse(a)]
    assert not bad, bad[:5]


def test_scorers_of_one_class_keep_their_settings(spark):
    class Fixed:
        def __init__(self, answer):
            self.answer = answer

        def load(self):
            return self

        def generate(self, urls, instruction):
            return [self.answer] * len(urls), [None] * len(urls)

    urls = spark.createDataFrame([("a",)], "url string").coalesce(1)
    assert [H.plugin_responses(urls, Fixed(x)).first().response for x in ("one", "two")] == ["one", "two"]
