"""A url holding over a third of all rows: results stay whole and equal to
the per-row definition."""

from pyspark.sql import functions as F

from urlsieve.operators import cascade as H
from urlsieve.operators import layer1 as M
from urlsieve.plans import fixtures as fx
from urlsieve.plans import flows

SF = "/root/testdata/sf0.001"
HOT = "http://hot.example.com/login"


def test_cascade_with_hot_url(spark):
    base = fx.scored(spark, SF)                                   # 1,500 rows
    n = base.count()
    hot = spark.range(10_000_000, 10_000_000 + n).select(
        F.col("id").alias("row_id"), F.lit(HOT).alias("url"), (F.col("id") % 2).cast("int").alias("true_label"),
        F.lit(0.5).alias("layer1_confidence"))
    df = base.unionByName(hot)
    final = flows.fixture_cascade(df, fx.rule_layer2)
    assert final.count() == 2 * n                                  # no row lost or multiplied
    hot_rows = final.where(F.col("url") == HOT)
    assert hot_rows.select("final_prediction", "decision_maker").distinct().count() == 1
    wl = H.layer2_worklist(H.route(df.withColumn("layer1_prediction", F.lit(0))))
    assert wl.where(F.col("url") == HOT).count() == 1              # scored once


def test_token_model_with_hot_token(spark):
    u = fx.urls(spark, SF)
    n = u.count()
    hot = spark.range(10_000_000, 10_000_000 + n).select(F.col("id").alias("row_id"), F.lit(HOT).alias("url"),
                                                         F.lit(1).alias("label"))
    df = flows.tokenized(u.unionByName(hot))
    model = M.train_token_weights(df, min_freq=1)
    w = {r.token: (r.c1, r.c0) for r in model.weights.collect()}
    assert w["hot"] == (n, 0) and w["login"][0] >= n
    scored = M.score_layer1(df, model)
    assert scored.count() == 2 * n
    assert scored.where(F.col("url") == HOT).select("layer1_confidence").distinct().count() == 1


def test_hot_urls_meet_their_answers_in_a_bounded_broadcast(spark, monkeypatch):
    """A hot url and answers of 10 KB: results do not depend on what is broadcast."""
    rows = fx.scored(spark, SF).withColumn("layer1_prediction", F.lit(0)).withColumn("layer1_error", F.lit(False))
    hot = spark.range(3000).select((F.col("id") + 10_000_000).alias("row_id"), F.lit(HOT).alias("url"), F.lit(1).alias("true_label"),
                                   F.lit(0.5).alias("layer1_confidence"), F.lit(0).alias("layer1_prediction"), F.lit(False).alias("layer1_error"))
    routed = H.route(rows.unionByName(hot))
    answers = fx.rule_layer2(H.layer2_worklist(routed)).withColumn("layer2_explanation", F.concat("layer2_explanation", F.repeat(F.lit("x"), 10_000)))
    want = sorted(map(repr, H.combine(routed, answers).collect()))
    assert len(want) == 4500
    monkeypatch.setattr(H, "HOT_URL_ROWS", 5)
    for size in (1 << 25, 25_000, 0):       # all hot answers, two, none
        monkeypatch.setattr(H, "HOT_BYTES", size)
        l2 = answers.select(F.col("url").alias("_l2url"), "layer2_prediction", "layer2_explanation")
        found = H.hot_answers(routed.where("used_layer2"), l2, "url")
        assert found.agg(F.coalesce(F.sum(F.octet_length("layer2_explanation")), F.lit(0))).first()[0] <= size
        if size:
            assert found.where(F.col("_l2url") == HOT).count() == 1
        assert sorted(map(repr, H.combine(routed, answers).collect())) == want
