"""Invariants: results do not depend on the number of shuffle partitions;
counters add up."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
KEYS = ["cascade_predict", "stratified_split", "balanced_sample", "build_vocab", "early_stop", "layer2_examples",
        "render_conversation", "pack_supervised"]


@pytest.mark.parametrize("key", KEYS)
def test_same_result_for_1_and_8_shuffle_partitions(spark, key):
    q = E.queries()[key]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        one = q(spark, SF).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    eight = q(spark, SF).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, eight))


def test_counters_add_up(spark):
    q = E.queries()
    st = q["cascade_stats"](spark, SF).first()
    tr = q["triage_counts"](spark, SF).first()
    assert st.total_processed == tr.definite_legitimate + tr.definite_phishing + tr.suspicious
    assert st.layer2_processed == tr.suspicious
    assert st.final_phishing + st.final_legitimate == st.total_processed
    cm = q["confusion_matrix"](spark, SF).collect()
    for m in ("layer1", "hybrid"):
        assert sum(r.n for r in cm if r.model == m) == st.total_processed


def test_plugin_scorer_more_partitions(spark):
    from pyspark.sql import functions as F

    from urlsieve.operators import cascade as H
    from urlsieve.plans import fixtures as fx
    wl = E.queries()["layer2_worklist"](spark, SF)
    a = H.plugin_responses(wl, fx.RuleScorer(), num_partitions=16)
    assert a.rdd.getNumPartitions() == 16
    b = fx.rule_responses(wl).select("url", "response", F.col("error"))
    assert a.exceptAll(b).count() == 0
