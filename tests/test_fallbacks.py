"""With no table allowed to broadcast, every join takes its shuffle path; results
must not change."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
KEYS = ["cascade_predict", "score_layer1", "encode_sequence", "decode_sequence", "pack_supervised",
        "fixture_cascade", "log_rate", "best_checkpoint", "early_stop", "text_validation_metrics",
        "stratified_split", "balanced_sample"]


@pytest.mark.parametrize("key", KEYS)
def test_shuffle_paths_give_the_same_rows(spark, key):
    q = E.queries()[key]
    fast = sorted(map(repr, q(spark, SF).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        slow = sorted(map(repr, q(spark, SF).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert fast == slow
