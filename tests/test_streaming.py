"""The stream result equals the batch result."""

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    q = E.queries()
    s = q["stream_cascade"](spark, SF)
    b = q["fixture_cascade"](spark, SF)
    assert s.count() == b.count()
    assert s.exceptAll(b.select(*s.columns)).count() == 0


def test_stream_stats_equal_batch_stats(spark):
    q = E.queries()
    s = q["stream_cascade_stats"](spark, SF).first().asDict()
    b = q["cascade_stats"](spark, SF).first().asDict()
    assert s == b
    assert b["total_processed"] == b["layer1_legitimate"] + b["layer1_suspicious"] + \
        (b["total_processed"] - b["layer1_legitimate"] - b["layer1_suspicious"])


def test_running_counters_over_many_micro_batches(spark):
    import os
    import tempfile

    from pyspark.sql import functions as F

    from urlsieve.operators import cascade as H
    from urlsieve.plans import fixtures as fx
    from urlsieve.plans import flows
    from urlsieve.session import fresh_path
    from urlsieve.streaming import cascade_stream as X

    src = tempfile.mkdtemp(dir="/tmp")
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    # four arrival files
    for i in range(4):
        orders.where(F.col("o_orderkey") % 4 == i).coalesce(1).write.parquet(os.path.join(src, f"part{i}"))
    stream = X.scored_stream(spark, os.path.join(src, "part*", "*.parquet"), max_files_per_trigger=1)
    out = fresh_path(spark, "s_out")
    X.stream_cascade(stream, fx.rule_layer2, out, fresh_path(spark, "s_ck"))
    batches = spark.read.parquet(out).select("batch").distinct().count()
    assert batches == 4
    stats = fresh_path(spark, "s_stats")
    X.stream_stats(X.final_stream(spark, out), stats, fresh_path(spark, "s_stats_ck"))
    got = X.with_efficiency(spark.read.parquet(stats)).first().asDict()
    want = H.cascade_stats(flows.fixture_cascade(fx.scored(spark, SF), fx.rule_layer2)).first().asDict()
    assert got == want


def test_a_url_is_answered_once_per_stream(spark, tmp_path):
    """Over several micro-batches, after a restart, and when a batch is run again."""
    from pyspark.sql import functions as F

    from urlsieve.plans import fixtures as fx
    from urlsieve.plans import flows
    from urlsieve.streaming import cascade_stream as X

    asked = []

    def counted(worklist):
        asked.append(sorted(r.url for r in worklist.collect()))
        return fx.rule_layer2(worklist)

    orders = spark.read.parquet(f"{SF}/orders.parquet")
    schema = orders.schema
    src, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")

    def run(arrivals):
        for i in arrivals:      # urls repeat between files
            orders.where(F.col("o_orderkey") % 4 == i).coalesce(1).write.parquet(f"{src}/part{i}")
        stream = X.scored_stream(spark, f"{src}/part*/*.parquet", max_files_per_trigger=1, schema=schema)
        X.stream_cascade(stream, counted, out, ckpt)

    run([0, 1])
    run([2, 3])
    urls = [u for call in asked for u in call]
    assert len(asked) == 4 and len(urls) == len(set(urls)) > 100
    whole = flows.fixture_cascade(fx.scored(spark, SF), fx.rule_layer2)
    got = spark.read.schema(X.FINAL_SCHEMA).parquet(out).drop("batch")
    assert got.count() == whole.count() and got.exceptAll(whole.select(*got.columns)).count() == 0
    assert set(urls) == {r.url for r in whole.where("used_layer2").select("url").distinct().collect()}
    from urlsieve.operators import cascade as H
    batch = spark.read.parquet(f"{src}/part3").limit(0)
    routed = H.route(fx.scored(spark, SF).withColumn("layer1_prediction", F.lit(0)))
    again = X.batch_answers(routed, counted, out + "-answers", 3)
    assert batch.count() == 0 and len(asked) == 4 and again.count() == len(set(urls))
