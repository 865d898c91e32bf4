"""V1–V4: early stopping golden and agreement with plain windows."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from urlsieve.operators import runs as V

LOSSES = [0.5, 0.4, 0.45, 0.41, 0.42, 0.1]


@pytest.fixture(scope="module")
def history(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(7, e + 1, t0 + dt.timedelta(seconds=30 * e * (e + 1)), v, v + 0.1, 1 - v) for e, v in enumerate(LOSSES)]
    rows += [(8, 1, t0, 0.3, 0.3, 0.5), (8, 2, t0 + dt.timedelta(seconds=60), 0.2, 0.2, 0.6)]
    return spark.createDataFrame(rows, "run_id long, epoch int, ts timestamp, val_loss double, train_loss double, "
                                       "accuracy double")


def test_early_stop_golden(history):
    r = {x.run_id: x for x in V.early_stop(history).collect()}
    assert (r[7].stop_epoch, r[7].best_epoch, r[7].epochs_trained) == (5, 2, 5)
    assert (r[8].stop_epoch, r[8].best_epoch, r[8].epochs_trained) == (None, 2, 2)
    imp = {x.epoch: x.improved for x in V.improvements(history).where("run_id = 7").collect()}
    assert [e for e, v in sorted(imp.items()) if v] == [1, 2, 6]


def test_best_checkpoint(history):
    r = {x.run_id: x for x in V.best_checkpoint(history).collect()}
    assert (r[7].best_epoch, r[7].best_val_loss, r[7].epochs) == (6, 0.1, 6)


def test_early_stop_window(history):
    r = {x.run_id: x.trigger_epoch for x in V.early_stop_window(history).collect()}
    assert r == {7: 4, 8: None}   # 0.41 > min(0.4, 0.45, 0.41)


def test_log_rate(history):
    r = {x.epoch: x for x in V.log_rate(history).where("run_id = 7").collect()}
    assert r[1].steps_per_minute is None
    # epoch 2 logged 60 s after epoch 1: 60/60 x 50 steps per minute, 4 logs x 50 steps left
    assert r[2].steps_per_minute == 50.0 and r[2].eta_minutes == 4.0 and r[2].global_step == 100


def test_history_long(history):
    assert V.training_history(history).count() == 3 * 8


def test_estimate(spark):
    r = V.training_estimate(spark.range(100)).first()
    assert (r.rows, r.total_steps) == (100, 3) and abs(r.estimated_seconds - 2.4) < 1e-12


def test_early_stop_matches_window_on_hot_run(spark):
    # one run holds most epochs
    df = spark.range(0, 3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 10 + 1).alias("run_id"),
                                     "id", (((F.col("id") * 7919) % 997) / 997.0).alias("val_loss"))
    df = df.withColumn("epoch", F.row_number().over(Window.partitionBy("run_id").orderBy("id")))
    got = {r.run_id: (r.stop_epoch, r.best_epoch) for r in V.early_stop(df, hot_rows=500).collect()}
    plain = {r.run_id: (r.stop_epoch, r.best_epoch) for r in V.early_stop(df).collect()}
    assert got == plain                     # run 0 cut into cells vs one group
    # python model of the loop
    by = {}
    for r in df.orderBy("run_id", "epoch").collect():
        by.setdefault(r.run_id, []).append(r.val_loss)
    for run, losses in by.items():
        best, bad, best_e, stop = float("inf"), 0, None, None
        for e, v in enumerate(losses, 1):
            if v < best:
                best, bad, best_e = v, 0, e
            else:
                bad += 1
            if bad >= 3:
                stop = e
                break
        assert got[run] == (stop, best_e), run


def test_null_run_is_a_run(spark, history):
    nulled = history.withColumn("run_id", F.when(F.col("run_id") == 7, F.lit(None)).otherwise(F.col("run_id")))
    for fn in (V.early_stop, V.best_checkpoint, V.early_stop_window):
        a = {r.run_id: r.asDict() for r in fn(history).collect()}
        b = {r.run_id: r.asDict() for r in fn(nulled).collect()}
        a7 = dict(a[7], run_id=None)
        assert b[None] == a7 and b[8] == a[8]
    lr = V.log_rate(nulled).where(F.col("run_id").isNull()).count()
    assert lr == len(LOSSES)
