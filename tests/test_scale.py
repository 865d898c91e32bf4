"""Cells of equal counts under bursts and outliers, cuts for many labels, scans over the cells of a hot run."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from urlsieve.operators import runs as V
from urlsieve.operators import sampling as P
from urlsieve.operators import tokens as T
from urlsieve.operators.ranking import distributed_rank, partition_rank, quantile_cells


def burst(spark, n=20_000):
    """Most values in a narrow burst, a few far outliers, and one value that half of all rows share."""
    v = F.when(F.col("id") < 5, F.col("id") * (1 << 55)).when(F.col("id") % 2 == 0, 777).otherwise(700 + F.col("id") % 150)
    return spark.range(n).select("id", v.cast("long").alias("v"), (F.col("id") * 7919 % n).alias("t"))


@pytest.mark.parametrize("cells", [8, 64])
def test_largest_cell_is_bounded(spark, cells):
    n = 20_000
    got = quantile_cells(burst(spark, n), "v", "t", cells=cells)
    largest = got.groupBy("_bkt").count().agg(F.max("count")).first()[0]
    assert largest <= 2.5 * n / cells
    ranked = distributed_rank(got.drop("_bkt").withColumn("c", F.lit(0)), ["v", "t"], F.lit(0))     # the plain order
    flat = [r._bkt for r in got.orderBy("v", "t").collect()]
    assert flat == sorted(flat) and ranked.count() == n


def test_ranks_over_cells(spark):
    df = burst(spark)
    want = {r.id: r.r for r in df.withColumn("r", F.row_number().over(Window.orderBy("v", "t"))).collect()}
    cells = quantile_cells(df, "v", "t", cells=32, out="cell")
    assert {r.id: r.rank for r in distributed_rank(cells, ["v", "t"], F.col("cell")).collect()} == want
    hot = df.withColumn("g", F.lit(1))
    assert {r.id: r.rank for r in partition_rank(hot, ["g"], ["v", "t"], "v", hot_rows=100, cells=16, tie="t").collect()} == want


def test_vocabulary_of_one_long_text(spark):
    """Every first occurrence lies in the same row."""
    words = [f"w{i:05d}" for i in range(3000)]
    df = spark.createDataFrame([(7, words * 2), (9, ["w00000", "zz", "zz"])], "row_id long, tokens array<string>")
    vocab = {r.token: r.idx for r in T.build_vocab(T.token_counts(df)).collect()}
    assert vocab == {w: i + 2 for i, w in enumerate([*words, "zz"])}


def test_split_of_ten_thousand_labels(spark):
    df = spark.range(60_000).select(F.col("id").alias("row_id"), F.when(F.col("id") < 20_000, -1).otherwise(F.col("id") % 10_000).alias("label"))
    got = P.stratified_split(df).groupBy("label").pivot("split", ["test", "validation", "train"]).count().na.fill(0).collect()
    assert len(got) == 10_001
    for r in got:
        n = r.test + r.validation + r.train
        test = -(-n // 5)
        assert (r.test, r.validation) == (test, -(-(n - test) // 5)), r


LOSSES = [0.5, 0.4, 0.45, 0.41, 0.42, 0.1]


def plain_stop(losses, patience):
    best, bad, best_epoch = float("inf"), 0, None
    for e, v in enumerate(losses, 1):
        if v < best:
            best, bad, best_epoch = v, 0, e
        else:
            bad += 1
        if bad >= patience:
            return e, e - patience, e
    return None, best_epoch, len(losses)


@pytest.mark.parametrize("patience", [1, 2, 3, 7, 40])
def test_scans_over_cells_equal_loops(spark, patience, monkeypatch):
    from urlsieve.operators import ranking

    monkeypatch.setattr(ranking, "CELLS", 32)
    r = random.Random(patience)
    runs = {1: [1 - i / 1000 + r.random() * 0.004 for i in range(700)], 2: [r.random() for _ in range(300)], 3: LOSSES, 4: [0.3],
            None: [1.0] + [1 - i / 500 for i in range(200)] + [0.9] * 60}
    rows = [(k, e, v, e * e + e % 7) for k, losses in runs.items() for e, v in enumerate(losses, 1)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "run_id long, epoch int, val_loss double, ts long").repartition(5)
    for hot_rows in (100, 1_000_000):       # runs cut into cells, or none
        got = {x.run_id: (x.stop_epoch, x.best_epoch, x.epochs_trained) for x in V.early_stop(df, patience, hot_rows=hot_rows).collect()}
        assert got == {k: plain_stop(v, patience) for k, v in runs.items()}
        window = {x.run_id: x.trigger_epoch for x in V.early_stop_window(df, patience, hot_rows=hot_rows).collect()}
        assert window == {k: next((e for e in range(patience + 1, len(v) + 1) if v[e - 1] > min(v[e - patience:e])), None) for k, v in runs.items()}
    timed = df.withColumn("ts", F.timestamp_seconds("ts"))
    a, b = (sorted(map(repr, V.log_rate(timed, hot_rows=h).collect())) for h in (100, 1_000_000))
    assert a == b and len(a) == len(rows)


def test_a_hot_run_is_many_tasks_and_no_row_is_copied(spark):
    df = spark.range(1, 4001).select(F.lit(1).alias("run_id"), F.col("id").cast("int").alias("epoch"), (F.col("id") % 97 / 97).alias("val_loss"))
    tagged = V._improvements(df, "run_id", "epoch", "val_loss", 1000)
    assert tagged.count() == 4000
    assert tagged.select("_cell").distinct().count() > 100
