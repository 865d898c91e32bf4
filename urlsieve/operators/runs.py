"""Training-run analytics over epoch histories (V1–V4), for many runs at once.

Input: run_id, epoch (1, 2, … consecutive per run), val_loss, train_loss,
accuracy, ts.  Nothing here is a window partitioned by run alone: a run
holding most rows would sort in one task.  A hot run is cut into cells of
about equal counts along its epochs; windows run inside (run, cell), and a
row never moves to, or is copied for, another cell.  What crosses a cell's
edge is small: the least loss so far, the last few values before the cell, or
a cell's summary, which are folded along the cells of each run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import epoch_micros
from ..session import cut_lineage
from .ranking import HOT_ROWS, hot_cells, join_on, running_agg

DEFAULT_PATIENCE = 3
LOGGING_STEPS = 50
# Fixed values of the step estimate: batch 4 x accumulation 8, 0.8 s per step.
BATCH_SIZE, ACCUMULATION, SECONDS_PER_STEP = 4, 8, 0.8


def improvements(history: DataFrame, run: str = "run_id", epoch: str = "epoch",
                 loss: str = "val_loss", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``improved``: loss < every earlier loss of the run (the first epoch
    always, unless its loss is NaN: that never improves)."""
    return _improvements(history, run, epoch, loss, hot_rows).drop("_cell")


def _improvements(history: DataFrame, run: str, epoch: str, loss: str, hot_rows: int) -> DataFrame:
    """``improved`` and ``_cell``: the running minimum is scanned per (run, cell)."""
    tagged, _ = hot_cells(history, [run], epoch, hot_rows=hot_rows, out="_cell")
    r = running_agg(tagged, [run], [epoch], F.col("_cell"), loss, "min", out="_prev_best", exclusive=True)
    return r.withColumn("improved", (F.col("_prev_best").isNull() & ~F.isnan(loss)) | (F.col(loss) < F.col("_prev_best"))) \
            .drop("_prev_best")


def best_checkpoint(history: DataFrame, run: str = "run_id", epoch: str = "epoch",
                    loss: str = "val_loss") -> DataFrame:
    """V1: the last improving epoch = the first epoch reaching the run's
    minimum loss.  Two hash aggregates (map-side partials, one row per run
    and task shuffled): the minimum per run, written once, then the first epoch at it."""
    best = cut_lineage(history.groupBy(run).agg(F.min(F.when(~F.isnan(loss), F.col(loss))).alias("best_val_loss"),
                                                F.count(F.lit(1)).alias("epochs")))
    at_best = join_on(history.select(run, epoch, loss), best, [run]).where(F.col(loss) == F.col("best_val_loss"))
    first = at_best.groupBy(run).agg(F.min(epoch).alias("best_epoch"))
    return join_on(best, first, [run], "left").select(run, "best_epoch", "best_val_loss", "epochs")


def early_stop(history: DataFrame, patience: int = DEFAULT_PATIENCE, run: str = "run_id",
               epoch: str = "epoch", loss: str = "val_loss", hot_rows: int = HOT_ROWS) -> DataFrame:
    """V2: stop at the first epoch ending ``patience`` epochs in a row without
    improvement; later epochs are ignored.  best_epoch = the checkpoint kept.

    A cell is summed up by what any number of epochs without improvement before it could
    need: its epochs, those before its first improvement (of them the first ``patience``
    by name), those after its last one, and its first stop after an improvement.  The
    summaries of a run's cells are folded in order."""
    imp = _improvements(history.select(run, epoch, loss), run, epoch, loss, hot_rows)
    w = Window.partitionBy(run, "_cell").orderBy(epoch)
    at = imp.withColumn("_at", F.row_number().over(w))
    at = at.withColumn("_last", F.max(F.when(F.col("improved"), F.col("_at"))).over(w))     # the latest improvement in the cell
    since = F.col("_at") - F.coalesce("_last", F.lit(0))
    opening = F.col("_last").isNull() & (F.col("_at") <= patience)
    cells = at.groupBy(run, "_cell").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("improved"), F.col(epoch))).alias("best"),
        F.count(F.when(F.col("_last").isNull(), 1)).alias("lead"), (F.max("_at") - F.max("_last")).alias("trail"),
        F.array_sort(F.collect_list(F.when(opening, F.col(epoch)))).alias("heads"),
        F.min(F.when(F.col("_last").isNotNull() & (since >= patience), F.col(epoch))).alias("stop"))
    runs = cells.groupBy(run).agg(F.array_sort(F.collect_list(
        F.struct("_cell", "n", "best", "lead", "trail", "heads", "stop"))).alias("cells"))
    none = F.lit(None).cast(history.schema[epoch].dataType)
    start = F.struct(F.lit(0).cast("long").alias("bad"), none.alias("stop"), none.alias("best"), F.lit(0).cast("long").alias("n"))

    def fold(s: Column, c: Column) -> Column:
        crossing = F.when((c["lead"] > 0) & (s["bad"] + c["lead"] >= patience), F.get(c["heads"], (patience - s["bad"] - 1).cast("int")))
        return F.struct(
            F.when(c["best"].isNull(), s["bad"] + c["n"]).otherwise(c["trail"].cast("long")).alias("bad"),
            F.coalesce(s["stop"], crossing, c["stop"]).alias("stop"),
            F.coalesce(c["best"], s["best"]).alias("best"), (s["n"] + c["n"]).alias("n"))

    j = runs.select(run, F.aggregate("cells", start, fold).alias("s"))
    return j.select(
        run, F.col("s.stop").alias("stop_epoch"),
        F.when(F.col("s.stop").isNotNull(), F.col("s.stop") - patience).otherwise(F.col("s.best")).cast("int").alias("best_epoch"),
        F.coalesce(F.col("s.stop"), F.col("s.n")).cast("int").alias("epochs_trained"))


def _with_earlier(history: DataFrame, value: str, width: int, run: str, epoch: str, hot_rows: int) -> DataFrame:
    """Adds ``_earlier``: up to ``width`` values before each row, latest last; ``_logs``: rows of the run.

    Inside a cell they come from a window.  Only the last ``width`` values of each cell go to
    the cells after it, folded along the cells of a run, as a cell may have fewer rows."""
    tagged, hot = hot_cells(history, [run], epoch, hot_rows=hot_rows, out="_cell")
    w = Window.partitionBy(run, "_cell").orderBy(epoch)
    before = F.collect_list(value).over(w.rowsBetween(-width, -1))
    rows = tagged.withColumn("_earlier", before)
    if hot is None:
        return rows.withColumn("_logs", F.count(F.lit(1)).over(Window.partitionBy(run, "_cell"))).drop("_cell")
    size = F.count(F.lit(1)).over(Window.partitionBy(run, "_cell"))
    last = tagged.withColumn("_at", F.row_number().over(w)).withColumn("_n", size).where(F.col("_at") > F.col("_n") - width)
    cells = last.groupBy(run, "_cell").agg(F.max("_n").alias("n"), F.transform(
        F.array_sort(F.collect_list(F.struct("_at", value))), lambda x: x[value]).alias("tail"))
    runs = cells.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("_cell", "n", "tail"))).alias("cells"))
    kind = history.schema[value].dataType.simpleString()
    start = F.array().cast(f"array<struct<_cell:bigint,incoming:array<{kind}>,outgoing:array<{kind}>>>")

    def fold(done: Column, c: Column) -> Column:
        incoming = F.coalesce(F.try_element_at(done, F.lit(-1))["outgoing"], F.array().cast(f"array<{kind}>"))
        joined = F.concat(incoming, c["tail"])
        outgoing = F.slice(joined, F.greatest(F.size(joined) - width + 1, F.lit(1)), F.lit(width))
        return F.concat(done, F.array(F.struct(c["_cell"].alias("_cell"), incoming.alias("incoming"), outgoing.alias("outgoing"))))

    logs = F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + c["n"])
    edges = cut_lineage(runs.select(run, logs.alias("_logs"), F.explode(F.aggregate("cells", start, fold)).alias("e"))
                        .select(run, "e._cell", "_logs", F.col("e.incoming").alias("_incoming")))
    joined = join_on(rows, edges, [run, "_cell"])
    both = F.concat("_incoming", "_earlier")
    return joined.withColumn("_earlier", F.slice(both, F.greatest(F.size(both) - width + 1, F.lit(1)), F.lit(width))) \
        .drop("_incoming", "_cell")


def early_stop_window(history: DataFrame, patience: int = DEFAULT_PATIENCE, run: str = "run_id",
                      epoch: str = "epoch", loss: str = "val_loss", hot_rows: int = HOT_ROWS) -> DataFrame:
    """V2 variant: first epoch with more than ``patience`` epochs seen whose
    loss exceeds the minimum of the last ``patience`` losses (itself included)."""
    rows = _with_earlier(history.select(run, epoch, loss), loss, max(patience - 1, 1), run, epoch, hot_rows)
    trigger = (F.col(epoch) > patience) & (F.col(loss) > F.array_min("_earlier"))
    if patience < 2:        # a loss alone is its own minimum
        trigger = F.lit(False)
    return rows.groupBy(run).agg(F.min(F.when(trigger, F.col(epoch))).cast("int").alias("trigger_epoch"))


def log_rate(history: DataFrame, logging_steps: int = LOGGING_STEPS, run: str = "run_id",
             epoch: str = "epoch", ts: str = "ts", hot_rows: int = HOT_ROWS) -> DataFrame:
    """V3: per log row, steps/min = 60 / seconds since the previous log x
    logging_steps and ETA = remaining steps / rate (null on a run's first log).
    global_step = epoch x logging_steps; max_steps = logs of the run x logging_steps."""
    micros = epoch_micros(ts, history.schema[ts].dataType)
    j = _with_earlier(history.select(run, epoch, micros.alias("_us")), "_us", 1, run, epoch, hot_rows)
    dt = (F.col("_us") - F.get("_earlier", F.lit(0))) / F.lit(1e6)
    spm = F.try_divide(F.lit(60.0), dt) * F.lit(float(logging_steps))
    remaining = (F.col("_logs") - F.col(epoch)) * logging_steps
    return j.select(
        run, F.col(epoch).cast("int").alias(epoch),
        (F.col(epoch) * logging_steps).alias("global_step"),
        spm.alias("steps_per_minute"),
        F.try_divide(remaining.cast("double"), spm).alias("eta_minutes"))


def training_history(history: DataFrame, run: str = "run_id", epoch: str = "epoch") -> DataFrame:
    """V4: long table run, epoch, metric, value (the loss-curve data)."""
    return history.select(run, epoch, "train_loss", "val_loss", "accuracy").unpivot(
        [run, epoch], ["train_loss", "val_loss", "accuracy"], "metric", "value")


def training_estimate(rows: DataFrame) -> DataFrame:
    """Step estimate of a tuning run: total steps = rows div (batch x
    accumulation); time at 0.8 s per step (one unit throughout)."""
    per_step = BATCH_SIZE * ACCUMULATION
    agg = rows.agg(F.count(F.lit(1)).alias("rows"))
    steps = F.floor(F.col("rows") / per_step)
    return agg.select("rows", steps.alias("total_steps"),
                      (steps * F.lit(SECONDS_PER_STEP)).alias("estimated_seconds"),
                      (steps * F.lit(SECONDS_PER_STEP) / F.lit(3600.0)).alias("estimated_hours"))
