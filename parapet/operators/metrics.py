"""Run metrics: mean loss and throughput per epoch, best epoch so far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Epochs of one run that are ordered within one task.
_SPAN = 4096


def _seconds(interval: Column) -> Column:
    """Length of a day-time interval, for timestamps with and without time zone alike."""
    part = lambda unit: F.extract(F.lit(unit), interval)
    whole = part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60
    return whole + part("SECOND").cast("double")


def epoch_rollup(
    steps: DataFrame, dataset_size: int | None = None, batch_size: int = 1
) -> DataFrame:
    """One row per ``run_id, epoch``: mean loss (0 without any), ``time_s``, ``throughput``.

    Time runs from the first to the last step. ``throughput`` is samples by second, with
    ``dataset_size`` samples per epoch or else ``batch_size`` per step; null when no time passed.
    """
    samples = F.lit(dataset_size) if dataset_size else F.count("*") * batch_size
    seconds = F.col("time_s")
    span = F.max("ts") - F.min("ts")
    return (
        steps.groupBy("run_id", "epoch")
        .agg(
            F.coalesce(F.avg("loss"), F.lit(0.0)).alias("loss"),
            _seconds(span).alias("time_s"),
            samples.cast("bigint").alias("_samples"),
        )
        .withColumn("throughput", F.when(seconds > 0, F.col("_samples") / seconds))
        .drop("_samples")
    )


def run_metrics(
    steps: DataFrame, dataset_size: int | None = None, batch_size: int = 1
) -> DataFrame:
    """``epoch_rollup`` plus ``is_best``: loss strictly below every earlier epoch of the run.

    The best loss starts at infinity, so an epoch whose loss is infinite or not a number never is
    the best one, and does not stand in the way of a later one.

    Steps are folded to epochs before anything is ordered. Within a run the lowest earlier loss
    is taken inside spans of epochs, and over the minima of the spans before, so a long run is
    never ordered by one task.
    """
    epochs = epoch_rollup(steps, dataset_size, batch_size).withColumn(
        "_span", F.floor(F.col("epoch") / _SPAN)
    )
    earlier = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("run_id", "_span").orderBy("epoch").rowsBetween(*earlier)
    spans = Window.partitionBy("run_id").orderBy("_span").rowsBetween(*earlier)
    # Taking the minimum of the whole epoch row, and joining null-safely, keep this branch equal to
    # the main one up to the shuffle of the roll-up, so Spark runs that once and reuses it.
    lowest = (
        epochs.groupBy("run_id", "_span")
        .agg(F.min(F.struct("loss", "epoch", "time_s", "throughput"))["loss"].alias("_low"))
        .select(
            F.col("run_id").alias("_run"),
            F.col("_span").alias("_of"),
            F.min("_low").over(spans).alias("_low_spans"),
        )
    )
    same = F.col("run_id").eqNullSafe(F.col("_run")) & F.col("_span").eqNullSafe(F.col("_of"))
    high = F.lit(float("inf"))  # Spark orders what is not a number above it
    best_before = F.least(F.col("_low_inside"), F.col("_low_spans"))
    return (
        epochs.withColumn("_low_inside", F.min("loss").over(inside))
        .join(lowest, same)
        .withColumn("is_best", F.col("loss") < F.coalesce(F.nanvl(best_before, high), high))
        .drop("_span", "_low_inside", "_low_spans", "_run", "_of")
    )


def run_totals(epochs: DataFrame) -> DataFrame:
    """One row per ``run_id`` of an epoch table: ``n_epochs``, ``best_loss``, ``total_time_s``.

    ``best_loss`` is the lowest finite loss, null where no epoch has one.
    """
    finite = F.when(F.abs("loss") < float("inf"), F.col("loss"))
    return epochs.groupBy("run_id").agg(
        F.count("*").alias("n_epochs"),
        F.min(finite).alias("best_loss"),
        F.sum("time_s").alias("total_time_s"),
    )
