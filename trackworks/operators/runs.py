"""Trajectories of training runs: gaps, swings, best and last values, status lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trajectory(df: DataFrame, keys: list[str], epoch: str, cls: str, score: str, steps: int) -> DataFrame:
    """By epoch the mean of class means, and the step (epoch + 1) * steps."""
    c = df.groupBy(*keys, epoch, cls).agg(F.avg(score).alias("_m"))
    return c.groupBy(*keys, epoch).agg(F.avg("_m").alias("overall"), ((F.col(epoch) + 1) * steps).alias("step"))


def aligned(df: DataFrame, arm: str, step: str, value: str, arms: list, warm_up: int) -> DataFrame:
    """One row per step that every arm has, after the warm-up: a column an arm."""
    g = df.filter(F.col(arm).isin(arms) & (F.col(step) > warm_up)).groupBy(step).agg(*[F.avg(F.when(F.col(arm) == a, F.col(value))).alias(f"arm_{a}") for a in arms])
    return g.filter(F.forall(F.array(*[F.col(f"arm_{a}").isNotNull() for a in arms]), lambda x: x))


def gap_verdict(gap: Column, swing: Column, clear: float = 2.0, close: float = 1.0) -> Column:
    """clear, close or noise, as the gap is over the swing."""
    ratio = F.when(swing > 0, F.abs(gap) / swing)
    return F.when(swing.isNull() | gap.isNull(), "unknown").when(ratio.isNull() | (ratio >= clear), "clear").when(ratio >= close, "close").otherwise("noise")


def summary(df: DataFrame, run: str, epoch: str, value: str) -> DataFrame:
    """By run: best epoch and value (the first of equals), last epoch and value, number of evaluations."""
    return df.groupBy(run).agg(
        F.max_by(epoch, F.struct(F.col(value), -F.col(epoch))).alias("best_epoch"), F.max(value).alias("best"),
        F.max(epoch).alias("last_epoch"), F.max_by(value, epoch).alias("last"), F.count(value).alias("n_evals"),
    )


def latest_delta(df: DataFrame, run: str, epoch: str, value: str) -> DataFrame:
    """The last evaluation of a run, its change from the one before, and how far it lies below the run's best."""
    w = Window.partitionBy(run)
    x = df.withColumns({"previous": F.lag(value).over(w.orderBy(epoch)), "best": F.max(value).over(w), "_rn": F.row_number().over(w.orderBy(F.col(epoch).desc()))})
    return x.filter("_rn = 1").select(run, epoch, value, (F.col(value) - F.col("previous")).alias("delta"), (F.col("best") - F.col(value)).alias("below_best"))


def status(last_seen: Column, median_epoch: Column, now: Column, done: Column, non_finite: Column, drops: Column) -> Column:
    """One word a run: done, nan, stalled (silent for twice the median epoch), drop or ok."""
    return F.when(done, "done").when(non_finite > 0, "nan").when(now - last_seen > 2 * median_epoch, "stalled").when(drops, "drop").otherwise("ok")
