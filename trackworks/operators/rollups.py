"""Grouped summaries of score, duration and level tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackworks.operators.ranges import in_parts, quantiles, with_quantiles


def balanced_and_pooled(df: DataFrame, keys: list[str], cls: str, score: str, song: str, digits: int = 6) -> DataFrame:
    """Per `keys`: the mean of class means, the mean over all rows, and the counts of rows and songs.

    NaN scores count as missing. The class level is a partial aggregate, so the second level sees one row per class.
    """
    x = df.withColumn(score, F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))).filter(F.col(score).isNotNull())
    classes = x.groupBy(*keys, cls).agg(F.avg(score).alias("_m")).groupBy(*keys).agg(F.round(F.avg("_m"), digits).alias("balanced"))
    pooled = x.groupBy(*keys).agg(F.round(F.avg(score), digits).alias("pooled"), F.count(F.lit(1)).alias("n_pairs"), F.countDistinct(song).alias("n_songs"))
    return pooled.join(classes, keys) if keys else pooled.crossJoin(classes)


def pool_summary(df: DataFrame, keys: list[str], value: str, per_hour: float = 3600.0, points: tuple[float, ...] = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0), digits: int = 6) -> DataFrame:
    """Count, hours, mean and exact percentiles (linear interpolation) of a duration, by keys."""
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.round(F.sum(value) / per_hour, digits).alias("hours"), F.round(F.avg(value), digits).alias("mean"))
    g = with_quantiles(g, df, keys, value, points)
    return g.select(*keys, "n", "hours", "mean", *[F.round(F.get("_q", F.lit(i)), digits).alias(f"p{round(100 * p)}") for i, p in enumerate(points)])


def below_thresholds(df: DataFrame, keys: list[str], value: str, thresholds: list[float], digits: int = 6) -> DataFrame:
    """For each threshold: rows shorter than it (strictly), their share and their share of the total. One aggregate, no cross join."""
    parts = [F.struct(F.lit(t).alias("threshold"), F.count_if(F.col(value) < t).alias("n_below"), F.coalesce(F.sum(F.when(F.col(value) < t, F.col(value))), F.lit(0)).alias("sum_below")) for t in thresholds]
    g = df.groupBy(*keys).agg(F.count(value).alias("_n"), F.sum(value).alias("_s"), F.array(*parts).alias("_t"))
    x = g.select(*keys, "_n", "_s", F.inline("_t"))
    return x.select(*keys, "threshold", "n_below", F.round(F.col("n_below") / F.col("_n"), digits).alias("share"), F.round(F.col("sum_below") / F.col("_s"), digits).alias("sum_share"))


def crosstab(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """Counts with margins: a row `all` and a column `all`."""
    c = df.groupBy(F.col(row).cast("string").alias(row), col).agg(F.count(F.lit(1)).alias("_n"))
    cells = [F.coalesce(F.sum(F.when(F.col(col) == v, F.col("_n"))), F.lit(0)).alias(str(v)) for v in values]
    return c.rollup(row).agg(*cells, F.sum("_n").alias("all"), F.grouping(row).alias("_g")).withColumn(row, F.when(F.col("_g") == 1, "all").otherwise(F.col(row))).drop("_g")


def outliers(df: DataFrame, keys: list[str], value: str, k: float = 1.5) -> DataFrame:
    """Rows above q75 + k times the interquartile range of their group, with that fence."""
    q = quantiles(df, keys, value, (0.25, 0.75), "_q").select(*keys, (F.get("_q", F.lit(1)) + k * (F.get("_q", F.lit(1)) - F.get("_q", F.lit(0)))).alias("fence"))
    return df.join(q, keys).filter(F.col(value) > F.col("fence"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often; grouped, so a key with most rows is one small sum."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def histogram(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int, digits: int = 6) -> DataFrame:
    """Counts and shares of equal bins over [low, high]; the last one is closed, what lies outside counts nowhere."""
    at = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    c = df.filter((F.col(value) >= low) & (F.col(value) <= high)).groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = c.groupBy(*keys).agg(F.sum("n").alias("_t"))
    return c.join(total, keys).withColumn("share", F.round(F.col("n") / F.col("_t"), digits)).drop("_t")


def gaussian_fit(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Mean vector and sample covariance of two columns, by keys."""
    return df.groupBy(*keys).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("cxy"))


def mahalanobis(x: str, y: str) -> "F.Column":
    """Squared distance of a row from a joined gaussian_fit."""
    dx, dy = F.col(x) - F.col("mx"), F.col(y) - F.col("my")
    det = F.col("vx") * F.col("vy") - F.col("cxy") * F.col("cxy")
    return (F.col("vy") * dx * dx - 2 * F.col("cxy") * dx * dy + F.col("vx") * dy * dy) / det


def ks_statistic(df: DataFrame, label: str, a, b, value: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and asymptotic p-value: one row.

    Counts of distinct values are summed up within parts of the values' order, then offset by the parts before, so no
    task sorts the whole table.
    """
    c = df.filter(F.col(label).isin(a, b) & F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(label) == a).alias("na"), F.count_if(F.col(label) == b).alias("nb"))
    r = in_parts(c, ["v"])
    sums = r.groupBy("_part").agg(F.sum("na").alias("sa"), F.sum("nb").alias("sb"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    base = sums.select("_part", F.coalesce(F.sum("sa").over(before), F.lit(0)).alias("ba"), F.coalesce(F.sum("sb").over(before), F.lit(0)).alias("bb"), F.sum("sa").over(Window.partitionBy()).alias("ta"), F.sum("sb").over(Window.partitionBy()).alias("tb"))
    own = Window.partitionBy("_part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    x = r.withColumns({"ca": F.sum("na").over(own), "cb": F.sum("nb").over(own)}).join(F.broadcast(base), "_part")
    d = x.agg(F.max(F.abs((F.col("ba") + F.col("ca")) / F.col("ta") - (F.col("bb") + F.col("cb")) / F.col("tb"))).alias("d"), F.max("ta").alias("n_a"), F.max("tb").alias("n_b"))
    lam = F.col("d") * F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam))
    return d.withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))
