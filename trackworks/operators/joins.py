"""Joins with the checks that belong to them, worklists, offsets and nested histories."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackworks.operators.gates import require_none, require_unique
from trackworks.operators.ranges import in_parts


def validated_left(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left and right's columns; raises if a key of right repeats or a row of left has no partner."""
    require_unique(right, key)
    require_none(left.join(right, key, "left_anti"), f"every {key} must have a row to join")
    return left.join(right, key)


def resumable(work: DataFrame, done: DataFrame, key: str, todo: str = "todo", cached: str = "cached") -> DataFrame:
    """All of `work` with `ops`: cached where `done` has the key already."""
    have = done.select(key).distinct().withColumn("_done", F.lit(True))
    return work.join(have, key, "left").withColumn("ops", F.when(F.col("_done"), cached).otherwise(todo)).drop("_done")


def prefix_offsets(df: DataFrame, order: str, n: str, out: str, parts: int | None = None, ties: Sequence[str] = (), part_rows: int | None = None) -> DataFrame:
    """Exclusive running sum of n in the order of a column (and `ties` where it repeats).

    Rows are summed within contiguous parts of that order, as many as their number asks for, and offset by the sums of the
    parts before: no task sorts the whole table, and a value that most rows have is split by its ties.
    """
    ranged = in_parts(df, [order, *ties], part_rows, parts)
    sums = ranged.groupBy("_part").agg(F.sum(n).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    base = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    local = Window.partitionBy("_part").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("_local", F.coalesce(F.sum(n).over(local), F.lit(0)))
    return own.join(F.broadcast(base), "_part").withColumn(out, F.col("_base") + F.col("_local")).drop("_part", "_base", "_local")


def history_rows(df: DataFrame, run: str, json: str) -> DataFrame:
    """Nested {epoch: {class: [score, ...]}} to one row a score; an empty or null history gives none."""
    kind = "map<string,map<string,array<double>>>"
    e = df.select(run, F.explode(F.from_json(json, kind)).alias("epoch", "_classes"))
    c = e.select(run, F.col("epoch").cast("int").alias("epoch"), F.explode("_classes").alias("class", "_scores"))
    return c.select(run, "epoch", "class", F.posexplode("_scores").alias("position", "score"))


def aligned_counts(tables: list[DataFrame], key: str) -> DataFrame:
    """Full outer join of count tables on key, with 0 for what is absent."""
    return reduce(lambda a, b: a.join(b, key, "full"), tables).na.fill(0)


def one_master(df: DataFrame, song: str, is_master: Column, stem: str) -> DataFrame:
    """Songs with exactly one master and at least one stem, and their stems sorted."""
    g = df.groupBy(song).agg(F.count_if(is_master).alias("n_masters"), F.count_if(~is_master).alias("n_stems"), F.sort_array(F.collect_list(F.when(~is_master, F.col(stem)))).alias("stems"))
    return g.filter("n_masters = 1 and n_stems >= 1")


def labelled_union(frames: dict[str, DataFrame], label: str) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(label, F.lit(k)) for k, df in frames.items()])


def paired(df: DataFrame, keys: list[str], run: str, value: str, a: str, b: str) -> DataFrame:
    """Values of two runs side by side where both have the key, and b minus a. One pass: no self-join."""
    g = df.filter(F.col(run).isin(a, b)).groupBy(*keys).agg(F.avg(F.when(F.col(run) == a, F.col(value))).alias("value_a"), F.avg(F.when(F.col(run) == b, F.col(value))).alias("value_b"))
    return g.filter("value_a is not null and value_b is not null").withColumn("delta", F.col("value_b") - F.col("value_a"))


def unordered_pairs(df: DataFrame, group: str, key: str) -> DataFrame:
    """Pairs key_a < key_b within a group: an equi-join, for groups that are small by nature (stems of a song)."""
    a, b = df.select(group, F.col(key).alias(f"{key}_a")), df.select(group, F.col(key).alias(f"{key}_b"))
    return a.join(b, group).filter(F.col(f"{key}_a") < F.col(f"{key}_b"))


def interval_intersections(a: DataFrame, b: DataFrame, keys: list[str], least: float = 0.0, bucket: float = 3600.0) -> DataFrame:
    """Spans (start, end) of a and b that overlap by `least` or more, by key.

    Both sides are dealt into time buckets, so a key with many spans is many join keys; a pair is taken in the bucket
    where its overlap begins, so it comes once.
    """

    def dealt(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.select(*keys, F.col("start").alias(s), F.col("end").alias(e), F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))).alias("_bucket"))

    j = dealt(a, "start_a", "end_a").join(dealt(b, "start_b", "end_b"), [*keys, "_bucket"])
    start, end = F.greatest("start_a", "start_b"), F.least("end_a", "end_b")
    return j.filter((end > start) & (end - start >= least) & (F.floor(start / bucket) == F.col("_bucket"))).select(*keys, start.alias("start"), end.alias("end"), "start_a", "start_b")


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """For each row of left the value of right's last row of the key at or before it; ties take the largest value.

    A union and one window instead of a range join: each side is read and sorted once.
    """
    cols = [c for c in left.columns if c not in (*keys, at)]
    u = left.select(*keys, at, *cols, F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side")).unionByName(
        right.select(*keys, at, F.col(value).alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy(at, "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    return u.withColumn(value, F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").drop("_v", "_side")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """For each row of left the value of right's row of the key nearest in `at`; of equals the earlier one, then the smallest value.

    The last row at or before it and the first at or after it come from one window each over a union: no range join.
    """
    cols = [c for c in left.columns if c not in (*keys, at)]
    r = right.groupBy(*keys, at).agg(F.min(value).alias("_v"))
    u = left.select(*keys, at, *cols, F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_o")).unionByName(r.select(*keys, at, "_v", F.lit(0).alias("_o")), allowMissingColumns=True)
    both = F.when(F.col("_o") == 0, F.struct(F.col(at).alias("t"), F.col("_v").alias("v")))
    w = Window.partitionBy(*keys)
    x = u.withColumns({"_b": F.last(both, True).over(w.orderBy(at, "_o").rowsBetween(Window.unboundedPreceding, 0)), "_a": F.last(both, True).over(w.orderBy(F.col(at).desc(), "_o").rowsBetween(Window.unboundedPreceding, 0))}).filter("_o = 1")
    later = F.col("_b").isNull() | (F.col("_a").isNotNull() & (F.col("_a.t") - F.col(at) < F.col(at) - F.col("_b.t")))
    return x.withColumn(value, F.when(later, F.col("_a.v")).otherwise(F.col("_b.v"))).drop("_v", "_o", "_a", "_b")
