"""Orders in parts: the same as over all rows at once, with parts, chunks and cells so small that there are many."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trackworks.operators import joins, ranges, sampling
from trackworks.operators import sequences as S


@pytest.mark.parametrize("part_rows", [None, 40])
def test_quantiles_by_keys_with_nulls_ties_and_one_row(spark, part_rows):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, float(rng.randint(0, 9)), rng.gauss(0, 1)])) for _ in range(900)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    points = (0.0, 0.05, 0.3, 0.5, 0.95, 1.0)
    got = {r["k"]: r["q"] for r in ranges.quantiles(df, ["k"], "v", points, part_rows=part_rows).collect()}
    want = {k: np.quantile([v for kk, v in rows if kk == k and v is not None], points) for k in ("a", "b", None, "one")}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    (whole,) = ranges.quantiles(df, [], "v", points, part_rows=part_rows).collect()
    assert np.allclose(whole["q"], np.quantile([v for _, v in rows if v is not None], points))
    assert ranges.quantiles(df.limit(0), [], "v", points).count() == 0


def test_no_task_keeps_a_groups_values(spark):
    df = spark.range(2000).select((F.col("id") * 7919 % 2000).cast("double").alias("v"))
    q = ranges.quantiles(df, [], "v", (0.5,), part_rows=100)
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and q.first()["q"] == [999.5]
    sizes = [r["count"] for r in ranges.in_parts(df, ["v"], 100).groupBy("_part").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 200


def test_running_sums_where_most_values_are_equal(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(5).alias("v"), (F.col("id") % 7).alias("n")).repartition(8)
    sizes = [r["count"] for r in ranges.in_parts(df, ["v", "id"], 1000).groupBy("_part").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2000
    got = {r["id"]: r["at"] for r in joins.prefix_offsets(df, "v", "n", "at", ties=("id",), part_rows=1000).collect()}
    total = 0
    for v, i in sorted((i if i % 10 == 0 else 5, i) for i in range(20_000)):
        assert got[i] == total
        total += i % 7


def test_folds_are_carried_over_chunks(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab") if i % 9 else None, i, rng.choice([None, rng.randint(-50, 50)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i long, v int").repartition(6)
    v = F.col("v")
    for inclusive in (True, False):
        to = 0 if inclusive else -1
        w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, to)
        want = df.select("k", "i", F.sum(v).over(w).alias("s"), F.max(v).over(w).alias("m"), F.min(v).over(w).alias("n"), F.last(v, True).over(w).alias("l"))
        got = ranges.carried(df, "k", ["i"], F.floor(F.col("i") / 7), inclusive=inclusive, s=("sum", v), m=("max", v), n=("min", v), l=("last", v)).select(want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def levels(spark, n=700, seed=3):
    rng = random.Random(seed)
    rows = [(k, i, float(rng.randint(0, 10))) for k in ("x", "y") for i in range(n) if k == "x" or rng.random() < 0.9]
    return spark.createDataFrame(rows, "k string, idx long, level double").repartition(5), rows


def test_segments_of_a_file_in_a_hundred_chunks(spark):
    df, _ = levels(spark)
    args = ("k", "idx", "level", 9.0, 4.0, 3, 4, 2)
    rows = lambda x: sorted(map(str, x.collect()))
    few, many = S.segments(df, *args), S.segments(df, *args, chunk=7)
    assert rows(few) == rows(many) and many.count() > 20
    assert rows(S.segment_rows(few, df, "k", "idx", "level")) == rows(S.segment_rows(few, df, "k", "idx", "level", chunk=7))
    assert rows(S.rests(few, "k")) == rows(S.rests(few, "k", chunk=5))
    assert rows(S.runs(df, "k", "idx", F.col("level") > 2)) == rows(S.runs(df, "k", "idx", F.col("level") > 2, chunk=6))
    spans = df.select("k", F.col("idx").alias("start"), (F.col("idx") + F.col("level")).alias("end")).sample(0.3, 4)
    assert rows(S.merged(spans, "k")) == rows(S.merged(spans, "k", chunk=9))
    opens = dict(low=("min", F.col("level")), peak=("max", F.col("level")), n=("sum", F.lit(1)), tops=("any", F.col("level") >= 9))
    want = S.runs(df, "k", "idx", F.col("level") > 2, **opens)
    assert rows(want) == rows(S.runs(df, "k", "idx", F.col("level") > 2, chunk=3, **opens))
    assert all(r["n"] == r["end"] - r["start"] and r["tops"] == (r["peak"] >= 9) and r["low"] > 2 for r in want.collect())
    w = Window.partitionBy("k").orderBy("idx")
    last = F.when(F.col("level") > 8, F.col("idx"))
    assert rows(S.filled_forward(df, "k", "idx", last, "at", chunk=4)) == rows(df.withColumn("at", F.last(last, True).over(w)))
    whole = df.filter("k = 'x'")
    means = whole.select("k", F.col("idx").alias("start"), F.avg("level").over(w.rowsBetween(0, 7)).alias("m"), F.max("idx").over(w.rowsBetween(0, 7)).alias("_e")).filter("_e = start + 7").drop("_e")
    for chunk in (None, 3, 50):  # windows longer than a chunk, and shorter
        assert rows(S.sliding(whole, "k", "idx", 8, chunk, m=lambda v: F.avg("level").over(v))) == rows(means)
    assert rows(S.window_energy(whole, "k", "idx", F.col("level"), 5)) == rows(S.window_energy(whole, "k", "idx", F.col("level"), 5, chunk=6))


@pytest.mark.parametrize("seed", range(4))
def test_unions_in_chunks_are_those_of_a_plain_scan(spark, seed):
    """Spans that swallow whole chunks, equal starts, spans of one point, negative starts, and a null key."""
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "b", None]), s := float(rng.randint(-60, 200)), s + rng.choice([0.0, 0.5, 1.0, 2.0, 40.0])) for _ in range(120)]
    df = spark.createDataFrame(rows, "k string, start double, end double").repartition(3)

    def plain(keyed, begins):
        found = []
        for s, e in sorted(keyed):
            if not found or begins(s, found[-1][1]):
                found.append([s, e])
            found[-1][1] = max(found[-1][1], e)
        return [tuple(x) for x in found]

    for begins, union in ((lambda s, e: s > e, lambda c: S.merged(df, "k", c)), (lambda s, e: s - e >= 3, lambda c: S.bridged(df, "k", 3, c))):
        want = sorted((str(k), *x) for k in ("a", "b", None) for x in plain([(s, e) for kk, s, e in rows if kk == k], begins))
        for chunk in (1, 7, None):
            assert sorted((str(r["k"]), r["start"], r["end"]) for r in union(chunk).collect()) == want


def test_no_window_over_rows_is_by_file_alone(spark, monkeypatch):
    monkeypatch.setattr(S, "kept", lambda df: df)  # the plan as one
    df, _ = levels(spark)
    scans = [S.runs(df, "k", "idx", F.col("level") > 2), S.merged(df.withColumnsRenamed({"idx": "start", "level": "end"}), "k"), S.mean_step(df, "k", "idx", "level")]
    for x in scans:
        text = x._jdf.queryExecution().optimizedPlan().toString()
        for keys, order in re.findall(r"windowspecdefinition\(([^\]]*?), (\w+)#\d+L? ASC", text):
            assert "_chunk" in keys or order == "_chunk", (keys, order)


def test_draws_ranked_in_cells_are_those_of_a_sort(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "rare").when(F.col("id") % 50 == 1, None).otherwise("most").alias("s")).repartition(4)
    u = sampling.draw(5, F.col("id"), "t")
    want = df.select("id", F.row_number().over(Window.partitionBy("s").orderBy(u, "id")).alias("_rank"))
    got = ranges.ranked_draws(df, "s", u, "id", cell_rows=64).select("id", "_rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    first = ranges.ranked_draws(df, "s", u, "id", most=F.lit(70), cell_rows=64).filter("_rank <= 70")
    assert sorted(r["id"] for r in first.collect()) == sorted(r["id"] for r in want.filter("_rank <= 70").collect())
    assert ranges.ranked_draws(df, "s", u, "id", most=F.lit(70), cell_rows=64).count() < 600


def test_ranks_by_parts_are_those_of_a_sort(spark):
    df = spark.range(2500).select("id", F.when(F.col("id") % 5 == 0, "few").when(F.col("id") % 97 == 1, None).otherwise("most").alias("k"), (F.col("id") * 7 % 11).alias("v")).repartition(4)
    w = Window.partitionBy("k")
    want = df.withColumns({"r": F.row_number().over(w.orderBy("v", "id")), "t": F.count(F.lit(1)).over(w)})
    for rows in (None, 100):
        got = ranges.ranked(df, ["k"], ["v", "id"], "r", "t", rows)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
