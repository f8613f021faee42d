"""Sampling queries over customers (files), parts (rooms), events (spans) and items made from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackworks.operators import columns as C
from trackworks.operators import sampling as P
from trackworks.plans.activity import SPANS, _MERGE, spans
from trackworks.operators import sequences as S
from trackworks.registry import registry
from trackworks.session import table

query = registry.query


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer", "c_custkey", "c_mktsegment")


@query("g2_quota_sample", f"""WITH c AS (SELECT c_mktsegment s, count(*) n FROM customer GROUP BY 1), t AS (SELECT sum(n) t FROM c), q AS (SELECT s, least(n, greatest(8, floor(n * 100 / t))) q FROM c, t)
SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {C.draw_sql(3, 'c_custkey', 'quota')}, c_custkey) r FROM customer) JOIN q ON s = c_mktsegment WHERE r <= q""")
def g2(spark: SparkSession, d: str) -> DataFrame:
    return P.quota_sample(files(spark, d), "c_custkey", "c_mktsegment", 3, 100, 8)


@query("g3_round_robin", f"""SELECT c_custkey, c_mktsegment, turn FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {C.draw_sql(4, 'c_custkey', 'turn')}, c_custkey) AS turn FROM customer) WHERE turn <= 7 ORDER BY turn, c_mktsegment LIMIT 32""")
def g3(spark: SparkSession, d: str) -> DataFrame:
    return P.round_robin(files(spark, d), "c_custkey", "c_mktsegment", 4, 32, 7)


_MG = f"{SPANS}, {_MERGE.format(k='file_id')}"


@query("g4_window_draw", f"""WITH {_MG}, x AS (SELECT *, e - s l, coalesce(sum(e - s) OVER (PARTITION BY file_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b, sum(e - s) OVER (PARTITION BY file_id) t FROM mg), y AS (SELECT *, {C.draw_sql(5, 'file_id', 'window')} * t a FROM x)
SELECT file_id, s AS start, e AS "end", round(greatest(0, least(s + (a - b) - 300, e - 600)), 3) AS at FROM y WHERE a >= b AND a < b + l""")
def g4(spark: SparkSession, d: str) -> DataFrame:
    x = P.weighted_span(S.merged(spans(spark, d), "file_id"), ["file_id"], "start", "end", C.draw(5, F.col("file_id"), "window"))
    return x.select("file_id", "start", "end", F.round(P.clamped_window(F.col("start"), F.col("offset"), 600.0, F.col("end")), 3).alias("at"))


@query("g5_windows_per_class", f"""WITH i AS (SELECT event_type AS pool, unnest(range(0, 20)) AS window_index FROM (SELECT DISTINCT event_type FROM events)), r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY {C.draw_sql(6, 'event_id', 'pool')}, event_id) - 1 r FROM events)
SELECT pool, window_index, event_id AS source, round({C.draw_sql(6, "pool || ':' || window_index", 'offset')} * 60, 6) AS "offset" FROM i JOIN r ON event_type = pool AND r = window_index""")
def g5(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_type", "event_id").withColumnRenamed("event_type", "pool")
    r = e.withColumn("window_index", F.row_number().over(Window.partitionBy("pool").orderBy(C.draw(6, F.col("event_id"), "pool"), "event_id")) - 1).filter("window_index < 20")
    key = F.concat_ws(":", "pool", F.col("window_index").cast("string"))
    return r.select("pool", "window_index", F.col("event_id").alias("source"), F.round(C.draw(6, key, "offset") * 60, 6).alias("offset"))


@query("g6_loudness_target", f"""WITH n AS (SELECT c_mktsegment, count(*) n, avg(c_acctbal / 1000) m, stddev_pop(c_acctbal / 1000) sd FROM customer WHERE c_nationkey < 8 GROUP BY 1), a AS (SELECT avg(c_acctbal / 1000) m FROM customer WHERE c_nationkey < 8)
SELECT c_custkey, CASE WHEN n >= 90 THEN 'empirical' WHEN n >= 20 THEN 'class' ELSE 'pooled' END AS tier, round(greatest(-12, least(6, CASE WHEN n >= 90 THEN n.m + n.sd * sqrt(-2 * ln(greatest({C.draw_sql(8, 'c_custkey', 'u')}, 1e-12))) * cos(2 * 3.141592653589793 * {C.draw_sql(8, 'c_custkey', 'v')}) WHEN n >= 20 THEN n.m ELSE a.m END - c_acctbal / 1000)), 5) AS gain_db FROM customer LEFT JOIN n USING (c_mktsegment), a""")
def g6(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal").withColumn("lufs", F.col("c_acctbal") / 1000)
    known = c.filter("c_nationkey < 8")
    n = known.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.avg("lufs").alias("m"), F.stddev_pop("lufs").alias("sd"))
    pooled = known.agg(F.avg("lufs").alias("pm"))
    x = c.join(n, "c_mktsegment", "left").join(F.broadcast(pooled))  # one row
    tier = F.when(F.col("n") >= 90, "empirical").when(F.col("n") >= 20, "class").otherwise("pooled")
    z = P.normal(C.draw(8, F.col("c_custkey"), "u"), C.draw(8, F.col("c_custkey"), "v"))
    target = F.when(tier == "empirical", F.col("m") + F.col("sd") * z).when(tier == "class", F.col("m")).otherwise(F.col("pm"))
    return x.select("c_custkey", tier.alias("tier"), F.round(C.gain_of(target - F.col("lufs"), -12.0, 6.0)[0], 5).alias("gain_db"))


@query("g7_density", "WITH k AS (SELECT l_orderkey, count(DISTINCT l_linestatus || l_returnflag) n FROM lineitem GROUP BY 1) SELECT n AS n_classes, count(*) AS n_songs, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM k GROUP BY 1")
def g7(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "lineitem", "l_orderkey", "l_linestatus", "l_returnflag").groupBy("l_orderkey").agg(F.countDistinct("l_linestatus", "l_returnflag").alias("n_classes"))
    c = k.groupBy("n_classes").agg(F.count(F.lit(1)).alias("n_songs"))
    return c.join(F.broadcast(c.agg(F.sum("n_songs").alias("t")))).select("n_classes", "n_songs", F.round(F.col("n_songs") / F.col("t"), 6).alias("share"))  # a row a class count


_KEY = "event_id || ':' || class"


@query("g8_item_plan", f"""WITH i AS (SELECT event_id, 1 + floor({C.draw_sql(9, 'event_id', 'n')} * 4)::INTEGER n, {C.draw_sql(9, 'event_id', 'k')} u FROM events), c AS (SELECT DISTINCT event_type AS class FROM events),
r AS (SELECT event_id, n, u, class, row_number() OVER (PARTITION BY event_id ORDER BY {C.draw_sql(9, _KEY, 'class')}, class) - 1 slot FROM i, c), k AS (SELECT *, floor(0.4 * n) + CASE WHEN u < 0.4 * n - floor(0.4 * n) THEN 1 ELSE 0 END k0 FROM r WHERE slot < n)
SELECT event_id AS item, n, slot::INTEGER AS slot, class, (CASE WHEN k0 = 1 THEN CASE WHEN n >= 2 AND u < 0.5 THEN 2 ELSE 0 END ELSE k0 END)::BIGINT AS k FROM k""")
def g8(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "event_type")
    items = e.select(F.col("event_id").alias("item"), (1 + F.floor(C.draw(9, F.col("event_id"), "n") * 4)).cast("int").alias("n"), C.draw(9, F.col("event_id"), "k").alias("u"))
    x = P.distinct_classes(items, "item", "n", e.select(F.col("event_type").alias("class")).distinct(), "class", 9)
    return x.select("item", "n", "slot", "class", P.coherent_count(0.4, F.col("n"), F.col("u")).cast("long").alias("k"))


@query("g9_source_pool", "SELECT source AS class, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1")
def g9(spark: SparkSession, d: str) -> DataFrame:
    active = table(spark, d, "labels", "doc_id", "quality").filter("quality = 1")
    return table(spark, d, "documents", "doc_id", "source").join(active, "doc_id", "left_semi").groupBy(F.col("source").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("g10_melodic", "SELECT p_brand AS class, bool_or(p_size > 48) AS melodic FROM part GROUP BY 1")
def g10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part", "p_brand", "p_size").groupBy(F.col("p_brand").alias("class")).agg(F.bool_or(F.col("p_size") > 48).alias("melodic"))


@query("g13_gate_draws", f"""SELECT event_id AS item, {C.draw_sql(10, 'event_id', 'swap')} < 0.3 AS swap, {C.draw_sql(10, 'event_id', 'eq')} < 0.5 AS eq, round(-6 + 12 * {C.draw_sql(10, 'event_id', 'gain')}, 6) AS gain_db FROM events""")
def g13(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, d, "events", "event_id").select(i.alias("item"), (C.draw(10, i, "swap") < 0.3).alias("swap"), (C.draw(10, i, "eq") < 0.5).alias("eq"), F.round(-6 + 12 * C.draw(10, i, "gain"), 6).alias("gain_db"))


@query("g15_banded_bank", f"""WITH b AS (SELECT p_partkey, p_size, CASE WHEN p_size < 10 THEN 'near' WHEN p_size < 30 THEN 'mid' ELSE 'far' END AS band FROM part) SELECT band, p_partkey AS room, row_number() OVER (PARTITION BY band ORDER BY {C.draw_sql(11, 'p_partkey', 'room')}, p_partkey) AS pick FROM b QUALIFY pick <= 10""")
def g15(spark: SparkSession, d: str) -> DataFrame:
    b = P.banded(table(spark, d, "part", "p_partkey", "p_size"), "p_size", [("near", 0, 10), ("mid", 10, 30), ("far", 30, None)])
    w = Window.partitionBy("band").orderBy(C.draw(11, F.col("p_partkey"), "room"), "p_partkey")
    return b.select("band", F.col("p_partkey").alias("room"), F.row_number().over(w).alias("pick")).filter("pick <= 10")


@query("g16_blind_sides", f"SELECT event_id AS row, CASE WHEN {C.draw_sql(12, 'event_id', 'side')} < 0.5 THEN 'A' ELSE 'B' END AS side FROM events WHERE value > 1")
def g16(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_id", "value").filter("value > 1").select(F.col("event_id").alias("row"), F.when(C.draw(12, F.col("event_id"), "side") < 0.5, "A").otherwise("B").alias("side"))


@query("g17_stage_plan", f"""WITH x AS (SELECT event_id AS item, CASE WHEN event_id % 3 = 0 THEN 'i' || event_id WHEN event_id % 3 = 1 THEN 'u' || user_id ELSE 'c' || event_type END AS scope_key FROM events)
SELECT item, scope_key, {C.draw_sql(13, 'scope_key', 'envelope')} < 0.5 AS envelope, {C.draw_sql(13, 'scope_key', 'bus')} < 0.3 AS bus, CASE WHEN {C.draw_sql(13, 'scope_key', 'degrade')} < 0.25 THEN round(10 + 30 * {C.draw_sql(13, 'scope_key', 'snr')}, 6) END AS snr_db FROM x""")
def g17(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("event_id") % 3
    scope = F.when(m == 0, F.concat(F.lit("i"), "event_id")).when(m == 1, F.concat(F.lit("u"), "user_id")).otherwise(F.concat(F.lit("c"), "event_type"))
    x = table(spark, d, "events", "event_id", "user_id", "event_type").select(F.col("event_id").alias("item"), scope.alias("scope_key"))
    u = lambda s: C.draw(13, F.col("scope_key"), s)
    return x.select("item", "scope_key", (u("envelope") < 0.5).alias("envelope"), (u("bus") < 0.3).alias("bus"), F.when(u("degrade") < 0.25, F.round(10 + 30 * u("snr"), 6)).alias("snr_db"))


@query("h6_duration_drift", "SELECT round(100 * (sum(CASE WHEN n_chars IS NULL THEN 0 ELSE n_chars END) - sum(length(text))) / sum(length(text)), 6) AS drift_percent, sum(length(text))::BIGINT AS total FROM documents")
def h6(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents", "text", "n_chars").agg(F.sum(F.coalesce("n_chars", F.lit(0))).alias("a"), F.sum(F.length("text")).alias("total"))
    return x.select(F.round(100 * (F.col("a") - F.col("total")) / F.col("total"), 6).alias("drift_percent"), "total")


@query("h10_equal_counts", "WITH c AS (SELECT event_type AS class, user_id % 2 arm, count(*) n FROM events GROUP BY 1, 2) SELECT class, count(DISTINCT n) = 1 AS equal FROM c GROUP BY 1")
def h10(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events", "event_type", "user_id").groupBy(F.col("event_type").alias("class"), (F.col("user_id") % 2).alias("arm")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("class").agg((F.min("n") == F.max("n")).alias("equal"))


@query("h11_plan_violations", "SELECT l_returnflag AS p, count(CASE WHEN l_quantity < 1 OR l_quantity > 50 THEN 1 END) AS structure, count(CASE WHEN l_discount > 0.1 THEN 1 END) AS class, count(CASE WHEN l_shipdate < DATE '1992-01-05' THEN 1 END) AS split FROM lineitem GROUP BY 1")
def h11(spark: SparkSession, d: str) -> DataFrame:
    from trackworks.operators import gates

    li = table(spark, d, "lineitem", "l_returnflag", "l_quantity", "l_discount", "l_shipdate").withColumnRenamed("l_returnflag", "p")
    rules = {"structure": (F.col("l_quantity") < 1) | (F.col("l_quantity") > 50), "class": F.col("l_discount") > 0.1, "split": F.col("l_shipdate") < F.lit("1992-01-05").cast("date")}
    return gates.violations(li, ["p"], **rules)


@query("h12_density_uniformity", "WITH c AS (SELECT user_id % 4 AS n, count(*) k FROM events GROUP BY 1) SELECT n, k, abs(k / (SELECT avg(k) FROM c) - 1) < 0.2 AS uniform FROM c")
def h12(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events", "user_id").groupBy((F.col("user_id") % 4).alias("n")).agg(F.count(F.lit(1)).alias("k"))
    mean = c.agg(F.avg("k").alias("m"))
    return c.join(F.broadcast(mean)).select("n", "k", (F.abs(F.col("k") / F.col("m") - 1) < 0.2).alias("uniform"))  # one row


@query("h13_replay", "WITH h AS (SELECT user_id run, event_type class, count(*) n FROM events GROUP BY 1, 2), s AS (SELECT event_type class, count(DISTINCT user_id) songs FROM events GROUP BY 1) SELECT run, class, n, n = songs AS safe FROM h JOIN s USING (class)")
def h13(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "user_id", "event_type").select(F.col("user_id").alias("run"), F.col("event_type").alias("class"))
    songs = e.groupBy("class").agg(F.countDistinct("run").alias("songs"))
    return e.groupBy("run", "class").agg(F.count(F.lit(1)).alias("n")).join(songs, "class").select("run", "class", "n", (F.col("n") == F.col("songs")).alias("safe"))


@query("i12_audible_sets", "WITH l AS (SELECT user_id song, event_type c, max(value) m FROM events GROUP BY 1, 2) SELECT song, list(c ORDER BY c) AS audible FROM l WHERE (m > 60 OR (song = 3 AND c = 'click')) AND NOT (song = 5 AND c = 'purchase') GROUP BY 1")
def i12(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events", "user_id", "event_type", "value").groupBy(F.col("user_id").alias("song"), F.col("event_type").alias("c")).agg(F.max("value").alias("m"))
    sets = m.groupBy("song").agg(F.sort_array(F.collect_set(F.when(F.col("m") > 60, F.col("c")))).alias("a"), F.collect_set("c").alias("all"))
    with_ = F.when(F.col("song") == 3, F.array_union("a", F.array_intersect("all", F.array(F.lit("click"))))).otherwise(F.col("a"))
    out = F.when(F.col("song") == 5, F.array_except(with_, F.array(F.lit("purchase")))).otherwise(with_)
    return sets.select("song", F.array_sort(out).alias("audible")).filter(F.size("audible") > 0)


@query("i6_at_best_epoch", """WITH t AS (SELECT user_id % 5 AS run, dayofmonth(ts) AS epoch, event_type AS class, avg(value) score FROM events GROUP BY 1, 2, 3), o AS (SELECT run, epoch, round(avg(score), 6) v FROM t GROUP BY 1, 2), b AS (SELECT run, arg_max(epoch, (v, -epoch)) epoch FROM o GROUP BY 1)
SELECT class, round(max(CASE WHEN run = 0 THEN score END), 6) AS run_0, round(max(CASE WHEN run = 1 THEN score END), 6) AS run_1, round(max(CASE WHEN run = 2 THEN score END), 6) AS run_2 FROM t JOIN b USING (run, epoch) GROUP BY 1""")
def i6(spark: SparkSession, d: str) -> DataFrame:
    from trackworks.operators import runs

    e = table(spark, d, "events", "user_id", "ts", "event_type", "value").withColumns({"run": F.col("user_id") % 5, "epoch": F.dayofmonth("ts")})
    t = e.groupBy("run", "epoch", F.col("event_type").alias("class")).agg(F.avg("value").alias("score"))
    o = runs.trajectory(t, ["run"], "epoch", "class", "score", 1).withColumn("overall", F.round("overall", 6))
    b = runs.summary(o, "run", "epoch", "overall").select("run", F.col("best_epoch").alias("epoch"))
    j = t.join(b, ["run", "epoch"])
    return j.groupBy("class").agg(*[F.round(F.max(F.when(F.col("run") == r, F.col("score"))), 6).alias(f"run_{r}") for r in range(3)])


@query("i4_genre_trajectory", """WITH t AS (SELECT user_id % 3 AS genre, dayofmonth(ts) AS epoch, event_type AS class, value FROM events), k AS (SELECT genre, epoch, class, avg(value) m FROM t GROUP BY 1, 2, 3), b AS (SELECT genre, epoch, avg(m) m FROM k GROUP BY 1, 2)
SELECT t.genre, t.epoch::INTEGER AS epoch, round(avg(value), 6) AS pooled, round(any_value(b.m), 6) AS balanced FROM t JOIN b ON b.genre = t.genre AND b.epoch = t.epoch GROUP BY 1, 2""")
def i4(spark: SparkSession, d: str) -> DataFrame:
    from trackworks.operators import rollups

    e = table(spark, d, "events", "user_id", "ts", "event_type", "value").withColumns({"genre": F.col("user_id") % 3, "epoch": F.dayofmonth("ts")})
    return rollups.balanced_and_pooled(e, ["genre", "epoch"], "event_type", "value", "user_id").select("genre", "epoch", "pooled", "balanced")
