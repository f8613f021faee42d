"""Duration queries: documents are clips (lang: dataset, source: class, n_chars: duration); lineitem rows are stems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackworks.operators import rollups as R
from trackworks.operators import sequences as S
from trackworks.operators.ranges import with_medians, with_quantiles
from trackworks.registry import registry
from trackworks.session import table

query = registry.query


def clips(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "lang", "source", "n_chars")


@query("d1_value_counts", "SELECT l_tax, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 8")
def d1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem", "l_tax", "l_returnflag").groupBy("l_tax", "l_returnflag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "l_tax", "l_returnflag").limit(8)


@query("d2_distinct_songs", "SELECT o_orderstatus AS split, count(DISTINCT o_custkey) AS n_songs FROM orders GROUP BY 1")
def d2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", "o_orderstatus", "o_custkey").groupBy(F.col("o_orderstatus").alias("split")).agg(F.countDistinct("o_custkey").alias("n_songs"))


@query("d3_crosstab", """WITH c AS (SELECT lang, source FROM documents) SELECT coalesce(source, 'all') AS source, count(CASE WHEN lang = 'de' THEN 1 END) AS de, count(CASE WHEN lang = 'en' THEN 1 END) AS en, count(CASE WHEN lang = 'es' THEN 1 END) AS es, count(CASE WHEN lang = 'fr' THEN 1 END) AS fr, count(*) AS "all" FROM c GROUP BY ROLLUP (source)""")
def d3(spark: SparkSession, d: str) -> DataFrame:
    return R.crosstab(clips(spark, d), "source", "lang", ["de", "en", "es", "fr"])


@query("d4_pivot_hours", "SELECT l_tax, count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS \"A\", count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS \"N\", count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS \"R\", round(sum(l_quantity) / 3600, 6) AS hours FROM lineitem GROUP BY 1")
def d4(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_tax", "l_returnflag", "l_quantity")
    return li.groupBy("l_tax").agg(*[F.count_if(F.col("l_returnflag") == v).alias(v) for v in "ANR"], F.round(F.sum("l_quantity") / 3600, 6).alias("hours"))


@query("d5_wide_ratio", "SELECT source, count(CASE WHEN lang = 'en' THEN 1 END) AS n_en, count(CASE WHEN lang = 'de' THEN 1 END) AS n_de, sum(CASE WHEN lang = 'en' THEN n_chars ELSE 0 END)::BIGINT AS sum_en, round(count(CASE WHEN lang = 'en' THEN 1 END) / nullif(count(CASE WHEN lang = 'de' THEN 1 END), 0), 6) AS ratio FROM documents GROUP BY 1")
def d5(spark: SparkSession, d: str) -> DataFrame:
    g = clips(spark, d).groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("n_en"), F.count_if(F.col("lang") == "de").alias("n_de"), F.sum(F.when(F.col("lang") == "en", F.col("n_chars")).otherwise(0)).alias("sum_en"))
    return g.withColumn("ratio", F.round(F.try_divide("n_en", "n_de"), 6))


@query("d6_pool_summary", "SELECT lang, count(n_chars) AS n, round(sum(n_chars) / 3600, 6) AS hours, round(avg(n_chars), 6) AS mean, " + ", ".join(f"round(quantile_cont(n_chars, {p}), 6) AS p{round(100 * p)}" for p in (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)) + " FROM documents GROUP BY 1")
def d6(spark: SparkSession, d: str) -> DataFrame:
    return R.pool_summary(clips(spark, d), ["lang"], "n_chars")


@query("d7_below_thresholds", "SELECT lang, t AS threshold, count(CASE WHEN n_chars < t THEN 1 END) AS n_below, round(count(CASE WHEN n_chars < t THEN 1 END) / count(*), 6) AS share, round(sum(CASE WHEN n_chars < t THEN n_chars ELSE 0 END) / sum(n_chars), 6) AS sum_share FROM documents, (VALUES (300), (1000), (3000)) v(t) GROUP BY 1, 2")
def d7(spark: SparkSession, d: str) -> DataFrame:
    return R.below_thresholds(clips(spark, d), ["lang"], "n_chars", [300, 1000, 3000])


@query("d8_loss_at_cut", "SELECT source, count(CASE WHEN n_chars < 800 THEN 1 END) AS lost, round(sum(CASE WHEN n_chars >= 800 THEN n_chars ELSE 0 END) / 3600, 6) AS hours_kept, round(quantile_cont(n_chars, 0.5), 6) AS median FROM documents GROUP BY 1")
def d8(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    g = clips(spark, d).groupBy("source").agg(F.count_if(n < 800).alias("lost"), F.round(F.sum(F.when(n >= 800, n).otherwise(0)) / 3600, 6).alias("hours_kept"))
    return with_medians(g, clips(spark, d), ["source"], n, digits=6)


@query("d17_weighted_average", "SELECT l_tax, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS weighted FROM lineitem GROUP BY 1")
def d17(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem", "l_tax", "l_quantity", "l_discount").groupBy("l_tax").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity"), 6).alias("weighted"))


@query("d18_frame_ratio", "WITH s AS (SELECT l_returnflag AS pool, l_orderkey song, sum(CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0 END) h, sum(l_quantity) f FROM lineitem GROUP BY 1, 2) SELECT pool, round(sum(h) / sum(f), 6) AS frame_ratio, round(avg(h / f), 6) AS song_ratio FROM s GROUP BY 1")
def d18(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_returnflag", "l_orderkey", "l_discount", "l_quantity")
    s = li.groupBy(F.col("l_returnflag").alias("pool"), "l_orderkey").agg(F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).otherwise(0.0)).alias("h"), F.sum("l_quantity").alias("f"))
    return s.groupBy("pool").agg(F.round(F.sum("h") / F.sum("f"), 6).alias("frame_ratio"), F.round(F.avg(F.col("h") / F.col("f")), 6).alias("song_ratio"))


@query("d20_window_loudness", "SELECT event_type AS pool, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(avg(value) - 50, 6) AS shift, round(avg(CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 0 END), 6) AS mono_share FROM events GROUP BY 1")
def d20(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_type", "value", "user_id").groupBy(F.col("event_type").alias("pool")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.round(F.avg("value") - 50, 6).alias("shift"), F.round(F.avg(F.when(F.col("user_id") % 2 == 0, 1.0).otherwise(0.0)), 6).alias("mono_share")
    )


@query("d21_qc_digest", "SELECT c_mktsegment AS dataset, count(*) AS n, round(sum(c_acctbal) / 3600, 6) AS hours, min(c_acctbal) AS least, round(quantile_cont(c_acctbal, 0.5), 6) AS median, max(c_acctbal) AS most, count(CASE WHEN c_acctbal < 0 THEN 1 END) AS dead, count(CASE WHEN c_acctbal > 9000 THEN 1 END) AS clipped, count(DISTINCT c_nationkey) AS n_formats FROM customer GROUP BY 1")
def d21(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("c_acctbal")
    c = table(spark, d, "customer", "c_mktsegment", "c_acctbal", "c_nationkey").withColumnRenamed("c_mktsegment", "dataset")
    g = c.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(b) / 3600, 6).alias("hours"), F.min(b).alias("least"), F.max(b).alias("most"),
        F.count_if(b < 0).alias("dead"), F.count_if(b > 9000).alias("clipped"), F.countDistinct("c_nationkey").alias("n_formats"),
    )
    return with_medians(g, c, ["dataset"], b, digits=6)


_KS = """WITH e AS (SELECT event_type k, value v FROM events WHERE event_type IN ('click', 'purchase')), c AS (SELECT v, count(CASE WHEN k = 'click' THEN 1 END) a, count(CASE WHEN k = 'purchase' THEN 1 END) b FROM e GROUP BY 1),
s AS (SELECT sum(a) OVER w / sum(a) OVER () - sum(b) OVER w / sum(b) OVER () dd FROM c WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)) SELECT round(max(abs(dd)), 6) AS d, (SELECT count(*) FROM e WHERE k = 'click') AS n_a, (SELECT count(*) FROM e WHERE k = 'purchase') AS n_b FROM s"""


@query("d25_ks_two_sample", _KS)
def d25(spark: SparkSession, d: str) -> DataFrame:
    return R.ks_statistic(table(spark, d, "events", "event_type", "value"), "event_type", "click", "purchase", "value").select(F.round("d", 6).alias("d"), "n_a", "n_b")


@query("d26_outlier_fence", "WITH q AS (SELECT lang, quantile_cont(n_chars, 0.75) + 1.5 * (quantile_cont(n_chars, 0.75) - quantile_cont(n_chars, 0.25)) fence FROM documents GROUP BY 1) SELECT doc_id, lang, n_chars, round(fence, 6) AS fence FROM documents JOIN q USING (lang) WHERE n_chars > fence")
def d26(spark: SparkSession, d: str) -> DataFrame:
    return R.outliers(clips(spark, d).drop("source"), ["lang"], "n_chars").withColumn("fence", F.round("fence", 6))


@query("d27_duplicate_fingerprints", "SELECT md5(text) AS fingerprint, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def d27(spark: SparkSession, d: str) -> DataFrame:
    return R.duplicate_keys(table(spark, d, "documents", "text").select(F.md5("text").alias("fingerprint")), ["fingerprint"])


@query("d28_n_smallest", "SELECT lang, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) <= 4")
def d28(spark: SparkSession, d: str) -> DataFrame:
    return S.top_by(clips(spark, d), ["lang"], ["n_chars", "doc_id"], 4).drop("source")


@query("d29_class_sets", "WITH k AS (SELECT l_orderkey song, l_tax c, count(*) n FROM lineitem GROUP BY 1, 2), t AS (SELECT song, sum(n) t FROM k GROUP BY 1) SELECT song, list(c ORDER BY c) AS classes, list(c ORDER BY c) FILTER (WHERE n >= 0.25 * t) AS frequent FROM k JOIN t USING (song) GROUP BY 1")
def d29(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "lineitem", "l_orderkey", "l_tax").groupBy(F.col("l_orderkey").alias("song"), F.col("l_tax").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    g = k.groupBy("song").agg(F.array_sort(F.collect_list(F.struct("c", "n"))).alias("x"), F.sum("n").alias("t"))
    often = F.transform(F.filter("x", lambda e: e["n"] >= 0.25 * F.col("t")), lambda e: e["c"])
    return g.select("song", F.transform("x", lambda e: e["c"]).alias("classes"), F.when(F.size(often) > 0, often).alias("frequent"))


@query("d32_pair_share", "WITH k AS (SELECT l_orderkey song, l_tax c, count(*) n FROM lineitem GROUP BY 1, 2), h AS (SELECT song, sum(n * (n - 1) / 2) / (sum(n) * (sum(n) - 1) / 2) h FROM k GROUP BY 1 HAVING sum(n) > 1) SELECT round(quantile_cont(h, 0.1), 6) AS p10, round(quantile_cont(h, 0.5), 6) AS p50, round(quantile_cont(h, 0.9), 6) AS p90, round(avg(CASE WHEN h = 0 THEN 1.0 ELSE 0 END), 6) AS zero_share, round(avg(CASE WHEN h = 1 THEN 1.0 ELSE 0 END), 6) AS one_share FROM h")
def d32(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "lineitem", "l_orderkey", "l_tax").groupBy("l_orderkey", "l_tax").agg(F.count(F.lit(1)).alias("n"))
    n, total = F.col("n"), F.sum("n")
    h = k.groupBy("l_orderkey").agg((F.sum(n * (n - 1) / 2) / F.nullif(total * (total - 1) / 2, F.lit(0.0))).alias("h")).filter("h is not null")
    g = h.agg(F.round(F.avg((F.col("h") == 0).cast("double")), 6).alias("zero_share"), F.round(F.avg((F.col("h") == 1).cast("double")), 6).alias("one_share"))
    g = with_quantiles(g, h, [], "h", (0.1, 0.5, 0.9), "p")
    return g.select(*[F.round(F.get("p", F.lit(i)), 6).alias(c) for i, c in enumerate(("p10", "p50", "p90"))], "zero_share", "one_share")


@query("d33_group_sizes", "WITH g AS (SELECT l_orderkey, l_returnflag AS genre, count(*) AS size FROM lineitem GROUP BY 1, 2), c AS (SELECT genre, size, count(*) n FROM g GROUP BY 1, 2) SELECT genre, size, n, round(n / sum(n) OVER (PARTITION BY genre), 6) AS share FROM c")
def d33(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem", "l_orderkey", "l_returnflag").groupBy("l_orderkey", F.col("l_returnflag").alias("genre")).agg(F.count(F.lit(1)).alias("size"))
    c = g.groupBy("genre", "size").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("genre")), 6))


@query("d34_preference_tally", "SELECT event_type AS item, count(*) AS n, count(CASE WHEN value > 50 THEN 1 END) AS prefers_b, count(CASE WHEN value > 50 AND user_id % 3 = 0 THEN 1 END) AS prefers_b_blind FROM events GROUP BY 1")
def d34(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("value") > 50
    return table(spark, d, "events", "event_type", "value", "user_id").groupBy(F.col("event_type").alias("item")).agg(F.count(F.lit(1)).alias("n"), F.count_if(b).alias("prefers_b"), F.count_if(b & (F.col("user_id") % 3 == 0)).alias("prefers_b_blind"))


@query("d36_group_members", "WITH k AS (SELECT p_brand, l_returnflag f, count(*) n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT p_brand, sum(n)::BIGINT AS total, string_agg(f || ':' || n, ', ' ORDER BY n DESC, f) AS members FROM k GROUP BY 1")
def d36(spark: SparkSession, d: str) -> DataFrame:
    li, p = table(spark, d, "lineitem", "l_partkey", "l_returnflag"), table(spark, d, "part", "p_partkey", "p_brand")
    k = li.join(p, li.l_partkey == p.p_partkey).groupBy("p_brand", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    g = k.groupBy("p_brand").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("l_returnflag").alias("f"), "n"))).alias("x"))
    return g.select("p_brand", "total", F.array_join(F.transform("x", lambda e: F.concat(e["f"], F.lit(":"), e["n"].cast("string"))), ", ").alias("members"))


@query("d37_multi_part_groups", "WITH g AS (SELECT l_orderkey song, l_tax c, count(DISTINCT l_partkey) parts FROM lineitem GROUP BY 1, 2) SELECT c AS class, count(*) AS n_songs, count(CASE WHEN parts > 1 THEN 1 END) AS multi FROM g GROUP BY 1")
def d37(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem", "l_orderkey", "l_tax", "l_partkey").groupBy("l_orderkey", F.col("l_tax").alias("class")).agg(F.countDistinct("l_partkey").alias("parts"))
    return g.groupBy("class").agg(F.count(F.lit(1)).alias("n_songs"), F.count_if(F.col("parts") > 1).alias("multi"))


_T = "t AS (SELECT user_id AS run, dayofmonth(ts) AS epoch, event_type AS class, avg(value) AS score FROM events GROUP BY 1, 2, 3)"


def history(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "user_id", "ts", "event_type", "value")
    return e.groupBy(F.col("user_id").alias("run"), F.dayofmonth("ts").alias("epoch"), F.col("event_type").alias("class")).agg(F.avg("value").alias("score"))


@query("i1_trajectory", f"WITH {_T} SELECT run, epoch, round(avg(score), 6) AS overall, ((epoch + 1) * 1000)::INTEGER AS step FROM t GROUP BY 1, 2")
def i1(spark: SparkSession, d: str) -> DataFrame:
    from trackworks.operators import runs

    return runs.trajectory(history(spark, d), ["run"], "epoch", "class", "score", 1000).withColumn("overall", F.round("overall", 6))


@query("i5_run_summary", f"WITH {_T}, o AS (SELECT run, epoch, round(avg(score), 6) v FROM t GROUP BY 1, 2) SELECT run, arg_max(epoch, (v, -epoch)) AS best_epoch, max(v) AS best, max(epoch) AS last_epoch, arg_max(v, epoch) AS last, count(*) AS n_evals FROM o GROUP BY 1")
def i5(spark: SparkSession, d: str) -> DataFrame:
    from trackworks.operators import runs

    return runs.summary(i1(spark, d), "run", "epoch", "overall")


@query("e26_latest_delta", f"WITH {_T}, o AS (SELECT run, epoch, round(avg(score), 6) v FROM t GROUP BY 1, 2), x AS (SELECT *, v - lag(v) OVER (PARTITION BY run ORDER BY epoch) dl, max(v) OVER (PARTITION BY run) b FROM o) SELECT run, epoch, v AS overall, round(dl, 6) AS delta, round(b - v, 6) AS below_best FROM x QUALIFY row_number() OVER (PARTITION BY run ORDER BY epoch DESC) = 1")
def e26(spark: SparkSession, d: str) -> DataFrame:
    from trackworks.operators import runs

    x = runs.latest_delta(i1(spark, d), "run", "epoch", "overall")
    return x.withColumns({c: F.round(c, 6) for c in ("delta", "below_best")})


@query("e27_head_drop", f"WITH {_T}, x AS (SELECT run, class, score, max(score) OVER (PARTITION BY run, class) b, row_number() OVER (PARTITION BY run, class ORDER BY epoch DESC) r FROM t) SELECT run, class, round(b - score, 6) AS below FROM x WHERE r = 1 AND b - score > 30")
def e27(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("run", "class")
    x = history(spark, d).withColumns({"b": F.max("score").over(w), "r": F.row_number().over(w.orderBy(F.col("epoch").desc()))})
    return x.filter("r = 1 and b - score > 30").select("run", "class", F.round(F.col("b") - F.col("score"), 6).alias("below"))


@query("c8_aligned_arms", f"WITH {_T}, s AS (SELECT epoch, run % 3 AS arm, avg(score) v FROM t WHERE epoch > 2 GROUP BY 1, 2) SELECT epoch, round(max(CASE WHEN arm = 0 THEN v END), 6) AS arm_0, round(max(CASE WHEN arm = 1 THEN v END), 6) AS arm_1, round(max(CASE WHEN arm = 2 THEN v END), 6) AS arm_2 FROM s GROUP BY 1 HAVING count(*) = 3")
def c8(spark: SparkSession, d: str) -> DataFrame:
    from trackworks.operators import runs

    x = runs.aligned(history(spark, d).withColumn("arm", F.col("run") % 3), "arm", "epoch", "score", [0, 1, 2], 2)
    return x.select("epoch", *[F.round(f"arm_{a}", 6).alias(f"arm_{a}") for a in range(3)])


@query("i2_gap_verdict", f"""WITH {_T}, s AS (SELECT class, epoch, run % 2 AS arm, avg(score) v FROM t GROUP BY 1, 2, 3), a AS (SELECT class, epoch, max(CASE WHEN arm = 1 THEN v END) - max(CASE WHEN arm = 0 THEN v END) g FROM s GROUP BY 1, 2),
w AS (SELECT class, avg(dv) sw FROM (SELECT class, abs(v - lag(v) OVER (PARTITION BY class, arm ORDER BY epoch)) dv FROM s) GROUP BY 1), m AS (SELECT class, avg(g) g FROM a GROUP BY 1)
SELECT class, round(g, 6) AS gap, round(sw, 6) AS swing, CASE WHEN abs(g) / sw >= 2 THEN 'clear' WHEN abs(g) / sw >= 1 THEN 'close' ELSE 'noise' END AS verdict FROM m JOIN w USING (class)""")
def i2(spark: SparkSession, d: str) -> DataFrame:
    from trackworks.operators import runs

    s = history(spark, d).groupBy("class", "epoch", (F.col("run") % 2).alias("arm")).agg(F.avg("score").alias("v"))
    gap = s.groupBy("class", "epoch").agg((F.max(F.when(F.col("arm") == 1, F.col("v"))) - F.max(F.when(F.col("arm") == 0, F.col("v")))).alias("g")).groupBy("class").agg(F.avg("g").alias("gap"))
    step = s.withColumn("dv", F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("class", "arm").orderBy("epoch")))).groupBy("class").agg(F.avg("dv").alias("swing"))
    j = gap.join(step, "class").withColumn("verdict", runs.gap_verdict(F.col("gap"), F.col("swing")))
    return j.withColumns({c: F.round(c, 6) for c in ("gap", "swing")})


@query("i3_longest_history", f"WITH {_T}, n AS (SELECT run % 10 AS line, run, count(DISTINCT epoch) n FROM t GROUP BY 1, 2) SELECT line, run, n AS n_epochs FROM n QUALIFY row_number() OVER (PARTITION BY line ORDER BY n DESC, run) = 1")
def i3(spark: SparkSession, d: str) -> DataFrame:
    n = history(spark, d).groupBy((F.col("run") % 10).alias("line"), "run").agg(F.countDistinct("epoch").alias("n_epochs"))
    return S.top_by(n, ["line"], [F.col("n_epochs").desc(), "run"])


@query("i3_cut_histories", f"WITH {_T}, n AS (SELECT run % 10 AS line, run, count(DISTINCT epoch) n, max(epoch) m FROM t GROUP BY 1, 2), l AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY line ORDER BY n DESC, run) = 1) SELECT run, epoch::INTEGER AS epoch, class, round(score, 6) AS score FROM t JOIN l USING (run) WHERE epoch <= (SELECT min(m) FROM l)")
def i3_cut(spark: SparkSession, d: str) -> DataFrame:
    t = history(spark, d)
    n = t.groupBy((F.col("run") % 10).alias("line"), "run").agg(F.countDistinct("epoch").alias("n"), F.max("epoch").alias("m"))
    longest = S.top_by(n, ["line"], [F.col("n").desc(), "run"])
    last = longest.agg(F.min("m").alias("cut"))
    j = t.join(longest.select("run"), "run").join(F.broadcast(last)).filter("epoch <= cut")  # one row
    return j.select("run", "epoch", "class", F.round("score", 6).alias("score"))
