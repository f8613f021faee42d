"""Score-table queries: orders stand for score rows (run, song, class, score), customers for songs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackworks.operators import joins, rollups, sequences
from trackworks.operators.ranges import quantiles, with_medians
from trackworks.registry import registry
from trackworks.session import table

SCORES_SQL = """scores AS (SELECT o_orderstatus AS run, o_custkey AS song, o_orderpriority AS class, c_mktsegment AS genre,
  o_totalprice AS score, o_totalprice >= 50000 AS present FROM orders JOIN customer ON o_custkey = c_custkey)"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderstatus", "o_custkey", "o_orderpriority", "o_totalprice")
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderstatus").alias("run"), F.col("o_custkey").alias("song"), F.col("o_orderpriority").alias("class"),
        F.col("c_mktsegment").alias("genre"), F.col("o_totalprice").alias("score"), (F.col("o_totalprice") >= 50000).alias("present"),
    )


@registry.query("d12_genre_rollup", f"""WITH {SCORES_SQL}, k AS (SELECT genre, class, avg(score) m FROM scores WHERE present GROUP BY 1, 2)
SELECT s.genre, round(any_value(b.balanced), 6) AS balanced, round(avg(s.score), 6) AS pooled, count(*) AS n_pairs, count(DISTINCT s.song) AS n_songs
FROM scores s JOIN (SELECT genre, avg(m) balanced FROM k GROUP BY 1) b ON s.genre = b.genre WHERE present GROUP BY 1""")
def d12(spark: SparkSession, d: str) -> DataFrame:
    return rollups.balanced_and_pooled(scores(spark, d).filter("present"), ["genre"], "class", "score", "song")


query = registry.query
_P = f"WITH {SCORES_SQL}, p AS (SELECT * FROM scores WHERE present), cell AS (SELECT run, song, class, avg(score) score FROM p GROUP BY 1, 2, 3)"


def cells(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).filter("present").groupBy("run", "song", "class").agg(F.avg("score").alias("score"))


@query("d9_class_balanced", f"{_P} SELECT run, round(avg(m), 6) AS balanced FROM (SELECT run, class, avg(score) m FROM p GROUP BY 1, 2) GROUP BY 1")
def d9(spark: SparkSession, d: str) -> DataFrame:
    return rollups.balanced_and_pooled(scores(spark, d).filter("present"), ["run"], "class", "score", "song").select("run", "balanced")


@query("d10_pooled", f"{_P} SELECT run, round(avg(score), 6) AS pooled, count(*) AS n_pairs, count(DISTINCT song) AS n_songs FROM p GROUP BY 1")
def d10(spark: SparkSession, d: str) -> DataFrame:
    return rollups.balanced_and_pooled(scores(spark, d).filter("present"), ["run"], "class", "score", "song").drop("balanced")


@query("d11_per_class", f"{_P} SELECT class, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median, count(*) AS n FROM p GROUP BY 1")
def d11(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d).filter("present")
    return with_medians(s.groupBy("class").agg(F.round(F.avg("score"), 6).alias("mean"), F.count(F.lit(1)).alias("n")), s, ["class"], "score", digits=6)


@query("d13_absent_levels", f"WITH {SCORES_SQL} SELECT class, count(*) AS n, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median, max(score) AS most FROM scores WHERE NOT present GROUP BY 1")
def d13(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d).filter("not present")
    return with_medians(s.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.max("score").alias("most")), s, ["class"], "score", digits=6)


@query("d14_metrics_with_data", "SELECT metric FROM (SELECT 'o_totalprice' metric, count(o_totalprice) n FROM orders UNION ALL SELECT 'nothing', 0 UNION ALL SELECT 'o_custkey', count(o_custkey) FROM orders) WHERE n > 0")
def d14(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_totalprice", "o_custkey").withColumn("nothing", F.lit(None).cast("double"))
    one = o.agg(*[F.bool_or(F.col(c).isNotNull()).alias(c) for c in o.columns])
    return one.select(F.explode(F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in o.columns]), lambda x: x.isNotNull())).alias("metric"))


@query("c6_paired_runs", f"{_P} SELECT a.song, a.class, round(a.score, 6) AS value_a, round(b.score, 6) AS value_b, round(b.score - a.score, 6) AS delta FROM cell a JOIN cell b ON a.song = b.song AND a.class = b.class AND a.run = 'F' AND b.run = 'O'")
def c6(spark: SparkSession, d: str) -> DataFrame:
    x = joins.paired(cells(spark, d), ["song", "class"], "run", "score", "F", "O")
    return x.select("song", "class", *[F.round(c, 6).alias(c) for c in ("value_a", "value_b", "delta")])


@query("c7_status_mismatch", f"WITH {SCORES_SQL}, s AS (SELECT run, song, class, bool_or(present) p FROM scores GROUP BY 1, 2, 3) SELECT a.song, a.class, a.p AS present_a, b.p AS present_b FROM s a LEFT JOIN s b ON a.song = b.song AND a.class = b.class AND b.run = 'O' WHERE a.run = 'F' AND a.p IS DISTINCT FROM b.p")
def c7(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d).filter("run in ('F', 'O')").groupBy("song", "class").agg(F.bool_or(F.when(F.col("run") == "F", F.col("present"))).alias("present_a"), F.bool_or(F.when(F.col("run") == "O", F.col("present"))).alias("present_b"))
    return s.filter(F.col("present_a").isNotNull() & ~F.col("present_a").eqNullSafe(F.col("present_b")))


@query("e1_rank_in_group", f"""WITH {SCORES_SQL}, c AS (SELECT *, TRY_CAST(round(score * 100) AS BIGINT) cents FROM scores WHERE present),
cell AS (SELECT run, song, class, CASE WHEN count(cents) = count(*) THEN sum(cents)::DOUBLE / count(*) ELSE avg(score) * 100 END score FROM c GROUP BY 1, 2, 3)
SELECT run, song, class, row_number() OVER (PARTITION BY run ORDER BY score DESC, song, class) AS rank, count(*) OVER (PARTITION BY run) AS n FROM cell""")
def e1(spark: SparkSession, d: str) -> DataFrame:
    """Cells by their mean, then song and class. Scores are whole cents, added as such: sums of doubles depend on their order, and equal means would too."""
    w, n = Window.partitionBy("run"), F.count(F.lit(1))
    s = scores(spark, d).filter("present").withColumn("cents", F.round(F.col("score") * 100).try_cast("long"))
    mean = F.when(F.count("cents") == n, F.sum("cents").cast("double") / n).otherwise(F.avg("score") * 100)
    c = s.groupBy("run", "song", "class").agg(mean.alias("score"))
    return c.select("run", "song", "class", F.row_number().over(w.orderBy(F.col("score").desc(), "song", "class")).alias("rank"), n.over(w).alias("n"))


@query("e28_typical_song", f"{_P}, m AS (SELECT class, quantile_cont(score, 0.5) q FROM cell GROUP BY 1) SELECT class, run, song FROM cell JOIN m USING (class) QUALIFY row_number() OVER (PARTITION BY class ORDER BY abs(score - q), song, run) = 1")
def e28(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    m = quantiles(c, ["class"], "score", (0.5,)).select("class", F.get("q", F.lit(0)).alias("q"))
    return sequences.top_by(c.join(m, "class"), ["class"], [F.abs(F.col("score") - F.col("q")), "song", "run"]).select("class", "run", "song")


@query("d19_histogram", f"{_P}, h AS (SELECT run, least(floor((score - 50000) / 25000), 9)::INTEGER AS bin, count(*) n FROM p WHERE score BETWEEN 50000 AND 300000 GROUP BY 1, 2) SELECT run, bin, n, round(n / sum(n) OVER (PARTITION BY run), 6) AS share FROM h")
def d19(spark: SparkSession, d: str) -> DataFrame:
    return rollups.histogram(scores(spark, d).filter("present"), ["run"], "score", 50000.0, 300000.0, 10)


@query("d22_gaussian_fit", f"{_P} SELECT run, round(avg(score), 4) AS mx, round(avg(song), 4) AS my, round(var_samp(score / 1000), 4) AS vx, round(covar_samp(score / 1000, song / 1000.0), 6) AS cxy FROM p GROUP BY 1")
def d22(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d).filter("present").select("run", (F.col("score") / 1000).alias("x"), (F.col("song") / F.lit(1000.0)).alias("y"))
    g = rollups.gaussian_fit(s, ["run"], "x", "y")
    return g.select("run", F.round(F.col("mx") * 1000, 4).alias("mx"), F.round(F.col("my") * 1000, 4).alias("my"), F.round("vx", 4).alias("vx"), F.round("cxy", 6).alias("cxy"))


@query("d24_inside_ellipse", f"""{_P}, x AS (SELECT run, score / 1000 x, song / 1000.0 y FROM p), g AS (SELECT run, avg(x) mx, avg(y) my, var_samp(x) vx, var_samp(y) vy, covar_samp(x, y) c FROM x GROUP BY 1)
SELECT run, round(avg(CASE WHEN (vy * (x - mx) * (x - mx) - 2 * c * (x - mx) * (y - my) + vx * (y - my) * (y - my)) / (vx * vy - c * c) <= 2.0 THEN 1.0 ELSE 0 END), 6) AS inside FROM x JOIN g USING (run) GROUP BY 1""")
def d24(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d).filter("present").select("run", (F.col("score") / 1000).alias("x"), (F.col("song") / F.lit(1000.0)).alias("y"))
    j = s.join(rollups.gaussian_fit(s, ["run"], "x", "y"), "run")
    return j.groupBy("run").agg(F.round(F.avg(F.when(rollups.mahalanobis("x", "y") <= 2.0, 1.0).otherwise(0.0)), 6).alias("inside"))


@query("d23_density_ranking", f"""{_P}, x AS (SELECT run, song, class, score / 1000 x, song / 1000.0 y FROM cell), g AS (SELECT run, avg(x) mx, avg(y) my, var_samp(x) vx, var_samp(y) vy, covar_samp(x, y) c FROM x WHERE run IN ('F', 'O') GROUP BY 1),
l AS (SELECT x.*, g.run r, (-0.5 * ((vy * (x - mx) * (x - mx) - 2 * c * (x - mx) * (y - my) + vx * (y - my) * (y - my)) / (vx * vy - c * c)) - 0.5 * ln(vx * vy - c * c)) ll FROM x, g)
SELECT run, song, class, round(sum(CASE WHEN r = 'F' THEN ll ELSE -ll END), 6) AS log_odds FROM l WHERE run = 'P' GROUP BY 1, 2, 3""")
def d23(spark: SparkSession, d: str) -> DataFrame:
    s = cells(spark, d).select("run", "song", "class", (F.col("score") / 1000).alias("x"), (F.col("song") / F.lit(1000.0)).alias("y"))
    g = rollups.gaussian_fit(s.filter("run in ('F', 'O')"), ["run"], "x", "y").withColumnRenamed("run", "r")
    ll = -0.5 * rollups.mahalanobis("x", "y") - 0.5 * F.log(F.col("vx") * F.col("vy") - F.col("cxy") * F.col("cxy"))
    j = s.filter("run = 'P'").join(F.broadcast(g)).withColumn("ll", ll)  # two rows of parameters
    return j.groupBy("run", "song", "class").agg(F.round(F.sum(F.when(F.col("r") == "F", F.col("ll")).otherwise(-F.col("ll"))), 6).alias("log_odds"))


@query("h9_summary_crosscheck", f"{_P} SELECT run, class, abs(sum(score) / count(*) - avg(score)) < 1e-6 AS same FROM p GROUP BY 1, 2")
def h9(spark: SparkSession, d: str) -> DataFrame:
    p = scores(spark, d).filter("present")
    stored = p.groupBy("run", "class").agg(F.avg("score").alias("was"))
    again = p.groupBy("run", "class", "song").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n")).groupBy("run", "class").agg((F.sum("s") / F.sum("n")).alias("now"))
    return stored.join(again, ["run", "class"]).select("run", "class", (F.abs(F.col("was") - F.col("now")) < 1e-6).alias("same"))


@query("i7_arm_deltas", f"{_P}, k AS (SELECT class, run, avg(score) m FROM p GROUP BY 1, 2) SELECT class, round(max(CASE WHEN run = 'O' THEN m END) - max(CASE WHEN run = 'F' THEN m END), 6) AS o_minus_f, round(max(CASE WHEN run = 'P' THEN m END) - max(CASE WHEN run = 'F' THEN m END), 6) AS p_minus_f FROM k GROUP BY 1")
def i7(spark: SparkSession, d: str) -> DataFrame:
    m = {r: F.avg(F.when(F.col("run") == r, F.col("score"))) for r in "FOP"}
    return scores(spark, d).filter("present").groupBy("class").agg(F.round(m["O"] - m["F"], 6).alias("o_minus_f"), F.round(m["P"] - m["F"], 6).alias("p_minus_f"))


@query("i8_number_ledger", f"""{_P}, k AS (SELECT run, class, avg(score) m FROM p GROUP BY 1, 2), g AS (SELECT genre, avg(score) m FROM p GROUP BY 1)
SELECT 'best_class_' || run AS id, arg_max(class, m) AS printed, round(max(m), 2) AS value FROM k GROUP BY run UNION ALL SELECT 'worst_class_' || run, arg_min(class, m), round(min(m), 2) FROM k GROUP BY run
UNION ALL SELECT 'genre_order', string_agg(genre, ' > ' ORDER BY m DESC), round(max(m), 2) FROM g""")
def i8(spark: SparkSession, d: str) -> DataFrame:
    p = scores(spark, d).filter("present")
    k = p.groupBy("run", "class").agg(F.avg("score").alias("m"))
    best = k.groupBy("run").agg(F.max_by("class", "m").alias("printed"), F.round(F.max("m"), 2).alias("value")).select(F.concat(F.lit("best_class_"), "run").alias("id"), "printed", "value")
    worst = k.groupBy("run").agg(F.min_by("class", "m").alias("printed"), F.round(F.min("m"), 2).alias("value")).select(F.concat(F.lit("worst_class_"), "run").alias("id"), "printed", "value")
    g = p.groupBy("genre").agg(F.avg("score").alias("m"))
    order = g.agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("m", "genre")))), lambda x: x["genre"]), " > ").alias("printed"), F.round(F.max("m"), 2).alias("value")).select(F.lit("genre_order").alias("id"), "printed", "value")
    return best.unionByName(worst).unionByName(order)


@query("i9_inputs", f"WITH {SCORES_SQL} SELECT run, count(*) AS n_rows, min(genre) AS first_genre, count(DISTINCT genre) = 1 AS one_genre FROM scores GROUP BY 1")
def i9(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).groupBy("run").agg(F.count(F.lit(1)).alias("n_rows"), F.min("genre").alias("first_genre"), (F.min("genre") == F.max("genre")).alias("one_genre"))


@query("i11_score_card", f"{_P} SELECT song, round(avg(score), 6) AS score, count(DISTINCT class) AS n_classes FROM p GROUP BY 1")
def i11(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).filter("present").groupBy("song").agg(F.round(F.avg("score"), 6).alias("score"), F.countDistinct("class").alias("n_classes"))


@query("i13_genre_class_stats", f"{_P} SELECT genre, class, round(avg(b), 6) AS mean_best, round(quantile_cont(b, 0.5), 6) AS median_best, count(*) AS n FROM (SELECT genre, class, song, max(score) b FROM p GROUP BY 1, 2, 3) GROUP BY 1, 2")
def i13(spark: SparkSession, d: str) -> DataFrame:
    b = scores(spark, d).filter("present").groupBy("genre", "class", "song").agg(F.max("score").alias("b"))
    g = b.groupBy("genre", "class").agg(F.round(F.avg("b"), 6).alias("mean_best"), F.count(F.lit(1)).alias("n"))
    return with_medians(g, b, ["genre", "class"], "b", "median_best", digits=6)


@query("h15_frozen_picks", """SELECT o_orderkey AS pick, CASE WHEN o_orderkey % 2 = 0 THEN 'song' ELSE 'order' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN c_name ELSE o_orderstatus END AS label FROM orders JOIN customer ON o_custkey = c_custkey""")
def h15(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus"), table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    j = joins.validated_left(o, c, "o_custkey")
    kind = F.when(F.col("o_orderkey") % 2 == 0, "song").otherwise("order")
    return j.select(F.col("o_orderkey").alias("pick"), kind.alias("kind"), F.when(kind == "song", F.col("c_name")).otherwise(F.col("o_orderstatus")).alias("label"))
