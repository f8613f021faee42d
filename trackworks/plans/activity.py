"""Activity queries: events stand for level blocks; a user is a file, rows in time order are its blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackworks.operators import columns as C
from trackworks.operators import joins, sampling
from trackworks.operators import sequences as S
from trackworks.operators.ranges import quantiles, with_medians
from trackworks.registry import registry
from trackworks.session import table

query = registry.query

#: Levels that open and close a segment, and lengths in blocks.
OPEN, CLOSE, GAP, LEAST, TAIL = 60.0, 20.0, 3, 2, 1

B = "b AS (SELECT user_id AS file_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value AS level, event_type AS class, ts, event_id FROM events)"
RUNS = f"r AS (SELECT file_id, min(idx) s, max(idx) + 1 e, bool_or(level >= {OPEN}) o FROM (SELECT *, idx - row_number() OVER (PARTITION BY file_id ORDER BY idx) g FROM b WHERE level > {CLOSE}) GROUP BY file_id, g)"
HYST = f"{B}, {RUNS}, h AS (SELECT file_id, s, e FROM r WHERE o)"
BRIDGED = f"""{HYST}, g1 AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY file_id ORDER BY s) < {GAP} THEN 0 ELSE 1 END n FROM h),
g2 AS (SELECT *, sum(n) OVER (PARTITION BY file_id ORDER BY s ROWS UNBOUNDED PRECEDING) k FROM g1), br AS (SELECT file_id, min(s) s, max(e) e FROM g2 GROUP BY file_id, k)"""
LONG = f"{BRIDGED}, lg AS (SELECT * FROM br WHERE e - s >= {LEAST})"
SEGS = f"""{LONG}, nb AS (SELECT file_id, max(idx) + 1 n FROM b GROUP BY 1), t1 AS (SELECT file_id, s, least(e + {TAIL}, n) e FROM lg JOIN nb USING (file_id)),
t2 AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY file_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END n FROM t1),
t3 AS (SELECT *, sum(n) OVER (PARTITION BY file_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) k FROM t2), sg AS (SELECT file_id, min(s) s, max(e) e FROM t3 GROUP BY file_id, k)"""


def blocks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("file_id"), (F.row_number().over(w) - 1).cast("long").alias("idx"), F.col("value").alias("level"), F.col("event_type").alias("class"), "ts", "event_id")


def segs(spark: SparkSession, d: str) -> DataFrame:
    return S.segments(blocks(spark, d), "file_id", "idx", "level", OPEN, CLOSE, GAP, LEAST, TAIL)


@query("e2_runs", f"WITH {B}, {RUNS} SELECT file_id, s AS start, e AS \"end\" FROM r")
def e2(spark: SparkSession, d: str) -> DataFrame:
    return S.runs(blocks(spark, d), "file_id", "idx", F.col("level") > CLOSE)


@query("e3_hysteresis", f"WITH {HYST} SELECT file_id, s AS start, e AS \"end\" FROM h")
def e3(spark: SparkSession, d: str) -> DataFrame:
    return S.hysteresis_segments(blocks(spark, d), "file_id", "idx", "level", OPEN, CLOSE)


@query("e4_bridged", f"WITH {BRIDGED} SELECT file_id, s AS start, e AS \"end\" FROM br")
def e4(spark: SparkSession, d: str) -> DataFrame:
    return S.bridged(e3(spark, d), "file_id", GAP)


@query("e5_least_length", f"WITH {LONG} SELECT file_id, s AS start, e AS \"end\" FROM lg")
def e5(spark: SparkSession, d: str) -> DataFrame:
    return e4(spark, d).filter(F.col("end") - F.col("start") >= LEAST)


@query("e6_tails", f"WITH {SEGS} SELECT file_id, s AS start, e AS \"end\" FROM sg")
def e6(spark: SparkSession, d: str) -> DataFrame:
    return segs(spark, d)


SPANS = "sp AS (SELECT user_id AS file_id, date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts)) AS s, date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts)) + 3600 * (1 + event_id % 5) AS e, event_type AS class FROM events)"


def spans(spark: SparkSession, d: str) -> DataFrame:
    s = F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp")))
    return table(spark, d, "events", "user_id", "ts", "event_id", "event_type").select(F.col("user_id").alias("file_id"), s.alias("start"), (s + 3600 * (1 + F.col("event_id") % 5)).alias("end"), F.col("event_type").alias("class"))


_MERGE = """m1 AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY {k} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END n FROM sp),
m2 AS (SELECT *, sum(n) OVER (PARTITION BY {k} ORDER BY s, e ROWS UNBOUNDED PRECEDING) q FROM m1), mg AS (SELECT {k}, min(s) s, max(e) e FROM m2 GROUP BY {k}, q)"""


@query("e7_merged_spans", f"WITH {SPANS}, {_MERGE.format(k='file_id')} SELECT file_id, s AS start, e AS \"end\" FROM mg")
def e7(spark: SparkSession, d: str) -> DataFrame:
    return S.merged(spans(spark, d), "file_id")


@query("e8_segment_rows", f"""WITH {SEGS} SELECT sg.file_id, s AS start, e AS "end", row_number() OVER (PARTITION BY sg.file_id ORDER BY s) - 1 AS seg_idx, round(avg(level), 6) AS mean_level, max(level) AS peak_level
FROM sg JOIN b ON b.file_id = sg.file_id AND idx >= s AND idx < e GROUP BY sg.file_id, s, e""")
def e8(spark: SparkSession, d: str) -> DataFrame:
    return S.segment_rows(segs(spark, d), blocks(spark, d), "file_id", "idx", "level").withColumn("mean_level", F.round("mean_level", 6))


@query("e9_rests", f"""WITH {SEGS} SELECT * FROM (SELECT file_id, e AS start, lead(s) OVER (PARTITION BY file_id ORDER BY s) AS "end", lead(s) OVER (PARTITION BY file_id ORDER BY s) - e AS gap FROM sg) WHERE "end" IS NOT NULL""")
def e9(spark: SparkSession, d: str) -> DataFrame:
    return S.rests(segs(spark, d), "file_id")


@query("e10_window_coverage", f"""WITH {B}, a AS (SELECT file_id, class, idx, bool_or(level > {CLOSE}) act FROM b GROUP BY 1, 2, 3), l AS (SELECT unnest([4, 8]) win)
SELECT file_id, class, win, idx // win AS window_idx, round(avg(act::INTEGER), 6) AS cov, count(CASE WHEN act THEN 1 END) AS n_active FROM a, l GROUP BY 1, 2, 3, 4""")
def e10(spark: SparkSession, d: str) -> DataFrame:
    a = blocks(spark, d).groupBy("file_id", "class", "idx").agg(F.bool_or(F.col("level") > CLOSE).alias("act"))
    x = a.withColumn("win", F.explode(F.array(F.lit(4), F.lit(8)))).withColumn("window_idx", F.floor(F.col("idx") / F.col("win")))
    return x.groupBy("file_id", "class", "win", "window_idx").agg(F.round(F.avg(F.col("act").cast("int")), 6).alias("cov"), F.count_if("act").alias("n_active"))


@query("e11_mean_step", f"WITH {B} SELECT file_id, round(avg(dv), 6) AS mean_step FROM (SELECT file_id, abs(level - lag(level) OVER (PARTITION BY file_id ORDER BY idx)) dv FROM b) GROUP BY 1")
def e11(spark: SparkSession, d: str) -> DataFrame:
    return S.mean_step(blocks(spark, d), "file_id", "idx", "level").withColumn("mean_step", F.round("mean_step", 6))


@query("e12_trailing", f"WITH {B} SELECT file_id, idx, level FROM b QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY idx DESC) <= 5")
def e12(spark: SparkSession, d: str) -> DataFrame:
    return S.top_by(blocks(spark, d), ["file_id"], [F.col("idx").desc()], 5).select("file_id", "idx", "level")


@query("e13_sliding_mean", f"WITH {B} SELECT * FROM (SELECT file_id, idx AS start, round(avg(level) OVER w, 6) AS mean_level, count(*) OVER w n FROM b WINDOW w AS (PARTITION BY file_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE n = 8".replace("SELECT * FROM", "SELECT file_id, start, mean_level FROM"))
def e13(spark: SparkSession, d: str) -> DataFrame:
    return S.sliding(blocks(spark, d), "file_id", "idx", 8, mean_level=lambda w: F.round(F.avg("level").over(w), 6))


_SL = "sl AS (SELECT file_id, start, v FROM (SELECT file_id, idx AS start, {} OVER w v, count(*) OVER w n FROM b WINDOW w AS (PARTITION BY file_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE n = 8)"


@query("e14_densest_excerpt", f"WITH {B}, {_SL.format(f'count(CASE WHEN level > {CLOSE} THEN 1 END)')} SELECT file_id, arg_max(start, v * 1000000 - start) AS densest, max(v) AS most, arg_min(start, v * 1000000 + start) AS sparsest, min(v) AS least FROM sl GROUP BY 1")
def e14(spark: SparkSession, d: str) -> DataFrame:
    s = S.sliding(blocks(spark, d), "file_id", "idx", 8, v=lambda w: F.count_if(F.col("level") > CLOSE).over(w))
    return s.groupBy("file_id").agg(F.max_by("start", F.struct("v", -F.col("start"))).alias("densest"), F.max("v").alias("most"), F.min_by("start", F.struct("v", "start")).alias("sparsest"), F.min("v").alias("least"))


@query("e15_typical_window", f"""WITH {B}, {_SL.format(f'count(CASE WHEN level > {CLOSE} THEN 1 END)')}, md AS (SELECT file_id, quantile_cont(v, 0.5) m FROM sl GROUP BY 1)
SELECT file_id, start, v AS n_active FROM sl JOIN md USING (file_id) QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY abs(v - m), start) = 1""")
def e15(spark: SparkSession, d: str) -> DataFrame:
    s = S.sliding(blocks(spark, d), "file_id", "idx", 8, n_active=lambda w: F.count_if(F.col("level") > CLOSE).over(w))
    m = quantiles(s, ["file_id"], "n_active", (0.5,)).select("file_id", F.get("q", F.lit(0)).alias("m"))
    return S.top_by(s.join(m, "file_id"), ["file_id"], [F.abs(F.col("n_active") - F.col("m")), "start"]).drop("m")


@query("e16_candidate_windows", f"""WITH {B} SELECT file_id, start, mean_level, least, sd, dead, share FROM (SELECT file_id, idx AS start, round(avg(level) OVER w, 6) AS mean_level, min(level) OVER w AS least, round(stddev_pop(level) OVER w, 6) AS sd,
  count(CASE WHEN level <= {CLOSE} THEN 1 END) OVER w = 8 AS dead, round(avg(CASE WHEN level > {CLOSE} THEN 1.0 ELSE 0 END) OVER w, 6) AS share, count(*) OVER w n FROM b WINDOW w AS (PARTITION BY file_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE n = 8 AND start % 4 = 0""")
def e16(spark: SparkSession, d: str) -> DataFrame:
    s = S.sliding(
        blocks(spark, d), "file_id", "idx", 8, mean_level=lambda w: F.round(F.avg("level").over(w), 6), least=lambda w: F.min("level").over(w), sd=lambda w: F.round(F.stddev_pop("level").over(w), 6),
        dead=lambda w: F.count_if(F.col("level") <= CLOSE).over(w) == 8, share=lambda w: F.round(F.avg(F.when(F.col("level") > CLOSE, 1.0).otherwise(0.0)).over(w), 6),
    )
    return s.filter("start % 4 = 0")


@query("e17_ranked_windows", f"""WITH {B}, w0 AS (SELECT file_id, idx AS start, round(avg(level) OVER w, 6) m, round(stddev_pop(level) OVER w, 6) sd, count(*) OVER w n FROM b WINDOW w AS (PARTITION BY file_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
w1 AS (SELECT * FROM w0 WHERE n = 8 AND m > {CLOSE}), md AS (SELECT file_id, quantile_cont(sd, 0.5) q FROM w1 GROUP BY 1)
SELECT file_id, start, row_number() OVER (PARTITION BY file_id ORDER BY m DESC, start) AS rank FROM w1 JOIN md USING (file_id) WHERE sd <= q""")
def e17(spark: SparkSession, d: str) -> DataFrame:
    s = S.sliding(blocks(spark, d), "file_id", "idx", 8, m=lambda w: F.round(F.avg("level").over(w), 6), sd=lambda w: F.round(F.stddev_pop("level").over(w), 6)).filter(F.col("m") > CLOSE)
    q = quantiles(s, ["file_id"], "sd", (0.5,)).select("file_id", F.get("q", F.lit(0)).alias("q"))
    return s.join(q, "file_id").filter("sd <= q").select("file_id", "start", F.row_number().over(Window.partitionBy("file_id").orderBy(F.col("m").desc(), "start")).alias("rank"))


_W17 = f"""{B}, w0 AS (SELECT file_id, idx AS start, round(avg(level) OVER w, 6) m, round(stddev_pop(level) OVER w, 6) sd, count(*) OVER w n FROM b WINDOW w AS (PARTITION BY file_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
w1 AS (SELECT * FROM w0 WHERE n = 8 AND m > {CLOSE}), md AS (SELECT file_id, quantile_cont(sd, 0.5) q FROM w1 GROUP BY 1), cd AS (SELECT file_id, start AS pos, row_number() OVER (PARTITION BY file_id ORDER BY m DESC, start) AS rank FROM w1 JOIN md USING (file_id) WHERE sd <= q)"""
#: A greedy fold over a key's sorted candidates (cd: file_id, pos, rank): the best {n} that are {gap} apart.
_GREEDY = "p AS (SELECT file_id, list_reduce(list([pos::DOUBLE] ORDER BY rank, pos), lambda a, x: CASE WHEN len(a) < {n} AND len(list_filter(a, lambda y: abs(y - x[1]) < {gap})) = 0 THEN list_concat(a, x) ELSE a END) p FROM cd GROUP BY 1)"


@query("e18_greedy_spaced", f"WITH {_W17}, {_GREEDY.format(n=5, gap=10)} SELECT file_id, unnest(range(len(p)))::INTEGER AS pick, unnest(p) AS start FROM p")
def e18(spark: SparkSession, d: str) -> DataFrame:
    return S.greedy_spaced(e17(spark, d), "file_id", "start", "rank", 5, 10)


@query("e21_prefix_energy", f"""WITH {B}, p AS (SELECT file_id, idx, coalesce(sum((level * level)::DECIMAL(38, 6)) OVER (PARTITION BY file_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) c FROM b),
w AS (SELECT file_id, idx AS start, lead(c, 8) OVER (PARTITION BY file_id ORDER BY idx) - c AS energy FROM p)
SELECT file_id, arg_max(start, energy * 1000000 - start) AS loudest, max(energy)::DOUBLE AS energy FROM w WHERE energy IS NOT NULL GROUP BY 1""")
def e21(spark: SparkSession, d: str) -> DataFrame:
    w = S.window_energy(blocks(spark, d), "file_id", "idx", (F.col("level") * F.col("level")).cast("decimal(20,6)"), 8)
    return w.groupBy("file_id").agg(F.max_by("start", F.struct("energy", -F.col("start"))).alias("loudest"), F.max("energy").cast("double").alias("energy"))


@query("e22_edge_silence", f"""WITH {B} SELECT file_id, coalesce(min(CASE WHEN level > {OPEN} THEN idx END), count(*)) AS head, coalesce(count(*) - 1 - max(CASE WHEN level > {OPEN} THEN idx END), count(*)) AS tail FROM b GROUP BY 1""")
def e22(spark: SparkSession, d: str) -> DataFrame:
    return S.edge_silence(blocks(spark, d), "file_id", "idx", F.col("level") > OPEN)


@query("e23_longest_run", f"""WITH {B}, r AS (SELECT file_id, count(*) n FROM (SELECT *, idx - row_number() OVER (PARTITION BY file_id ORDER BY idx) g FROM b WHERE level > {OPEN}) GROUP BY file_id, g), m AS (SELECT file_id, max(n) n FROM r GROUP BY 1)
SELECT file_id, coalesce(any_value(m.n), 0) AS longest, round(avg(CASE WHEN level > {OPEN} THEN 1.0 ELSE 0 END), 6) AS share FROM b LEFT JOIN m USING (file_id) GROUP BY 1""")
def e23(spark: SparkSession, d: str) -> DataFrame:
    return S.longest_run(blocks(spark, d), "file_id", "idx", F.col("level") > OPEN).withColumn("share", F.round("share", 6))


@query("e24_epoch_forward_fill", f"""WITH {B}, m AS (SELECT *, count(CASE WHEN class = 'purchase' THEN 1 END) OVER (PARTITION BY file_id ORDER BY idx ROWS UNBOUNDED PRECEDING) k FROM b)
SELECT file_id, idx, CASE WHEN k = 0 THEN NULL ELSE max(CASE WHEN class = 'purchase' THEN idx END) OVER (PARTITION BY file_id ORDER BY idx ROWS UNBOUNDED PRECEDING) END AS epoch FROM m""")
def e24(spark: SparkSession, d: str) -> DataFrame:
    return S.filled_forward(blocks(spark, d), "file_id", "idx", F.when(F.col("class") == "purchase", F.col("idx")), "epoch").select("file_id", "idx", "epoch")


@query("e25_epoch_elapsed", """WITH m AS (SELECT user_id, dayofmonth(ts) AS epoch, event_type, max(value) v FROM events GROUP BY 1, 2, 3) SELECT user_id AS run, epoch::INTEGER AS epoch, round(sum(v), 6) AS elapsed FROM m GROUP BY 1, 2""")
def e25(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events", "user_id", "ts", "event_type", "value").groupBy(F.col("user_id").alias("run"), F.dayofmonth("ts").alias("epoch"), "event_type").agg(F.max("value").alias("v"))
    return m.groupBy("run", "epoch").agg(F.round(F.sum("v"), 6).alias("elapsed"))


@query("e29_best_window", f"""WITH {B}, w AS (SELECT file_id, idx // 10 AS win, count(DISTINCT class) n, count(*) c FROM b WHERE level > {CLOSE} GROUP BY 1, 2)
SELECT file_id, win, n AS n_classes FROM w QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY n DESC, c DESC, win) = 1""")
def e29(spark: SparkSession, d: str) -> DataFrame:
    w = blocks(spark, d).filter(F.col("level") > CLOSE).groupBy("file_id", F.floor(F.col("idx") / 10).alias("win")).agg(F.countDistinct("class").alias("n_classes"), F.count(F.lit(1)).alias("c"))
    return S.top_by(w, ["file_id"], [F.col("n_classes").desc(), F.col("c").desc(), "win"]).drop("c")


@query("e31_local_floor", f"""WITH {B}, q AS (SELECT file_id, idx, level, quantile_cont(level, 0.5) OVER (PARTITION BY file_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) f FROM b) SELECT file_id, idx, round(f, 6) AS floor, round(level - f, 6) AS prominence FROM q""")
def e31(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("file_id").orderBy("idx").rowsBetween(-3, 3)
    q = blocks(spark, d).withColumn("f", F.expr("percentile(level, 0.5)").over(w))
    return q.select("file_id", "idx", F.round("f", 6).alias("floor"), F.round(F.col("level") - F.col("f"), 6).alias("prominence"))


@query("e32_prominent_peaks", f"""WITH {B}, q AS (SELECT file_id, idx, level, quantile_cont(level, 0.5) OVER (PARTITION BY file_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) f FROM b),
cd AS (SELECT file_id, idx AS pos, -round(level - f, 6) AS rank FROM q WHERE round(level - f, 6) >= 12), {_GREEDY.format(n=5, gap=4)} SELECT file_id, unnest(range(len(p)))::INTEGER AS pick, unnest(p) AS idx FROM p""")
def e32(spark: SparkSession, d: str) -> DataFrame:
    p = e31(spark, d).filter("prominence >= 12").withColumn("rank", -F.col("prominence"))
    return S.greedy_spaced(p, "file_id", "idx", "rank", 5, 4)


@query("d15_activity_summary", f"""WITH {SEGS}, rs AS (SELECT file_id, lead(s) OVER (PARTITION BY file_id ORDER BY s) - e g FROM sg), f AS (SELECT file_id, file_id % 4 cell, max(idx) + 1 n FROM b GROUP BY 1)
SELECT cell, files, total, active, round(active / total, 6) AS active_frac, n_segments, seg_p50, gap_p50 FROM (SELECT cell, count(*) files, sum(n)::BIGINT total FROM f GROUP BY 1)
JOIN (SELECT file_id % 4 cell, sum(e - s)::BIGINT active, count(*) n_segments, quantile_cont(e - s, 0.5) seg_p50 FROM sg GROUP BY 1) USING (cell) LEFT JOIN (SELECT file_id % 4 cell, quantile_cont(g, 0.5) gap_p50 FROM rs WHERE g IS NOT NULL GROUP BY 1) USING (cell)""")
def d15(spark: SparkSession, d: str) -> DataFrame:
    cell = (F.col("file_id") % 4).alias("cell")
    sg = segs(spark, d)
    f = blocks(spark, d).groupBy("file_id").agg((F.max("idx") + 1).alias("n")).groupBy(cell).agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("total"))
    lengths = sg.select(cell, (F.col("end") - F.col("start")).alias("len"))
    s = with_medians(lengths.groupBy("cell").agg(F.sum("len").alias("active"), F.count(F.lit(1)).alias("n_segments")), lengths, ["cell"], "len", "seg_p50")
    return with_medians(f.join(s, "cell"), S.rests(sg, "file_id").select(cell, "gap"), ["cell"], "gap", "gap_p50").withColumn("active_frac", F.round(F.col("active") / F.col("total"), 6))


@query("c10_interval_intersection", f"""WITH {SPANS}, a AS (SELECT * FROM sp WHERE class = 'click'), b2 AS (SELECT * FROM sp WHERE class = 'purchase')
SELECT a.file_id, greatest(a.s, b2.s) AS start, least(a.e, b2.e) AS "end", a.s AS start_a, b2.s AS start_b FROM a JOIN b2 ON a.file_id = b2.file_id AND least(a.e, b2.e) - greatest(a.s, b2.s) >= 600""")
def c10(spark: SparkSession, d: str) -> DataFrame:
    s = spans(spark, d)
    return joins.interval_intersections(s.filter("class = 'click'"), s.filter("class = 'purchase'"), ["file_id"], 600.0, 14400.0)


@query("c11_window_coverage", f"""WITH {SPANS}, {_MERGE.format(k='file_id')}, x AS (SELECT file_id, s, e, unnest(range(s // 86400, (e - 1) // 86400 + 1)) win FROM mg)
SELECT file_id, win AS "window", (sum(least(e, (win + 1) * 86400) - greatest(s, win * 86400)) * 2000000 + 86400) // 172800 / 1e6 AS cov FROM x GROUP BY 1, 2""")
def c11(spark: SparkSession, d: str) -> DataFrame:
    """Six decimals, halves up. A seventh decimal is often exactly 5 (27 of 86,400 seconds are 0.0003125), which rounding by a double's binary value may lose: SQL rounds whole numbers."""
    return S.coverage(S.merged(spans(spark, d), "file_id"), "file_id", 86400.0).withColumn("cov", F.round("cov", 6))


@query("c12_asof", """SELECT a.event_id, b.value AS section FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, ts, max(value) value FROM events WHERE event_type = 'click' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def c12(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type", "value")
    return joins.asof(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.filter("event_type = 'click'").select("user_id", "ts", F.col("value").alias("section")), ["user_id"], "ts", "section").select("event_id", "section")


@query("d30_exposure", "WITH c AS (SELECT user_id % 5 AS cell, event_type AS class, count(*) n FROM events GROUP BY 1, 2) SELECT cell, class, n, round(n / avg(n) OVER (PARTITION BY cell) - 1, 6) AS deviation FROM c")
def d30(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events", "user_id", "event_type").groupBy((F.col("user_id") % 5).alias("cell"), F.col("event_type").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("deviation", F.round(F.col("n") / F.avg("n").over(Window.partitionBy("cell")) - 1, 6))


@query("d31_draw_tracking", """SELECT user_id % 5 AS p, round(avg(value), 6) AS mean_k, round(avg(CASE WHEN value < 10 THEN 1.0 ELSE 0 END), 6) AS shortfall, round(avg(CASE WHEN event_id & 1 > 0 THEN 1.0 ELSE 0 END), 6) AS bit_1, round(avg(CASE WHEN event_id & 2 > 0 THEN 1.0 ELSE 0 END), 6) AS bit_2 FROM events GROUP BY 1""")
def d31(spark: SparkSession, d: str) -> DataFrame:
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return table(spark, d, "events", "user_id", "value", "event_id").groupBy((F.col("user_id") % 5).alias("p")).agg(F.round(F.avg("value"), 6).alias("mean_k"), share(F.col("value") < 10).alias("shortfall"), *[share(F.col("event_id").bitwiseAND(F.lit(b)) > 0).alias(f"bit_{b}") for b in (1, 2)])


@query("g1_stratified_split", f"""WITH u AS (SELECT c_custkey, c_mktsegment AS stratum, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {C.draw_sql(7, 'c_custkey', 'split')}, c_custkey) r, count(*) OVER (PARTITION BY c_mktsegment) n FROM customer),
k AS (SELECT *, least(greatest(1, round_even(n * 0.1, 0)), n - 2)::BIGINT nv FROM u)
SELECT c_custkey, stratum, CASE WHEN r <= nv THEN 'val' WHEN r <= 2 * nv THEN 'test' ELSE 'train' END AS split FROM k""")
def g1(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment").withColumnRenamed("c_mktsegment", "stratum")
    return sampling.stratified_split(c, "c_custkey", "stratum", 7)
