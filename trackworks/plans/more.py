"""Further queries: envelopes, spectra, limiters, anchors, status lines, texts."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackworks.functions import logs as L
from trackworks.operators import columns as C
from trackworks.operators import joins, ranges, runs, spectral
from trackworks.operators import sequences as S
from trackworks.operators import signals as X
from trackworks.plans import activity as A
from trackworks.plans import signals as G
from trackworks.plans.log_lines import LINES_SQL, sample_line
from trackworks.registry import registry
from trackworks.session import table
from trackworks.sources.scratch import kept

query = registry.query

_FB = f"{G.B}, fb AS (SELECT song, row_number() OVER (PARTITION BY song ORDER BY file_id) - 1 AS k, samples FROM b), fr AS (SELECT song, k * 64 + unnest(range(0, len(samples))) fr, unnest(samples) v FROM fb)"


def file_blocks(spark: SparkSession, d: str) -> DataFrame:
    """A song's vectors one after the other as the blocks of a file."""
    b = G.blocks(spark, d)
    k = F.row_number().over(Window.partitionBy("song").orderBy("file_id")) - 1
    return b.select("song", (k * 64).cast("long").alias("start"), k.alias("k"), "samples")


@query("f4_level_envelope", f"WITH {_FB} SELECT song, fr // 48 AS block_idx, round(10 * log10(sum(v * v) / 48), 5) AS dbfs FROM fr GROUP BY 1, 2 HAVING count(*) = 48")
def f4(spark: SparkSession, d: str) -> DataFrame:
    return spectral.level_envelope(file_blocks(spark, d), "song", "start", "samples", 48).withColumn("dbfs", F.round("dbfs", 5))


def _as_files(spark: SparkSession, d: str) -> DataFrame:
    return file_blocks(spark, d).select(F.col("song").alias("file_id"), F.lit(8000).alias("sr"), "start", F.array("samples").alias("samples"))


def _k_sql(frames: str, rate: int, keys: str = "f") -> str:
    """Loudness of frames (f, x: a list of all samples of a file) as SQL says it: both filters as one recursion from frame to frame, hops, runs of four, gates; g gives by keys lufs and n."""
    (b, a), (c, e) = spectral.k_coefficients(rate)
    u = f"({b[0]!r} * x[i + 1] + s1)"
    y = f"({c[0]!r} * {u} + t1)"
    level = f"{spectral.OFFSET_LU} + 10 * log10"
    return f"""{frames}, st AS (SELECT f, 0::BIGINT i, 0::DOUBLE s1, 0::DOUBLE s2, 0::DOUBLE t1, 0::DOUBLE t2, 0::DOUBLE y FROM xs
UNION ALL SELECT f, i + 1, {b[1]!r} * x[i + 1] - {a[1]!r} * {u} + s2, {b[2]!r} * x[i + 1] - {a[2]!r} * {u}, {c[1]!r} * {u} - {e[1]!r} * {y} + t2, {c[2]!r} * {u} - {e[2]!r} * {y}, {y} FROM st JOIN xs USING (f) WHERE i < len(x)),
ho AS (SELECT f, (i - 1) // {rate // 10} AS hop, sum(y * y) e, count(*) n FROM st WHERE i > 0 GROUP BY 1, 2 HAVING count(*) = {rate // 10}), hw AS (SELECT *, hop // 4 AS "window" FROM ho),
po AS (SELECT *, sum(e) OVER w / sum(n) OVER w p, count(*) OVER w k FROM hw WINDOW w AS (PARTITION BY {keys} ORDER BY hop ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)), lo AS (SELECT * FROM po WHERE k = 4 AND p > 0 AND {level}(p) > {spectral.ABSOLUTE_LUFS}),
ga AS (SELECT {keys}, {level}(avg(p)) + {spectral.RELATIVE_LU} gate FROM lo GROUP BY ALL), g AS (SELECT {keys}, {level}(avg(p)) lufs, count(*) n FROM lo JOIN ga USING ({keys}) WHERE {level}(p) > gate GROUP BY ALL)"""


@query("f7_integrated_loudness", f"WITH RECURSIVE {_k_sql(f'{_FB}, xs AS (SELECT song AS f, list(v::DOUBLE ORDER BY fr) x FROM fr GROUP BY 1)', 8000)} SELECT f AS file_id, round(lufs, 6) AS lufs, coalesce(n, 0)::BIGINT AS n_blocks FROM xs LEFT JOIN g USING (f)")
def f7(spark: SparkSession, d: str) -> DataFrame:
    return spectral.integrated_loudness(_as_files(spark, d)).withColumn("lufs", F.round("lufs", 6))


_F7_FILES = f"""{G.B}, bk AS (SELECT song % 2 AS f, row_number() OVER (PARTITION BY song % 2 ORDER BY file_id) - 1 AS k, samples FROM b),
xs AS (SELECT f, flatten(list(list_transform(samples, lambda v: CASE WHEN k * 64 >= 2560 AND k * 64 < 6400 THEN 0 ELSE v END::DOUBLE) ORDER BY k)) x FROM bk GROUP BY 1)"""


@query("f7_window_loudness", f"""WITH RECURSIVE {_k_sql(_F7_FILES, 8000, 'f, "window"')}, ga2 AS (SELECT f, {spectral.OFFSET_LU} + 10 * log10(avg(p)) + {spectral.RELATIVE_LU} gate FROM (SELECT f, sum(e) OVER w / sum(n) OVER w p, count(*) OVER w k FROM ho WINDOW w AS (PARTITION BY f ORDER BY hop ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) WHERE k = 4 AND p > 0 AND {spectral.OFFSET_LU} + 10 * log10(p) > {spectral.ABSOLUTE_LUFS} GROUP BY 1),
wh AS (SELECT f, {spectral.OFFSET_LU} + 10 * log10(avg(p)) whole FROM (SELECT f, sum(e) OVER w / sum(n) OVER w p, count(*) OVER w k FROM ho WINDOW w AS (PARTITION BY f ORDER BY hop ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) JOIN ga2 USING (f) WHERE k = 4 AND p > 0 AND {spectral.OFFSET_LU} + 10 * log10(p) > {spectral.ABSOLUTE_LUFS} AND {spectral.OFFSET_LU} + 10 * log10(p) > gate GROUP BY 1)
SELECT fw.f AS file_id, fw."window", round(lufs, 6) AS lufs, lufs IS NOT NULL AS measurable, round(lufs - whole, 6) AS minus_file FROM (SELECT f, "window" FROM hw GROUP BY 1, 2 HAVING count(*) = 4) fw LEFT JOIN g ON g.f = fw.f AND g."window" = fw."window" LEFT JOIN wh ON wh.f = fw.f""")
def f7_windows(spark: SparkSession, d: str) -> DataFrame:
    """Every full 0.4 seconds of two files; those of the second stretch are silent and stay, flagged."""
    w = Window.partitionBy("file_id").orderBy("vec")
    b = G.blocks(spark, d).select((F.col("song") % 2).alias("file_id"), F.col("file_id").alias("vec"), "samples")
    b = b.select("file_id", F.lit(8000).alias("sr"), ((F.row_number().over(w) - 1) * 64).cast("long").alias("start"), "samples")
    quiet = F.when((F.col("start") >= 2560) & (F.col("start") < 6400), F.transform("samples", lambda x: x * 0.0)).otherwise(F.col("samples"))
    x = spectral.window_loudness(b.withColumn("samples", F.array(quiet)), 0.4)
    return x.withColumns({"lufs": F.round("lufs", 6), "minus_file": F.round("minus_file", 6)})


_F7_CLIPS = f"""{G.B}, bk AS (SELECT ((row_number() OVER (ORDER BY file_id) - 1) // 25)::BIGINT AS f, row_number() OVER (ORDER BY file_id) - 1 AS k, samples FROM b),
xs AS (SELECT f, flatten(list(list_transform(samples, lambda v: v::DOUBLE * (1 + f % 3)) ORDER BY k)) x FROM bk GROUP BY 1)"""


@query("f7_loudness_profile", f"""WITH RECURSIVE {_k_sql(_F7_CLIPS, 4000)}, me AS (SELECT xs.f, lufs, 20 * log10(list_max(list_transform(x, lambda v: abs(v))) / sqrt(list_dot_product(x, x) / len(x))) crest FROM xs JOIN g ON g.f = xs.f),
rf AS (SELECT avg(lufs) mx, avg(crest) my, var_samp(lufs) vx, var_samp(crest) vy, covar_samp(lufs, crest) c FROM me WHERE f % 4 = 0), ow AS (SELECT f % 2 AS d, avg(lufs) mx, avg(crest) my, var_samp(lufs) vx, var_samp(crest) vy, covar_samp(lufs, crest) c FROM me WHERE f % 4 <> 0 GROUP BY 1),
sc AS (SELECT me.f, me.f % 2 AS d, (rf.vy * (lufs - rf.mx) * (lufs - rf.mx) - 2 * rf.c * (lufs - rf.mx) * (crest - rf.my) + rf.vx * (crest - rf.my) * (crest - rf.my)) / (rf.vx * rf.vy - rf.c * rf.c) dr,
(ow.vy * (lufs - ow.mx) * (lufs - ow.mx) - 2 * ow.c * (lufs - ow.mx) * (crest - ow.my) + ow.vx * (crest - ow.my) * (crest - ow.my)) / (ow.vx * ow.vy - ow.c * ow.c) dw, ln(rf.vx * rf.vy - rf.c * rf.c) lr, ln(ow.vx * ow.vy - ow.c * ow.c) lw FROM me JOIN ow ON ow.d = me.f % 2, rf WHERE me.f % 4 <> 0),
od AS (SELECT f, d, (dw + lw - dr - lr) / 2 + ln(0.001 / 0.999) o, dr < 5.991 AS inside FROM sc)
SELECT d AS dataset, f AS file_id, round(o, 4) AS log_odds, inside, row_number() OVER (PARTITION BY d ORDER BY o DESC, f) AS rank_in_dataset, count(*) OVER (PARTITION BY d) AS sources_in_dataset FROM od""")
def f7_profile(spark: SparkSession, d: str) -> DataFrame:
    """Files of 25 vectors, each fourth one of the reference population: a run measures half of them, the next one the rest, then they are ranked."""
    b = joins.prefix_offsets(G.blocks(spark, d).withColumn("one", F.lit(1)), "file_id", "one", "k")
    f = F.floor(F.col("k") / 25)
    b = b.select(f.alias("file_id"), F.lit(4000).alias("sr"), ((F.col("k") - f * 25) * 64).cast("long").alias("start"), F.array(F.transform("samples", lambda v: v * (1 + f % 3))).alias("samples"))
    b = kept(b)
    first = kept(spectral.loudness_measures(b.filter("file_id % 3 <> 1")))
    m = kept(spectral.loudness_measures(b, first)).withColumn("dataset", F.col("file_id") % 2)
    x = spectral.profile_ranking(m, "dataset", F.col("file_id") % 4 == 0, 1e-3)
    return x.select("dataset", "file_id", F.round("log_odds", 4).alias("log_odds"), "inside", "rank_in_dataset", "sources_in_dataset")


@query("f13_mix_weights", "SELECT DISTINCT label AS song, vec_id % 4 AS stem, round(1 + vec_id % 4, 2)::DOUBLE AS weight FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL")
def f13(spark: SparkSession, d: str) -> DataFrame:
    """The master is the stems at gains 1 to 4, which the fit gives back."""
    b = G.blocks(spark, d).withColumns({"stem": F.col("file_id") % 4})
    stems = X.vector_sum(b, ["song", "stem"]).withColumn("block", F.lit(0))
    gains = F.transform("samples", lambda x: x * (1 + F.col("stem")))
    master = X.vector_sum(stems.withColumn("samples", gains), ["song", "block"])
    return spectral.mix_weights(stems, master, "song", "block", "stem").withColumn("weight", F.round("weight", 2))


_DFT = f"""{G.B}, h AS (SELECT file_id, song, list_transform(samples, lambda x, i: x * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / (len(samples) - 1)))) s FROM b),
sp AS (SELECT file_id, song, k AS bin, pow(list_sum(list_transform(s, lambda x, i: x * cos(2 * pi() * k * (i - 1) / len(s)))), 2) + pow(list_sum(list_transform(s, lambda x, i: x * sin(2 * pi() * k * (i - 1) / len(s)))), 2) AS power FROM h, (SELECT unnest(range(0, 33)) k))"""


@query("f21_band_features", f"WITH {_DFT}, p AS (SELECT file_id, bin, greatest(power, 1e-20) p FROM sp) SELECT file_id, round(exp(avg(ln(p)) FILTER (bin >= 4 AND bin < 20)) / avg(p) FILTER (bin >= 4 AND bin < 20), 5) AS flatness, round(sum(p) FILTER (bin >= 4 AND bin < 20) / sum(p), 5) AS share FROM p GROUP BY 1")
def f21(spark: SparkSession, d: str) -> DataFrame:
    x = spectral.flatness(spectral.spectra(G.blocks(spark, d), ["file_id"]), ["file_id"], 4, 20)
    return x.select("file_id", F.round("flatness", 5).alias("flatness"), F.round("share", 5).alias("share"))


@query("f21_median_spectrum", f"WITH {_DFT} SELECT song, bin::INTEGER AS bin, round(10 * log10(greatest(quantile_cont(power, 0.5), 1e-20)), 5) AS level_db FROM sp GROUP BY 1, 2")
def f21_median(spark: SparkSession, d: str) -> DataFrame:
    return spectral.median_spectrum(spectral.spectra(G.blocks(spark, d), ["file_id", "song"]), ["song"]).withColumn("level_db", F.round("level_db", 5))


_F0 = "f0 AS (SELECT user_id % 10 AS song, event_id % 500 AS frame, event_type AS class, 110 + avg(value) AS f FROM events GROUP BY 1, 2, 3)"


@query("f23_pitch_agreement", f"""WITH {_F0}, j AS (SELECT a.class a, b.class b, 1200 * log2(a.f / b.f) c FROM f0 a JOIN f0 b ON a.song = b.song AND a.frame = b.frame AND a.class < b.class)
SELECT a, b, count(*) AS frames, count(CASE WHEN abs(c + 600 - 1200 * floor((c + 600) / 1200) - 600) < 50 THEN 1 END) AS hits FROM j GROUP BY 1, 2""")
def f23(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events", "user_id", "event_id", "event_type", "value").groupBy((F.col("user_id") % 10).alias("song"), (F.col("event_id") % 500).alias("frame"), F.col("event_type").alias("class")).agg((110 + F.avg("value")).alias("f"))
    return spectral.pitch_agreement(t, "song", "frame", "class", "f")


@query("f24_chance_pairs", f"""WITH r AS (SELECT vec_id, label, row_number() OVER (ORDER BY {C.draw_sql(21, 'vec_id', 'chance')}, vec_id) - 1 r, count(*) OVER () n FROM embeddings WHERE label IS NOT NULL)
SELECT a.vec_id AS file_a, b.vec_id AS file_b, floor({C.draw_sql(21, 'a.vec_id', 'offset')} * 64)::BIGINT AS "offset" FROM r a JOIN r b ON b.r = (a.r + 1) % a.n WHERE a.label <> b.label""")
def f24(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings", "vec_id", "label").filter("label is not null").withColumns({"u": C.draw(21, F.col("vec_id"), "chance"), "one": F.lit(1)})
    r = joins.prefix_offsets(e, "u", "one", "r", ties=("vec_id",))
    n = r.agg(F.count(F.lit(1)).alias("n"))
    a = r.join(F.broadcast(n)).select(F.col("vec_id").alias("file_a"), F.col("label").alias("la"), ((F.col("r") + 1) % F.col("n")).alias("r"))  # one row
    j = a.join(r.select("r", F.col("vec_id").alias("file_b"), F.col("label").alias("lb")), "r").filter("la <> lb")
    return j.select("file_a", "file_b", F.floor(C.draw(21, F.col("file_a"), "offset") * 64).alias("offset"))


@query("f25_gain_envelope", f"""WITH {A.B}, p AS (SELECT file_id, idx, -12 + 24 * {C.draw_sql(22, "file_id || ':' || idx", 'gain')} g FROM b WHERE idx % 8 = 3),
x AS (SELECT b.file_id, b.idx, (SELECT arg_max((p.idx, p.g), p.idx) FROM p WHERE p.file_id = b.file_id AND p.idx <= b.idx) lo, (SELECT arg_min((p.idx, p.g), p.idx) FROM p WHERE p.file_id = b.file_id AND p.idx >= b.idx) hi FROM b)
SELECT file_id, idx, round(CASE WHEN lo IS NULL THEN hi[2] WHEN hi IS NULL OR hi[1] = lo[1] THEN lo[2] ELSE lo[2] + (hi[2] - lo[2]) * (idx - lo[1]) / (hi[1] - lo[1]) END, 6) AS gain_db FROM x""")
def f25(spark: SparkSession, d: str) -> DataFrame:
    b = A.blocks(spark, d).select("file_id", "idx")
    key = F.concat_ws(":", F.col("file_id").cast("string"), F.col("idx").cast("string"))
    points = b.filter("idx % 8 = 3").withColumn("gain_db", -12 + 24 * C.draw(22, key, "gain"))
    return spectral.interpolated(b, points, "file_id", "idx", "gain_db").withColumn("gain_db", F.round("gain_db", 6))


@query("f26_limiter_gain", f"""WITH {A.B}, g AS (SELECT file_id, idx, CASE WHEN abs(level) > 70 THEN 70 / abs(level) ELSE 1 END g FROM b), m AS (SELECT *, min(g) OVER (PARTITION BY file_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) m FROM g)
SELECT file_id, idx, round(least(avg(m) OVER (PARTITION BY file_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), g), 6) AS gain FROM m""")
def f26(spark: SparkSession, d: str) -> DataFrame:
    x = spectral.limiter_gain(A.blocks(spark, d).select("file_id", "idx", "level"), "file_id", "idx", "level", 70.0, 4)
    return x.select("file_id", "idx", F.round("gain", 6).alias("gain"))


@query("f27_bus_allocation", f"""WITH {G.B}, x AS (SELECT song, file_id % 4 stem, unnest(range(0, len(samples))) pos, unnest(samples) v FROM b), s AS (SELECT song, stem, pos, sum(v) v FROM x GROUP BY 1, 2, 3), m AS (SELECT song, pos, sum(v) y, arg_max(stem, (abs(v), -stem)) top FROM s GROUP BY 1, 2)
SELECT s.song, s.stem, s.pos::INTEGER AS pos, round(s.v * 0.7 + CASE WHEN stem = top THEN greatest(-0.5, least(0.5, y * 0.7)) - y * 0.7 ELSE 0 END, 6) AS v FROM s JOIN m ON m.song = s.song AND m.pos = s.pos""")
def f27(spark: SparkSession, d: str) -> DataFrame:
    s = X.vector_sum(G.blocks(spark, d).withColumn("stem", F.col("file_id") % 4), ["song", "stem"])
    x = X.bus_allocated(s, ["song"], "stem", 0.7, 0.5)
    return x.select("song", "stem", F.posexplode("samples").alias("pos", "v")).withColumn("v", F.round("v", 6))  # the result's rows


@query("f29_shared_gain", f"""WITH {G.B}, x AS (SELECT song, unnest(range(0, len(samples))) pos, unnest(samples) v FROM b), m AS (SELECT song, pos, sum(v) v FROM x GROUP BY 1, 2)
SELECT song, round(least(pow(10, (-20 - 10 * log10(sum(v * v) / count(*))) / 20), 0.99 / max(abs(v))), 6) AS gain FROM m GROUP BY 1""")
def f29(spark: SparkSession, d: str) -> DataFrame:
    m = X.file_metrics(X.vector_sum(G.blocks(spark, d), ["song"]), ["song"])
    return m.select("song", F.round(F.least(F.pow(F.lit(10.0), (-20 - 20 * F.log10("rms")) / 20), 0.99 / F.col("peak")), 6).alias("gain"))


@query("c13_nearest", """WITH p AS (SELECT event_id, user_id, round(value, 2) v FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, round(value, 2) v, min(event_id) click FROM events WHERE event_type = 'click' GROUP BY 1, 2)
SELECT p.event_id, arg_min(c.click, round(abs(p.v - c.v), 2) * 1000000 + c.v) AS click FROM p LEFT JOIN c USING (user_id) GROUP BY 1""")
def c13(spark: SparkSession, d: str) -> DataFrame:
    # hundredths as whole numbers, so that distances are exact
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "value").withColumn("v", F.round(F.round("value", 2) * 100).cast("long"))
    p, c = e.filter("event_type = 'purchase'").select("event_id", "user_id", "v"), e.filter("event_type = 'click'").select("user_id", "v", F.col("event_id").alias("click"))
    return joins.nearest(p, c, ["user_id"], "v", "click").select("event_id", "click")


@query("d16_collapsed_cells", f"""WITH {A.SEGS}, c AS (SELECT file_id % 4 cell, file_id % 2 half, sum(e - s) a, quantile_cont(e - s, 0.5) m FROM sg GROUP BY 1, 2) SELECT half, sum(a)::BIGINT AS active, round(sum(a) / sum(sum(a)) OVER (), 6) AS ratio, quantile_cont(m, 0.5) AS median FROM c GROUP BY 1""")
def d16(spark: SparkSession, d: str) -> DataFrame:
    s = A.segs(spark, d).withColumn("len", F.col("end") - F.col("start"))
    s = s.select((F.col("file_id") % 4).alias("cell"), (F.col("file_id") % 2).alias("half"), "len")
    c = ranges.with_medians(s.groupBy("cell", "half").agg(F.sum("len").alias("a")), s, ["cell", "half"], "len", "m")
    g = ranges.with_medians(c.groupBy("half").agg(F.sum("a").alias("active")), c, ["half"], "m")
    t = g.agg(F.sum("active").alias("t"))
    return g.join(F.broadcast(t)).select("half", "active", F.round(F.col("active") / F.col("t"), 6).alias("ratio"), "median")  # a row a half


@query("d35_class_order", "WITH o AS (SELECT DISTINCT p_brand b FROM part UNION SELECT NULL) SELECT coalesce(b, '(none)') AS label, row_number() OVER (ORDER BY CASE b WHEN 'Brand#31' THEN 0 WHEN 'Brand#11' THEN 1 ELSE CASE WHEN b IS NULL THEN 3 ELSE 2 END END, b) AS position FROM o")
def d35(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("p_brand")
    o = table(spark, d, "part", "p_brand").distinct().unionByName(spark.createDataFrame([(None,)], "p_brand string")).distinct()
    rank = F.when(b == "Brand#31", 0).when(b == "Brand#11", 1).when(b.isNull(), 3).otherwise(2)
    return o.select(F.coalesce(b, F.lit("(none)")).alias("label"), F.row_number().over(Window.orderBy(rank, b)).alias("position"))  # class names only


@query("e19_best_per_section", f"""WITH {A.B}, x AS (SELECT file_id, idx, level, idx // 20 sec FROM b), t AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY file_id, sec ORDER BY level DESC, idx) = 1)
SELECT file_id, sec AS section, idx FROM t QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY level DESC, idx) <= 3""")
def e19(spark: SparkSession, d: str) -> DataFrame:
    x = A.blocks(spark, d).withColumn("section", F.floor(F.col("idx") / 20))
    best = S.top_by(x, ["file_id", "section"], [F.col("level").desc(), "idx"])
    return S.top_by(best, ["file_id"], [F.col("level").desc(), "idx"], 3).select("file_id", "section", "idx")


@query("e20_stratified_picks", f"""WITH {A.B}, x AS (SELECT file_id, idx::DOUBLE pos, level, row_number() OVER (PARTITION BY file_id, idx // 10 ORDER BY level DESC, idx) = 1 first FROM b WHERE idx < 60),
f AS (SELECT file_id, list(pos) FILTER (first) best, list([pos] ORDER BY level DESC, pos) FILTER (NOT first) rest FROM x GROUP BY 1),
p AS (SELECT file_id, best, list_reduce(list_prepend(best, coalesce(rest, [])), lambda a, y: CASE WHEN len(a) < 6 AND len(list_filter(a, lambda z: abs(z - y[1]) < 5)) = 0 THEN list_concat(a, y) ELSE a END) p FROM f)
SELECT file_id, unnest(p) AS idx, unnest(list_transform(p, lambda v: NOT list_contains(best, v))) AS filled FROM p""")
def e20(spark: SparkSession, d: str) -> DataFrame:
    return S.stratified_picks(A.blocks(spark, d), "file_id", "idx", "level", 0.0, 60.0, 6, 5.0)


@query("e30_covering_picks", """WITH RECURSIVE hc AS (SELECT DISTINCT l_orderkey id, l_returnflag || l_linenumber c FROM lineitem), ss AS (SELECT id, list(c) s FROM hc GROUP BY 1),
hv AS (SELECT c, count(*) n FROM hc GROUP BY 1), cl AS (SELECT list(c ORDER BY n, c) cs, list(least(3, n) ORDER BY n, c) need FROM hv),
r AS (SELECT 0 k, NULL::BIGINT id, []::BIGINT[] picked, cs, need FROM cl UNION ALL
SELECT k + 1, b.id, list_append(picked, b.id), cs, list_transform(need, lambda v, i: v - CASE WHEN list_contains(b.s, cs[i]) THEN 1 ELSE 0 END)
FROM (SELECT r.k, r.picked, r.cs, r.need, arg_min(struct_pack(id := ss.id, s := ss.s), (-len(list_filter(ss.s, lambda c: r.need[list_position(r.cs, c)] > 0)), ss.id)) b FROM r, ss
WHERE list_contains(ss.s, r.cs[list_position(list_transform(r.need, lambda v: v > 0), true)]) AND NOT list_contains(r.picked, ss.id) AND len(list_filter(r.need, lambda v: v > 0)) > 0 GROUP BY 1, 2, 3, 4))
SELECT id AS l_orderkey, k - 1 AS pick FROM r WHERE k > 0""")
def e30(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    return S.covering_picks(li.withColumn("class", F.concat("l_returnflag", F.col("l_linenumber").cast("string"))), "l_orderkey", "class", 3, store=kept)


_ANCHOR = f"WITH {A.SPANS}, m1 AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY file_id, class ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END n FROM sp), m2 AS (SELECT *, sum(n) OVER (PARTITION BY file_id, class ORDER BY s, e ROWS UNBOUNDED PRECEDING) q FROM m1), mg AS (SELECT file_id, class, min(s) s, max(e) e FROM m2 GROUP BY file_id, class, q)"


def _by_class(spark: SparkSession, d: str) -> DataFrame:
    """Spans of a file and class, merged; written, as all that reads them reads them more than once."""
    sp = A.spans(spark, d).withColumn("k", F.struct("file_id", "class"))
    return kept(S.merged(sp, "k").select("k.file_id", "k.class", "start", "end"))


def _anchors(m: DataFrame) -> DataFrame:
    a = m.select("file_id", F.col("class").alias("class_a"), "start", "end")
    b = m.select("file_id", F.col("class").alias("class_b"), "start", "end")

    def dealt(df: DataFrame, tag: str) -> DataFrame:
        day = F.explode(F.sequence(F.floor(F.col("start") / 14400), F.floor(F.col("end") / 14400)))
        return df.select("file_id", f"class_{tag}", F.col("start").alias(f"s{tag}"), F.col("end").alias(f"e{tag}"), day.alias("bucket"))

    j = dealt(a, "a").join(dealt(b, "b"), ["file_id", "bucket"]).filter("class_a < class_b")
    start, end = F.greatest("sa", "sb"), F.least("ea", "eb")
    return j.filter((end - start >= 900) & (F.floor(start / 14400) == F.col("bucket"))).select("file_id", "class_a", "class_b", start.alias("start"), end.alias("end"))


@query("g11_anchor_index", f"""{_ANCHOR} SELECT a.file_id, a.class AS class_a, b.class AS class_b, greatest(a.s, b.s) AS start, least(a.e, b.e) AS "end" FROM mg a JOIN mg b ON a.file_id = b.file_id AND a.class < b.class WHERE least(a.e, b.e) - greatest(a.s, b.s) >= 900""")
def g11(spark: SparkSession, d: str) -> DataFrame:
    return _anchors(_by_class(spark, d))


@query("h7_segment_invariants", f"WITH {A.SEGS} SELECT count(CASE WHEN e - s < {A.LEAST} THEN 1 END) AS undershoot, count(CASE WHEN e > n THEN 1 END) AS past_end, round(quantile_cont(e - s - {A.LEAST}, 0.95), 6) AS overshoot_p95 FROM sg JOIN nb USING (file_id)")
def h7(spark: SparkSession, d: str) -> DataFrame:
    n = A.blocks(spark, d).groupBy("file_id").agg((F.max("idx") + 1).alias("n"))
    s = A.segs(spark, d).join(n, "file_id").withColumn("len", F.col("end") - F.col("start"))
    g = s.agg(F.count_if(F.col("len") < A.LEAST).alias("undershoot"), F.count_if(F.col("end") > F.col("n")).alias("past_end"))
    return ranges.with_quantiles(g, s, [], F.col("len") - A.LEAST, (0.95,)).select("undershoot", "past_end", F.round(F.get("_q", F.lit(0)), 6).alias("overshoot_p95"))


@query("i10_run_status", """WITH x AS (SELECT user_id AS run, max(epoch_us(ts) // 1000000) last_seen, count(CASE WHEN event_type = 'purchase' THEN 1 END) p, count(CASE WHEN event_type = 'error' THEN 1 END) nf, min(value) lo, max(value) hi, (max(epoch_us(ts) // 1000000) - min(epoch_us(ts) // 1000000)) / greatest(count(*) - 1, 1) step FROM events GROUP BY 1)
SELECT run, CASE WHEN p >= 25 THEN 'done' WHEN nf > 0 THEN 'nan' WHEN 1706659200 - last_seen > 2 * step THEN 'stalled' WHEN hi - lo > 200 THEN 'drop' ELSE 'ok' END AS status FROM x""")
def i10(spark: SparkSession, d: str) -> DataFrame:
    t = F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp")))
    e, v = F.col("event_type"), F.col("value")
    x = table(spark, d, "events", "user_id", "ts", "event_type", "value").groupBy(F.col("user_id").alias("run")).agg(
        F.max(t).alias("last"), F.count_if(e == "purchase").alias("p"), F.count_if(e == "error").alias("nf"), (F.max(v) - F.min(v) > 200).alias("drop"), ((F.max(t) - F.min(t)) / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))).alias("step")
    )
    return x.select("run", runs.status(F.col("last"), F.col("step"), F.lit(1706659200), F.col("p") >= 25, F.col("nf"), F.col("drop")).alias("status"))


@query("i14_reference_mean", """WITH t AS (SELECT user_id % 5 AS run, event_type AS panel, dayofmonth(ts) AS epoch, avg(value) v FROM events GROUP BY 1, 2, 3), b AS (SELECT run, panel, arg_max(epoch, (round(v, 6), -epoch)) epoch FROM t GROUP BY 1, 2) SELECT panel, round(avg(v), 6) AS reference FROM t JOIN b USING (run, panel, epoch) GROUP BY 1""")
def i14(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events", "user_id", "event_type", "ts", "value").groupBy((F.col("user_id") % 5).alias("run"), F.col("event_type").alias("panel"), F.dayofmonth("ts").alias("epoch")).agg(F.avg("value").alias("v"))
    best = S.top_by(t.withColumn("r", F.round("v", 6)), ["run", "panel"], [F.col("r").desc(), "epoch"])
    return best.groupBy("panel").agg(F.round(F.avg("v"), 6).alias("reference"))


@query("b14_log_events", f"""WITH {LINES_SQL} SELECT event_id, kind, name, value, elapsed FROM ev""")
def b14(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "value").select("event_id", sample_line().alias("line"))
    return L.line_events(e).select("event_id", "kind", "name", "value", "elapsed")


@query("b15_programme", r"""WITH l AS (SELECT conv_id, turn, unnest(range(0, len(string_split(t, chr(10))))) pos, unnest(string_split(t, chr(10))) l FROM (SELECT conv_id, turn, turn || ':05 ' || text t FROM conversations)), m AS (SELECT *, regexp_extract(l, '^\s*\[?((?:\d+:)?\d{1,2}:\d{2})\]?\s*[-–]?\s*(.*\S)\s*$', ['t', 'title']) r FROM l)
SELECT conv_id * 1000 + turn AS text_id, pos::INTEGER AS pos, (split_part(r.t, ':', 1)::INTEGER * 60 + split_part(r.t, ':', 2)::INTEGER) AS start_s, r.title AS title FROM m WHERE r.t <> ''""")
def b15(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations", "conv_id", "turn", "text")
    return L.programme(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("text_id"), F.concat(F.col("turn").cast("string"), F.lit(":05 "), "text").alias("t")), "text_id", "t")


@query("b16_numbered_blocks", r"""WITH l AS (SELECT doc_id, unnest(range(0, len(ls))) pos, unnest(ls) l FROM (SELECT doc_id, string_split('1. First' || chr(10) || text, chr(10)) ls FROM documents WHERE text IS NOT NULL)),
h AS (SELECT *, regexp_extract(l, '^(\d+)\.\s*(.*)$', ['n', 't']) r, regexp_matches(l, '^(\d+)\.\s*(.*)$') ish FROM l),
f AS (SELECT *, last_value(CASE WHEN ish THEN try_cast(r.n AS INTEGER) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) num FROM h)
SELECT doc_id, num AS number, count(*) AS n_lines FROM f WHERE NOT ish AND num IS NOT NULL GROUP BY 1, 2""")
def b16(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents", "doc_id", "text").withColumn("t", F.concat(F.lit("1. First\n"), F.col("text")))
    return L.numbered_blocks(t, "doc_id", "t").groupBy("doc_id", "number").agg(F.count(F.lit(1)).alias("n_lines"))


@query("b17_credits", r"""WITH l AS (SELECT p_partkey, replace(p_type, ' ', '_') || '/' || replace(p_brand, '#', '·') AS credit FROM part),
m AS (SELECT *, split_part(credit, '/', 1) i, list_filter(string_split(split_part(credit, '/', 2), '·'), lambda x: x <> '' AND x <> 'Brand') names FROM l)
SELECT p_partkey, CASE WHEN i IN ('PROMO_BURNISHED_TIN', 'ECONOMY_PLATED_STEEL', 'STANDARD') AND len(names) > 0 THEN 1 ELSE 0 END::INTEGER AS n, credit FROM m""")
def b17(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_type")
    line = F.concat(F.regexp_replace("p_type", " ", "_"), F.lit("/"), F.regexp_replace("p_brand", "#", "·"))
    names = F.array_distinct(F.transform(L.credits(line, ["PROMO_BURNISHED_TIN", "ECONOMY_PLATED_STEEL", "STANDARD"], ["Brand"]), lambda x: x["instrument"]))
    return p.select("p_partkey", F.size(names).alias("n"), line.alias("credit"))


def _cluster_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, anchors and spans of cluster fills, written once for all modes.

    Users are items that want as many of their event types as come in clusters of others' joint activity, hours long.
    """
    items = table(spark, d, "events", "user_id", "event_type").groupBy(F.col("user_id").alias("item")).agg(F.sort_array(F.collect_set("event_type")).alias("classes")).withColumn("k", F.size("classes"))
    m = _by_class(spark, d)
    ends = [F.col(c).cast("double").alias(c) for c in ("start", "end")]
    anchors = _anchors(m).select(F.col("file_id").alias("song"), "class_a", "class_b", *ends)
    return kept(items), kept(anchors), m.select(F.col("file_id").alias("song"), "class", *ends)


def _clusters(tables: tuple[DataFrame, DataFrame, DataFrame], mode: str) -> DataFrame:
    from trackworks.operators import sampling

    items, anchors, spans = tables
    x = sampling.cluster_fill(items, "item", anchors, spans, 31, 7200.0, mode, store=kept, tables=True)
    return x.withColumn("start", F.round("start", 3))


@query("g12_cluster_fill")
def g12(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(_cluster_tables(spark, d), "uniform")


@query("g12_cluster_fill_weighted")
def g12_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(_cluster_tables(spark, d), "overlap_weighted")


@query("g12_cluster_fill_greedy")
def g12_greedy(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(_cluster_tables(spark, d), "greedy")


#: Items: a user and the classes of their events; anchors: two classes heard together; nf: items of two or more classes that no anchor fits.
_G12 = f"""{_ANCHOR}, an AS (SELECT a.file_id, a.class class_a, b.class class_b FROM mg a JOIN mg b ON a.file_id = b.file_id AND a.class < b.class AND least(a.e, b.e) - greatest(a.s, b.s) >= 900),
it AS (SELECT user_id item, list(DISTINCT event_type) classes FROM events GROUP BY 1), nf AS (SELECT count(*) n FROM it WHERE len(classes) >= 2 AND NOT EXISTS (SELECT 1 FROM an WHERE list_contains(it.classes, class_a) AND list_contains(it.classes, class_b)))"""


@query("g12_rule_breaks", f"""{_G12} SELECT mode, rule, CASE WHEN rule = 'no_anchor' THEN nf.n WHEN rule = 'items' THEN (SELECT count(*) FROM it WHERE len(classes) >= 2) ELSE 0 END::BIGINT AS n
FROM nf, (SELECT unnest(['uniform', 'overlap_weighted', 'greedy']) mode), (SELECT unnest(['no_anchor', 'items', 'class_twice', 'class_of_another_item', 'over_k', 'not_heard', 'two_songs_in_a_cluster']) rule)""")
def g12_breaks(spark: SparkSession, d: str) -> DataFrame:
    """How often a fill breaks one of its rules (never), by mode; and what doesn't depend on draws: items asked for, and those that no anchor fits."""
    tables = _cluster_tables(spark, d)
    items = tables[0].filter(F.size("classes") >= 2).select("item", "classes")
    heard = tables[2].select("song", "class", F.col("start").alias("_s"), F.col("end").alias("_e"))
    modes = ("uniform", "overlap_weighted", "greedy")
    x = kept(functools.reduce(DataFrame.unionByName, [_clusters(tables, m).withColumn("mode", F.lit(m)) for m in modes]))
    picks = x.filter("class is not null")
    members = picks.filter("role = 'member'")
    own = picks.join(items, "item")
    cover = members.join(heard, ["song", "class"]).groupBy("mode", "item", "cluster", "class").agg(F.sum(F.greatest(F.lit(0.0), F.least(F.col("_e"), F.col("start") + 7200) - F.greatest("_s", "start"))).alias("s"))
    rules = {
        "no_anchor": x.filter("reason = 'no_eligible_anchor' and cluster = 0"),
        "items": x.select("mode", "item").distinct(),
        "class_twice": picks.groupBy("mode", "item", "class").count().filter("count > 1"),
        "class_of_another_item": own.filter(~F.array_contains("classes", F.col("class"))),
        "over_k": own.groupBy("mode", "item", F.size("classes").alias("k")).count().filter("count > k"),
        "not_heard": cover.filter(F.col("s") <= 0.25 * 7200 - 0.01),
        "two_songs_in_a_cluster": members.groupBy("mode", "item", "cluster").agg(F.countDistinct("song", "start").alias("n")).filter("n > 1"),
    }
    broken = functools.reduce(DataFrame.unionByName, [df.select("mode", F.lit(rule).alias("rule")) for rule, df in rules.items()])
    n = broken.groupBy("mode", "rule").agg(F.count(F.lit(1)).alias("n"))
    every = spark.createDataFrame([(m, r) for m in modes for r in rules], "mode string, rule string")
    return every.join(F.broadcast(n), ["mode", "rule"], "left").na.fill({"n": 0})  # a row a mode and rule


_ITEM = C.draw_sql(32, "vec_id", "start")


@query("g14_realised_plan", f"""WITH {_FB}, p AS (SELECT vec_id AS item, label AS song, floor({_ITEM} * 200)::BIGINT AS start, 1 + vec_id % 3 AS gain FROM embeddings WHERE label IS NOT NULL
UNION ALL SELECT vec_id, (label + 1) % 10, floor({_ITEM} * 300)::BIGINT, 1 FROM embeddings WHERE label IS NOT NULL)
SELECT item, (fr - start)::INTEGER AS pos, round(sum(gain * v), 6) AS v FROM p JOIN fr ON fr.song = p.song AND fr >= start AND fr < start + 32 GROUP BY 1, 2""")
def g14(spark: SparkSession, d: str) -> DataFrame:
    from trackworks.operators import sampling

    e = table(spark, d, "embeddings", "vec_id", "label").filter("label is not null")
    u = C.draw(32, F.col("vec_id"), "start")
    a = e.select(F.col("vec_id").alias("item"), F.col("label").alias("song"), F.floor(u * 200).alias("start"), (1 + F.col("vec_id") % 3).alias("gain"))
    b = e.select(F.col("vec_id").alias("item"), ((F.col("label") + 1) % 10).alias("song"), F.floor(u * 300).alias("start"), F.lit(1).cast("long").alias("gain"))
    blocks = file_blocks(spark, d).withColumnRenamed("start", "first")
    x = sampling.realised(a.unionByName(b), blocks, "item", "song", 32, bucket=256)
    x = x.select("item", "first", F.posexplode("samples").alias("pos", "v"))  # the result's rows
    return x.select("item", (F.col("first") + F.col("pos")).cast("int").alias("pos"), F.round("v", 6).alias("v"))
