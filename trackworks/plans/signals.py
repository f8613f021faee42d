"""Signal queries: an embedding is a block, its label a song; even and odd samples are two channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackworks.operators import columns as C
from trackworks.operators import joins
from trackworks.operators import signals as X
from trackworks.registry import registry
from trackworks.session import table

query = registry.query


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """file_id, song, samples: values rounded to whole 1/4096, so that sums are the same in any order, and no zero is negative."""
    e = table(spark, d, "embeddings").filter("label is not null and embedding is not null")
    return e.select(F.col("vec_id").alias("file_id"), F.col("label").alias("song"), F.transform("embedding", lambda x: F.bround(x.cast("double") * 4096) / 4096 + 0.0).alias("samples"))


B = "b AS (SELECT vec_id AS file_id, label AS song, list_transform(embedding, lambda x: round_even(x::DOUBLE * 4096, 0) / 4096 + 0.0) AS samples FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL)"


def channels(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    half = lambda k: F.transform(F.sequence(F.lit(0), F.floor(F.size("samples") / 2).cast("int") - 1), lambda i: F.get("samples", 2 * i + k))
    return b.select("file_id", "song", half(0).alias("l"), half(1).alias("r"))


LR = f"{B}, lr AS (SELECT file_id, song, list_transform(range(1, len(samples) // 2 + 1), lambda i: samples[2 * i - 1]) l, list_transform(range(1, len(samples) // 2 + 1), lambda i: samples[2 * i]) r FROM b)"
SUMS = """s AS (SELECT {k}, sum(len(l))::DOUBLE n, sum(list_sum(l)) sx, sum(list_sum(r)) sy, sum(list_dot_product(l, l)) sxx, sum(list_dot_product(r, r)) syy, sum(list_dot_product(l, r)) sxy FROM lr GROUP BY ALL)"""


@query("f1_file_metrics", f"""WITH {B} SELECT song, round(max(list_max(list_transform(samples, lambda x: abs(x)))), 6) AS peak, round(sqrt(sum(list_dot_product(samples, samples)) / sum(len(samples))), 6) AS rms, round(sum(list_sum(samples)) / sum(len(samples)), 6) AS dc_offset,
round(sum(len(list_filter(samples, lambda x: abs(x) >= 0.4))) / sum(len(samples)), 6) AS clip_frac, round(sum(len(list_filter(samples, lambda x: abs(x) > 0.01))) / sum(len(samples)), 6) AS active_frac, max(list_max(list_transform(samples, lambda x: abs(x)))) < 0.0001 AS dead FROM b GROUP BY 1""")
def f1(spark: SparkSession, d: str) -> DataFrame:
    m = X.file_metrics(blocks(spark, d), ["song"], full_scale=0.4, active_at=0.01)
    return m.select("song", *[F.round(c, 6).alias(c) for c in ("peak", "rms", "dc_offset", "clip_frac", "active_frac")], "dead")


@query("f2_channel_correlation", f"""WITH {LR}, {SUMS.format(k='file_id')} SELECT file_id, round((sxy / n - sx / n * sy / n) / sqrt((sxx / n - pow(sx / n, 2)) * (syy / n - pow(sy / n, 2))), 6) AS lr_corr FROM s""")
def f2(spark: SparkSession, d: str) -> DataFrame:
    return X.products(channels(spark, d), ["file_id"], "l", "r").select("file_id", F.round(X.correlation(), 6).alias("lr_corr"))


@query("f3_conditioning", f"""WITH {B}, m AS (SELECT file_id, song, list_transform(samples, lambda x: x - list_avg(samples)) s FROM b), p AS (SELECT *, list_max(list_transform(s, lambda x: abs(x))) pk FROM m)
SELECT file_id, round(CASE WHEN pk > 0.3 THEN 0.3 / pk ELSE 1 END, 6) AS gain, round(pk * CASE WHEN pk > 0.3 THEN 0.3 / pk ELSE 1 END, 6) AS peak_after FROM p""")
def f3(spark: SparkSession, d: str) -> DataFrame:
    mean = X.total(F.col("samples"), lambda x: x) / F.size("samples")
    centred = blocks(spark, d).withColumn("mean", mean).withColumn("samples", F.transform("samples", lambda x: x - F.col("mean")))
    p = X.peak_scaled(centred, ["file_id"], "samples", 0.3)
    return p.select("file_id", F.round("gain", 6).alias("gain"), F.round(F.array_max(F.transform("samples", lambda x: F.abs(x))), 6).alias("peak_after"))


@query("f5_active_fraction", "SELECT user_id AS file_id, round(avg(CASE WHEN 20 * log10(greatest(value, 1e-6) / 100) > -12 THEN 1.0 ELSE 0 END), 6) AS active FROM events GROUP BY 1")
def f5(spark: SparkSession, d: str) -> DataFrame:
    level = 20 * F.log10(F.greatest(F.col("value"), F.lit(1e-6)) / 100)
    return table(spark, d, "events", "user_id", "value").groupBy(F.col("user_id").alias("file_id")).agg(F.round(F.avg(F.when(level > -12, 1.0).otherwise(0.0)), 6).alias("active"))


_CREST = "20 * log10(list_max(list_transform(samples, lambda x: abs(x))) / sqrt(list_dot_product(samples, samples) / len(samples)))"


@query("f6_crest", f"""WITH {B}, m AS (SELECT song, max(list_max(list_transform(samples, lambda x: abs(x)))) pk, sqrt(sum(list_dot_product(samples, samples)) / sum(len(samples))) r FROM b GROUP BY 1),
q AS (SELECT song, {_CREST} c FROM b WHERE sqrt(list_dot_product(samples, samples) / len(samples)) > 1e-6)
SELECT song, round(20 * log10(any_value(pk) / any_value(r)), 6) AS crest_db, round(quantile_cont(c, 0.5), 5) AS crest_p50_db, round(quantile_cont(c, 0.95), 5) AS crest_p95_db FROM m LEFT JOIN q USING (song) GROUP BY 1""")
def f6(spark: SparkSession, d: str) -> DataFrame:
    """A song's crest, and the median and 95th percentile of its blocks' own (a block stands for a second), silent ones left out."""
    b = blocks(spark, d)
    whole = X.file_metrics(b, ["song"]).select("song", F.round(X.crest_db(F.col("peak"), F.col("rms")), 6).alias("crest_db"))
    return whole.join(X.block_crests(b, ["song"], "file_id"), "song", "left")


@query("f8_mono_offset", "SELECT c_custkey, round(c_acctbal / 100 + CASE WHEN c_nationkey % 2 = 1 THEN 10 * log10(2) ELSE 0 END, 6) AS lufs FROM customer")
def f8(spark: SparkSession, d: str) -> DataFrame:
    import math

    c = table(spark, d, "customer", "c_custkey", "c_acctbal", "c_nationkey")
    return c.select("c_custkey", F.round(F.col("c_acctbal") / 100 + F.when(F.col("c_nationkey") % 2 == 1, 10 * math.log10(2)).otherwise(0.0), 6).alias("lufs"))


@query("f9_mixture", f"WITH {B}, x AS (SELECT song, unnest(range(0, len(samples))) pos, unnest(samples) v FROM b), m AS (SELECT song, pos, sum(v) v FROM x GROUP BY 1, 2), p AS (SELECT song, max(abs(v)) pk FROM m GROUP BY 1) SELECT song, pos::INTEGER AS pos, round(v * CASE WHEN pk > 0.99 THEN 0.99 / pk ELSE 1 END, 6) AS v FROM m JOIN p USING (song)")
def f9(spark: SparkSession, d: str) -> DataFrame:
    m = X.peak_scaled(X.vector_sum(blocks(spark, d), ["song"]), ["song"])
    return m.select("song", F.posexplode("samples").alias("pos", "v")).withColumn("v", F.round("v", 6))


@query("f10_sum_identity", f"""WITH {B}, x AS (SELECT song, file_id % 3 c, unnest(range(0, len(samples))) pos, unnest(samples) v FROM b), k AS (SELECT song, c, pos, sum(v) v FROM x GROUP BY 1, 2, 3), m AS (SELECT song, pos, sum(v) v FROM x GROUP BY 1, 2), t AS (SELECT song, pos, sum(v) v FROM k GROUP BY 1, 2)
SELECT song, max(abs(m.v - t.v)) < 1e-6 AS exact, round(sum(m.v * m.v), 5) AS energy FROM m JOIN t USING (song, pos) GROUP BY 1""")
def f10(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    mix = X.vector_sum(b, ["song"]).withColumnRenamed("samples", "mix")
    # targets first, by class, then their sum: the same mixture by another way
    classes = X.vector_sum(b.withColumn("class", F.col("file_id") % 3), ["song", "class"])
    again = X.vector_sum(classes, ["song"])
    diff = F.array_max(F.zip_with("mix", "samples", lambda a, c: F.abs(a - c)))
    return mix.join(again, "song", "full").select("song", (F.coalesce(diff, F.lit(1.0)) < 1e-6).alias("exact"), F.round(X.dot(F.col("mix"), F.col("mix")), 5).alias("energy"))


@query("f11_bounded_lag", f"""WITH {LR}, c AS (SELECT song, lag, sum(list_dot_product(l[greatest(0, -lag) + 1 : greatest(0, -lag) + len(l) - abs(lag)], r[greatest(0, lag) + 1 : greatest(0, lag) + len(r) - abs(lag)])) c FROM lr, (SELECT unnest(range(-6, 7)) lag) GROUP BY 1, 2)
SELECT song, arg_max(lag, (round(c, 9), -lag))::INTEGER AS lag, round(max(c), 6) AS c_at_lag, round(max(CASE WHEN lag = 0 THEN c END), 6) AS c_at_zero FROM c GROUP BY 1""")
def f11(spark: SparkSession, d: str) -> DataFrame:
    x = X.best_lag(channels(spark, d), ["song"], "l", "r", 6)
    return x.select("song", "lag", F.round("c_at_lag", 6).alias("c_at_lag"), F.round("c_at_zero", 6).alias("c_at_zero"))


@query("f12_gain_fit", f"""WITH {LR}, {SUMS.format(k='song')} SELECT song, round(sxy / sxx, 6) AS gain, round(10 * log10((syy - 2 * sxy + sxx) / syy), 5) AS raw_db, round(10 * log10((syy - sxy * sxy / sxx) / syy), 5) AS fitted_db FROM s""")
def f12(spark: SparkSession, d: str) -> DataFrame:
    g, raw, fitted = X.gain_fit()
    return X.products(channels(spark, d), ["song"], "l", "r").select("song", F.round(g, 6).alias("gain"), F.round(raw, 5).alias("raw_db"), F.round(fitted, 5).alias("fitted_db"))


@query("f14_mix_copy", f"WITH {LR}, {SUMS.format(k='file_id')} SELECT file_id, round(sxy * sxy / (sxx * syy), 6) AS explained, row_number() OVER (ORDER BY round(sxy * sxy / (sxx * syy), 6) DESC, file_id) AS rank FROM s")
def f14(spark: SparkSession, d: str) -> DataFrame:
    x = X.products(channels(spark, d), ["file_id"], "l", "r").select("file_id", F.round(F.col("sxy") * F.col("sxy") / (F.col("sxx") * F.col("syy")), 6).alias("explained"))
    x = x.withColumns({"order": -F.col("explained"), "one": F.lit(1)})
    return joins.prefix_offsets(x, "order", "one", "before", ties=("file_id",)).select("file_id", "explained", (F.col("before") + 1).cast("long").alias("rank"))


@query("f15_exact_duplicates", "SELECT md5(text) AS fingerprint, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL AND length(replace(text, text[1:1], '')) > 0 GROUP BY 1 HAVING count(*) > 1")
def f15(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    x = table(spark, d, "documents", "doc_id", "text").filter(F.length(F.replace(t, F.substring(t, 1, 1), F.lit(""))) > 0)
    return x.groupBy(F.md5("text").alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("f16_centre_excerpt", f"WITH {B}, n AS (SELECT song, min(len(samples)) n FROM b GROUP BY 1) SELECT file_id, list_filter(samples[(len(samples) - n // 2) // 2 + 1 : (len(samples) - n // 2) // 2 + n // 2], lambda x, i: (i - 1) % 4 = 0) AS excerpt FROM b JOIN n USING (song)")
def f16(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    n = b.groupBy("song").agg(F.min(F.size("samples")).alias("n"))
    size = F.floor(F.col("n") / 2).cast("int")
    start = F.floor((F.size("samples") - size) / 2).cast("int")
    return b.join(n, "song").select("file_id", F.filter(F.slice("samples", start + 1, size), lambda x, i: i % 4 == 0).alias("excerpt"))


_SI = "10 * log10((pow((sxy + 1e-8) / (sxx + 1e-8), 2) * sxx + 1e-8) / (greatest(pow((sxy + 1e-8) / (sxx + 1e-8), 2) * sxx - 2 * (sxy + 1e-8) / (sxx + 1e-8) * sxy + syy, 0) + 1e-8))"
_US = "10 * log10((sxx + 1e-8) / (greatest(sxx - 2 * sxy + syy, 0) + 1e-8))"


@query("f17_si_sdr", f"WITH {LR}, {SUMS.format(k='file_id')} SELECT file_id, round(greatest(-100, least(100, {_SI})), 4) AS si_sdr FROM s")
def f17(spark: SparkSession, d: str) -> DataFrame:
    return X.score(channels(spark, d), ["file_id"], "l", "r", ["si_sdr"]).withColumn("si_sdr", F.round("si_sdr", 4))


@query("f18_usdr", f"WITH {LR}, {SUMS.format(k='file_id')} SELECT file_id, round(greatest(-100, least(100, {_US})), 4) AS usdr FROM s")
def f18(spark: SparkSession, d: str) -> DataFrame:
    return X.score(channels(spark, d), ["file_id"], "l", "r", ["usdr"]).withColumn("usdr", F.round("usdr", 4))


@query("k1_metric_registry", f"WITH {LR}, {SUMS.format(k='song')} SELECT song, round({_SI}, 4) AS si_sdr, round({_US}, 4) AS usdr FROM s")
def k1(spark: SparkSession, d: str) -> DataFrame:
    x = X.score(channels(spark, d), ["song"], "l", "r", ["si_sdr", "usdr"])
    return x.select("song", F.round("si_sdr", 4).alias("si_sdr"), F.round("usdr", 4).alias("usdr"))


@query("f19_routed_scores", f"""WITH {LR}, {SUMS.format(k='file_id')} SELECT file_id, CASE WHEN sqrt(sxx / n) > 0.12 THEN 'present' ELSE 'absent' END AS status, round(CASE WHEN sqrt(sxx / n) > 0.12 THEN {_US} END, 4) AS usdr, round(CASE WHEN sqrt(sxx / n) <= 0.12 THEN 10 * log10(syy / n) END, 4) AS level_db FROM s""")
def f19(spark: SparkSession, d: str) -> DataFrame:
    p = X.products(channels(spark, d), ["file_id"], "l", "r")
    present = F.sqrt(F.col("sxx") / F.col("n")) > 0.12
    return p.select("file_id", F.when(present, "present").otherwise("absent").alias("status"), F.round(F.when(present, X.usdr()), 4).alias("usdr"), F.round(F.when(~present, X.db(F.col("syy") / F.col("n"))), 4).alias("level_db"))


@query("f20_leakage_matrix", f"""WITH {B}, x AS (SELECT song, file_id % 4 c, unnest(range(0, len(samples))) pos, unnest(samples) v FROM b), k AS (SELECT song, c, pos, sum(v) v FROM x GROUP BY 1, 2, 3),
p AS (SELECT a.song, a.c head, b2.c source, sum(a.v * b2.v) xy, sum(a.v * a.v) xx, sum(b2.v * b2.v) yy FROM k a JOIN k b2 ON a.song = b2.song AND a.pos = b2.pos GROUP BY 1, 2, 3)
SELECT head, source, round(avg(xy * xy / (xx * yy)), 6) AS leak FROM p WHERE xx > 1e-6 AND yy > 1e-6 GROUP BY 1, 2""")
def f20(spark: SparkSession, d: str) -> DataFrame:
    k = X.vector_sum(blocks(spark, d).withColumn("c", F.col("file_id") % 4), ["song", "c"])
    pairs = k.select("song", F.col("c").alias("head"), F.col("samples").alias("x")).join(k.select("song", F.col("c").alias("source"), F.col("samples").alias("y")), "song")
    p = X.products(pairs, ["song", "head", "source"], "x", "y").filter("sxx > 1e-6 and syy > 1e-6")
    return p.groupBy("head", "source").agg(F.round(F.avg(F.col("sxy") * F.col("sxy") / (F.col("sxx") * F.col("syy"))), 6).alias("leak"))


@query("f22_overview", f"WITH {B}, x AS (SELECT file_id, unnest(range(0, len(samples))) pos, unnest(samples) v FROM b) SELECT file_id, pos // 16 AS cell, min(v) AS least, max(v) AS most FROM x GROUP BY 1, 2")
def f22(spark: SparkSession, d: str) -> DataFrame:
    return X.overview(blocks(spark, d), ["file_id"], "samples", 16)


_SNR_DB = 20.0
_NOISE = C.draw_sql(28, "file_id || ':' || (i - 1)", 'noise')


@query("f28_degraded", f"""WITH {B}, z AS (SELECT file_id, samples, list_transform(samples, lambda x, i: round(2 * {_NOISE} - 1, 6)) noise FROM b),
g AS (SELECT *, CASE WHEN list_dot_product(noise, noise) > 0 THEN sqrt(list_dot_product(samples, samples) / (list_dot_product(noise, noise) * {10 ** (_SNR_DB / 10)})) ELSE 0 END gain FROM z)
SELECT file_id, list_transform(samples, lambda x, i: round(greatest(-0.25, least(0.25, round_even(round(x + gain * noise[i], 6) * 64, 0) / 64)), 6) + 0.0) AS samples FROM g""")
def f28(spark: SparkSession, d: str) -> DataFrame:
    """Noise at 20 dB under the signal, then 7 bits, then a ceiling."""
    b = blocks(spark, d)
    noise = F.transform("samples", lambda _, i: F.round(2 * C.draw(28, F.concat_ws(":", F.col("file_id").cast("string"), i.cast("string")), "noise") - 1, 6))
    noisy = X.with_noise(b.withColumn("noise", noise), "samples", "noise", _SNR_DB)
    q = lambda x: F.round(F.greatest(F.lit(-0.25), F.least(F.lit(0.25), F.bround(F.round(x, 6) * 64) / 64)), 6) + 0.0
    return noisy.select("file_id", F.transform("samples", q).alias("samples"))


@query("c9_unordered_pairs", "SELECT a.l_orderkey AS song, a.l_linenumber AS part_a, b.l_linenumber AS part_b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber")
def c9(spark: SparkSession, d: str) -> DataFrame:
    """An order is a song of a few parts."""
    stems = table(spark, d, "lineitem", "l_orderkey", "l_linenumber").select(F.col("l_orderkey").alias("song"), F.col("l_linenumber").alias("part"))
    return joins.unordered_pairs(stems, "song", "part")
