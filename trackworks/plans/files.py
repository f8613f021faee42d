"""Queries over files derived from the tables, and over the event table as a stream."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackworks.functions.logs import line_events
from trackworks.operators import gates
from trackworks.operators import signals as X
from trackworks.plans.log_lines import LINES_SQL, sample_line
from trackworks.registry import registry
from trackworks.session import table
from trackworks.sources import files
from trackworks.sources.scratch import drained, scratch, settled
from trackworks.streaming import logs

query = registry.query


@query("a3_csv_metadata", "SELECT n_nationkey, n_name FROM nation")
def a3(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "nation-csv")
    table(spark, d, "nation", "n_nationkey", "n_name").write.csv(path, header=True)
    return files.read_metadata(spark, path, "n_nationkey int, n_name string", "n_name").select(F.col("n_nationkey").cast(table(spark, d, "nation").schema["n_nationkey"].dataType).alias("n_nationkey"), "n_name")


@query("a5_file_inventory", """SELECT n_nationkey::BIGINT AS clip, CASE WHEN n_nationkey % 5 = 0 THEN 'master' ELSE 'stem' END AS role, 'nations' AS dataset, strlen(n_name) + 1 AS bytes, CASE WHEN n_nationkey % 7 = 3 THEN strlen(n_name) ELSE strlen(n_name) + 1 END AS stated, n_nationkey % 7 <> 3 AS as_stated FROM nation WHERE n_nationkey % 6 <> 4
UNION ALL SELECT n_nationkey, NULL, NULL, NULL, strlen(n_name) + 1, false FROM nation WHERE n_nationkey % 6 = 4""")
def a5(spark: SparkSession, d: str) -> DataFrame:
    """A file a nation, inventoried and held against a manifest that states each clip's size: some sizes are wrong, some files are missing."""
    n = table(spark, d, "nation", "n_nationkey", "n_name").withColumn("clip", F.col("n_nationkey").cast("long"))
    path = scratch(spark, "clips")
    for role, some in (("_master", F.col("clip") % 5 == 0), ("", F.col("clip") % 5 != 0)):
        n.filter(some & (F.col("clip") % 6 != 4)).select(F.concat(F.col("clip").cast("string"), F.lit(role)).alias("name"), "n_name").repartition("name").write.mode("append").partitionBy("name").text(path)
    found = files.inventory(spark, path, "*.txt", "nations", name=r"/name=([^/]*)/")
    found = found.select(F.regexp_extract("path", r"/name=(\d+)", 1).cast("long").alias("clip"), "role", "dataset", F.col("length").alias("bytes"))
    size = F.octet_length("n_name").cast("long")
    manifest = n.select("clip", F.when(F.col("clip") % 7 == 3, F.when(F.col("clip") % 6 == 4, size + 1).otherwise(size)).otherwise(size + 1).alias("stated"))
    return manifest.join(found, "clip", "left").select("clip", "role", "dataset", "bytes", "stated", F.coalesce(F.col("bytes") == F.col("stated"), F.lit(False)).alias("as_stated"))


@query("a8_manifest_sink", "SELECT lang, NULL::VARCHAR AS clip, doc_id FROM documents")
def a8(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "manifest")
    files.write_manifest(table(spark, d, "documents", "doc_id", "lang"), path, ["lang", "clip", "doc_id"], ["doc_id"], csv_twin=False)
    return spark.read.parquet(f"{path}/parquet")


def readings(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


_CLOSED = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)"


@query("j4_tumbling_envelope", f"""SELECT user_id, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 DAY AS "end", count(*) AS n, round(avg(value), 6) AS mean_level, max(value) AS peak_level, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0 END), 6) AS cov
FROM events GROUP BY 1, 2, 3 HAVING "end" <= {_CLOSED}""")
def j4(spark: SparkSession, d: str) -> DataFrame:
    w = logs.level_windows(readings(spark, d), "ts", "user_id", "value", "1 day", "10 minutes", active_at=20.0)
    return drained(w, "envelope").withColumns({c: F.round(c, 6) for c in ("mean_level", "cov")})


@query("j5_sliding_coverage", f"""WITH x AS (SELECT *, unnest([0, 1]) k FROM events), w AS (SELECT user_id, value, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 12 HOUR AS start FROM x)
SELECT user_id, start, start + INTERVAL 1 DAY AS "end", count(*) AS n, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0 END), 6) AS cov FROM w GROUP BY 1, 2 HAVING start + INTERVAL 1 DAY <= {_CLOSED}""")
def j5(spark: SparkSession, d: str) -> DataFrame:
    w = logs.level_windows(readings(spark, d), "ts", "user_id", "value", "1 day", "10 minutes", "12 hours", 20.0)
    return drained(w, "coverage").select("user_id", "start", "end", "n", F.round("cov", 6).alias("cov"))


@query("j6_activity_sessions", f"""WITH e AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END b FROM events WHERE value > 20), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n, max(value) AS peak_level FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events WHERE value > 20)""")
def j6(spark: SparkSession, d: str) -> DataFrame:
    return drained(logs.activity_sessions(readings(spark, d), "ts", "user_id", "value", 20.0, "6 hours", "10 minutes"), "sessions")


_STREAM = f"WITH {LINES_SQL}, e AS (SELECT 'run' || (user_id % 7) AS run, kind, name, value FROM ev)"


def log_stream(spark: SparkSession, d: str) -> DataFrame:
    """Lines (run, line) as they arrive in a folder of log files, a folder a run, written from the events."""
    path = scratch(spark, "logs")
    e = table(spark, d, "events", "event_id", "user_id", "value")
    e.select(F.concat(F.lit("run"), (F.col("user_id") % 7).cast("string")).alias("run"), sample_line().alias("line")).write.partitionBy("run").text(path)
    return spark.readStream.schema("value string, run string").text(path).select("run", F.col("value").alias("line"))


@query("j1_log_stream", f"{_STREAM} SELECT run, kind, name, value FROM e")
def j1(spark: SparkSession, d: str) -> DataFrame:
    return drained(line_events(log_stream(spark, d)).select("run", "kind", "name", "value"), "events")


@query("j2_running_digest", f"""{_STREAM} SELECT run, max(CASE WHEN kind = 'epoch' THEN value END)::BIGINT AS epoch, max(CASE WHEN kind = 'average' THEN value END) AS best, count(CASE WHEN kind = 'average' THEN 1 END) AS n_evals, coalesce(sum(CASE WHEN kind = 'non_finite' THEN value END), 0) AS non_finite,
count(CASE WHEN kind = 'nan_loss' THEN 1 END) AS nan_losses, bool_or(kind = 'trailer') AS done, bool_or(kind = 'trailer' AND name LIKE 'CRASHED%') AS crashed FROM e GROUP BY 1""")
def j2(spark: SparkSession, d: str) -> DataFrame:
    return settled(logs.running_digest(line_events(log_stream(spark, d))), "digest")


@query("j3_stalls", """WITH e AS (SELECT user_id::VARCHAR AS run, event_type, ts FROM events), w AS (SELECT max(epoch_us(date_trunc('millisecond', ts))) / 1e6 AS mark FROM e),
t AS (SELECT DISTINCT run, epoch_us(ts) / 1e6 AS t FROM e WHERE event_type = 'click'), s AS (SELECT run, t - lag(t) OVER (PARTITION BY run ORDER BY t) AS step FROM t), m AS (SELECT run, quantile_cont(step, 0.5) AS step, count(*) AS epochs FROM s GROUP BY 1),
l AS (SELECT run, max(epoch_us(ts)) / 1e6 AS last, bool_or(event_type = 'purchase' AND run::BIGINT % 5 = 0) AS done FROM e GROUP BY 1)
SELECT run, CASE WHEN done THEN 'done' WHEN floor(1000 * (last + coalesce(2 * step, 3600))) <= floor(1000 * mark) THEN 'stalled' ELSE 'ok' END AS status, coalesce(epochs, 0)::BIGINT AS epochs FROM l LEFT JOIN m USING (run), w""")
def j3(spark: SparkSession, d: str) -> DataFrame:
    """Clicks are epochs; a purchase ends each fifth run. A run's last status counts."""
    t, ends = F.col("event_type"), (F.col("event_type") == "purchase") & (F.col("user_id") % 5 == 0)
    kind = F.when(t == "click", "epoch").when(ends, "trailer").otherwise("other")
    said = drained(logs.stalls(readings(spark, d).select(F.col("user_id").cast("string").alias("run"), kind.alias("kind"), F.col("ts").alias("at"))), "stalls")
    rank = F.when(F.col("status") == "done", 2).when(F.col("status") == "stalled", 1).otherwise(0)
    return said.groupBy("run").agg(F.max_by("status", rank).alias("status"), F.max("epochs").alias("epochs"))


@query("j7_arriving_files", """SELECT n_nationkey::BIGINT AS key, CASE WHEN n_regionkey = 1 THEN 2 ELSE 1 END::BIGINT AS times, (CASE WHEN n_regionkey = 1 THEN 2 ELSE 1 END * (strlen(n_name) + 1))::BIGINT AS bytes FROM nation
UNION ALL SELECT 100 + r_regionkey, 1, strlen(r_name) + 1 FROM region""")
def j7(spark: SparkSession, d: str) -> DataFrame:
    """A file a nation, then a file a region and one more for each nation of the second region; the second run resumes the first and takes the new files only."""
    inbox, out = scratch(spark, "inbox"), scratch(spark, "arrived")
    nations = table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"), "n_regionkey")
    regions = table(spark, d, "region", "r_regionkey", "r_name").select((F.col("r_regionkey") + 100).alias("key"), F.col("r_name").alias("value"))
    for df in (nations.drop("n_regionkey"), regions.unionByName(nations.filter("n_regionkey = 1").drop("n_regionkey"))):
        df.repartition("key").write.partitionBy("key").mode("append").text(inbox)
        found = drained(logs.arriving_files(spark, inbox), "files", out)
    return found.groupBy(F.regexp_extract("path", r"/key=(\d+)/", 1).cast("long").alias("key")).agg(F.count(F.lit(1)).alias("times"), F.sum("length").alias("bytes"))


def _wavs(spark: SparkSession, d: str) -> DataFrame:
    """A WAV file of each vector, at half its level so that little is clipped, written as a table of bytes and read again."""
    e = table(spark, d, "embeddings", "vec_id", "embedding").filter("embedding is not null").withColumn("channels", F.array(F.transform("embedding", lambda x: x.cast("double") / 2)))
    path = scratch(spark, "wavs")
    e = e.repartition("vec_id")  # a small file of vectors is much work
    files.wav_files(e, "vec_id", "channels", 8000).write.parquet(path)
    return spark.read.parquet(path)


_PCM = "greatest(-1, least(32767 / 32768.0::DOUBLE, round_even(x::DOUBLE / 2 * 32768, 0) / 32768 + 0.0))"


@query("a6_wav_scan", f"WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: {_PCM}) x FROM embeddings WHERE embedding IS NOT NULL), k AS (SELECT *, unnest(range(0, (len(x) + 23) // 24)) k FROM s) SELECT vec_id AS file_id, k::INTEGER AS block_idx, 8000 AS sr, len(x[24 * k + 1 : 24 * k + 24])::INTEGER AS n_frames, list_transform(x[24 * k + 1 : 24 * k + 24], lambda v: v::DOUBLE) AS samples FROM k")
def a6(spark: SparkSession, d: str) -> DataFrame:
    b = files.wav_blocks(_wavs(spark, d), 24)
    return b.select(F.col("path").cast("long").alias("file_id"), "block_idx", "sr", "n_frames", F.get("samples", F.lit(0)).cast("array<double>").alias("samples"))


@query("h5_decode_parity", f"WITH s AS (SELECT vec_id AS file_id, list_max(list_transform(embedding, lambda x: abs({_PCM} - x::DOUBLE / 2))) m FROM embeddings WHERE embedding IS NOT NULL) SELECT file_id, round(m, 9) AS max_diff FROM s ORDER BY round(m, 9) DESC, file_id LIMIT 3")
def h5(spark: SparkSession, d: str) -> DataFrame:
    """The three files whose decoded samples are farthest from what was encoded."""
    decoded = files.wav_blocks(_wavs(spark, d)).select(F.col("path").cast("long").alias("file_id"), F.get("samples", F.lit(0)).alias("again"))
    e = table(spark, d, "embeddings", "vec_id", "embedding").filter("embedding is not null").select(F.col("vec_id").alias("file_id"), F.transform("embedding", lambda x: x.cast("double") / 2).alias("samples"))
    diff = X.products(e.join(decoded, "file_id"), ["file_id"], "samples", "again").select("file_id", F.round("max_diff", 9).alias("max_diff"))
    return diff.orderBy(F.col("max_diff").desc(), "file_id").limit(3)


@query("a9_versioned_sink", "SELECT 'v1' AS version, doc_id, lang, true AS refused FROM documents UNION ALL SELECT 'v2', doc_id, lang, true FROM documents WHERE lang = 'en'")
def a9(spark: SparkSession, d: str) -> DataFrame:
    """Two versions under names of their own; writing the first one again is refused and leaves it as it was."""
    docs, path = table(spark, d, "documents", "doc_id", "lang"), scratch(spark, "versions")
    put = lambda df, version: files.write_manifest(df, f"{path}/{version}", ["doc_id", "lang"], ["doc_id"], csv_twin=False)
    put(docs, "v1"), put(docs.filter("lang = 'en'"), "v2")
    try:
        put(docs.limit(0), "v1")
        refused = False
    except AnalysisException:
        refused = True
    read = lambda v: spark.read.parquet(f"{path}/{v}/parquet").select(F.lit(v).alias("version"), "doc_id", "lang", F.lit(refused).alias("refused"))
    return read("v1").unionByName(read("v2"))


@query("h8_constraints", """SELECT 'unique_order' AS rule, (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS n UNION ALL SELECT 'present_text', (SELECT count(*) FROM documents WHERE text IS NULL OR lang IS NULL)
UNION ALL SELECT 'known_document', (SELECT count(*) FROM labels WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')) UNION ALL SELECT 'constant_lang', (SELECT count(*) FROM (SELECT source FROM documents GROUP BY 1 HAVING min(lang) <> max(lang)))
UNION ALL SELECT 'rule_without_match', (SELECT count(*) FROM (SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey % 2 = 0)))""")
def h8(spark: SparkSession, d: str) -> DataFrame:
    """How many rows break each constraint: unique, not null, foreign key, constant by key, and a match for every rule."""
    docs, labels = table(spark, d, "documents", "doc_id", "text", "lang", "source"), table(spark, d, "labels", "doc_id")
    orders = table(spark, d, "orders", "o_custkey")
    rules = table(spark, d, "nation", "n_nationkey").select(F.col("n_nationkey").cast("long").alias("nation"), F.lit("BUILDING").alias("segment"))
    customers = table(spark, d, "customer", "c_nationkey", "c_mktsegment").filter("c_nationkey % 2 = 0").select(F.col("c_nationkey").cast("long").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return gates.constraint_report(
        unique_order=gates.not_unique(orders, "o_custkey"), present_text=gates.absent(docs, "text", "lang"), known_document=gates.unknown(labels, docs.filter("lang = 'en'"), "doc_id"),
        constant_lang=gates.not_constant(docs, "lang", "source"), rule_without_match=gates.unmatched(rules, customers, ["nation", "segment"]),
    )
