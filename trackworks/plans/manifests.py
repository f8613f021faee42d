"""Manifest queries: documents stand for files, part for the taxonomy, orders and lineitem for derived rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackworks.operators import columns as C
from trackworks.operators import gates, joins
from trackworks.registry import registry
from trackworks.session import table

query = registry.query


@query("a1_manifest_scan", "SELECT doc_id, source, n_chars FROM documents")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "source", "n_chars")


@query("a2_union_scan", "SELECT l_orderkey AS order_key, l_extendedprice AS price, 'lineitem' AS origin FROM lineitem UNION ALL SELECT o_orderkey, o_totalprice, 'orders' FROM orders")
def a2(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_extendedprice").alias("price"), F.lit("lineitem").alias("origin"))
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_totalprice").alias("price"), F.lit("orders").alias("origin"))
    return a.unionByName(b, allowMissingColumns=True)


@query("a4_label_json", """SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k, props IS NOT NULL AS has_label FROM events""")
def a4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("props").isNotNull().alias("has_label"))


@query("a7_dimension_lookup", "SELECT p_brand, count(*) AS n, count(DISTINCT p_type) AS n_types FROM part GROUP BY 1")
def a7(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_type").alias("n_types"))


@query("a10_resumable_worklist", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'cached' ELSE 'todo' END AS ops FROM orders")
def a10(spark: SparkSession, d: str) -> DataFrame:
    work = table(spark, d, "orders", "o_orderkey").withColumnRenamed("o_orderkey", "id")
    return joins.resumable(work, work.filter("id % 3 = 0"), "id")


@query("a11_dry_run", "SELECT doc_id, 'resample;trim' AS ops FROM documents ORDER BY doc_id LIMIT 25")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id").orderBy("doc_id").limit(25).withColumn("ops", F.lit("resample;trim"))


@query("a12_envelope_index", """WITH n AS (SELECT user_id AS file_id, count(*) AS n_blocks FROM events GROUP BY 1)
SELECT file_id, n_blocks, coalesce(sum(n_blocks) OVER (ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_block FROM n""")
def a12(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events", "user_id").groupBy(F.col("user_id").alias("file_id")).agg(F.count(F.lit(1)).alias("n_blocks"))
    return joins.prefix_offsets(n, "file_id", "n_blocks", "first_block")


@query("a13_run_history", """SELECT user_id AS run, dayofmonth(ts)::INTEGER AS epoch, event_type AS class, round(value, 6) AS score FROM events""")
def a13(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "user_id", "ts", "event_type", "value").withColumn("epoch", F.dayofmonth("ts").cast("string"))
    per_class = e.groupBy("user_id", "epoch", "event_type").agg(F.collect_list("value").alias("scores"))
    per_epoch = per_class.groupBy("user_id", "epoch").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "scores"))).alias("classes"))
    history = per_epoch.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("epoch", "classes")))).alias("json"))
    return joins.history_rows(history, "user_id", "json").select(F.col("user_id").alias("run"), "epoch", "class", F.round("score", 6).alias("score"))


@query("a14_provenance", """SELECT page_id, substr(sha256(url), 1, 12) AS config_hash, 'v1' AS version, 17 AS seed FROM pages""")
def a14(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages", "page_id", "url").select("page_id", F.substring(F.sha2("url", 256), 1, 12).alias("config_hash"), F.lit("v1").alias("version"), F.lit(17).alias("seed"))


@query("b1_nfc_keys", "SELECT doc_id, md5(nfc_normalize(text)) AS key FROM documents")
def b1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(C.nfc("text")).alias("key"))


@query("b2_identity_parse", r"""SELECT c_custkey, regexp_extract(c_name, '[_#]([^_#]*)$', 1) AS token, ends_with(c_name, '1') AS is_master, regexp_replace(c_name, '\d+$', '') AS base FROM customer""")
def b2(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_name")
    return table(spark, d, "customer", "c_custkey", "c_name").select("c_custkey", C.song_token(n).alias("token"), n.endswith("1").alias("is_master"), C.without_digits(n).alias("base"))


@query("b3_stable_key", "SELECT page_id, 'pages:' || array_to_string(string_split(url, '/')[4:], '/') AS file_id FROM pages")
def b3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages", "page_id", "url").select("page_id", F.concat(F.lit("pages:"), C.path_after(F.col("url"), 3)).alias("file_id"))


@query("b4_channel_action", """SELECT c_custkey, CASE WHEN c_acctbal = 0 OR coalesce(c_acctbal, 0) / 10000 >= 0.9 THEN 'mono' WHEN coalesce(c_acctbal, 0) / 10000 <= -0.05 THEN 'pick' ELSE 'stereo' END AS action FROM customer""")
def b4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer", "c_custkey", "c_acctbal").select("c_custkey", C.channel_action(F.col("c_acctbal") / 10000, F.col("c_acctbal") == 0, 0.9, -0.05).alias("action"))


@query("b5_canonical_mapping", """SELECT p_partkey, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN lower(split_part(p_type, ' ', 1)) ELSE lower(p_type) END AS canonical FROM part""")
def b5(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("p_type")
    return table(spark, d, "part", "p_partkey", "p_brand", "p_type").select("p_partkey", F.when(F.col("p_brand").isin("Brand#11", "Brand#12"), F.lower(F.get(F.split(t, " "), F.lit(0)))).otherwise(F.lower(t)).alias("canonical"))


@query("b6_audit_text", """SELECT l_orderkey, l_linenumber, concat_ws(';', CASE WHEN l_discount > 0.05 THEN 'discounted' END, CASE WHEN l_tax > 0.04 THEN 'taxed' END, CASE WHEN l_quantity >= 40 THEN 'bulk' END) AS ops FROM lineitem""")
def b6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.audit(discounted=F.col("l_discount") > 0.05, taxed=F.col("l_tax") > 0.04, bulk=F.col("l_quantity") >= 40).alias("ops"))


@query("b7_pool_filter", "SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND source <> 'src0' AND n_chars >= 500")
def b7(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "lang", "source", "n_chars").filter(F.col("lang").isin("en", "de") & (F.col("source") != "src0") & (F.col("n_chars") >= 500)).drop("n_chars")


@query("b8_named_nulls", "SELECT d.doc_id, coalesce(l.quality::VARCHAR, 'unlabelled') AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def b8(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id").join(table(spark, d, "labels", "doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("unlabelled")).alias("quality"))


@query("b9_level_db", "SELECT o_orderkey, round(CASE WHEN o_totalprice - 100000 <= 0 THEN -120 ELSE greatest(-120, 20 * log10((o_totalprice - 100000) / 1e6)) END, 6) AS db FROM orders")
def b9(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", F.round(C.level_db((F.col("o_totalprice") - 100000) / F.lit(1e6)), 6).alias("db"))


@query("b10_gain_clamp", """SELECT c_custkey, round(greatest(-12, least(6, c_acctbal / 500)), 6) AS gain_db, round(pow(10, greatest(-12, least(6, c_acctbal / 500)) / 20), 6) AS gain, c_acctbal / 500 <> greatest(-12, least(6, c_acctbal / 500)) AS clamped FROM customer""")
def b10(spark: SparkSession, d: str) -> DataFrame:
    db, gain, clamped = C.gain_of(F.col("c_acctbal") / 500, -12.0, 6.0)
    return table(spark, d, "customer", "c_custkey", "c_acctbal").select("c_custkey", F.round(db, 6).alias("gain_db"), F.round(gain, 6).alias("gain"), clamped.alias("clamped"))


@query("b11_qc_flags", """SELECT c_custkey, list_filter([CASE WHEN c_acctbal < 0 THEN 'negative' END, CASE WHEN c_acctbal > 9000 THEN 'clipped' END, CASE WHEN c_nationkey = 0 THEN 'unplaced' END], lambda x: x IS NOT NULL) AS flags FROM customer""")
def b11(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("c_acctbal")
    return table(spark, d, "customer", "c_custkey", "c_acctbal", "c_nationkey").select("c_custkey", C.flags(negative=b < 0, clipped=b > 9000, unplaced=F.col("c_nationkey") == 0).alias("flags"))


@query("b12_finite_rows", "SELECT event_id, value FROM events WHERE value IS NOT NULL AND isfinite(value) AND coalesce(event_type, '') <> 'error'")
def b12(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events", "event_id", "value", "event_type").filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & (F.coalesce("event_type", F.lit("")) != "error")).drop("event_type")


@query("b13_elapsed_text", """SELECT event_id, ((date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts))) % 20000)::BIGINT AS seconds, (((date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts))) % 20000) // 60)::VARCHAR || ':' || lpad((((date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts))) % 20000) % 60)::VARCHAR, 2, '0') AS clock,
  CASE WHEN (date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts))) % 20000 < 60 THEN ((date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts))) % 20000)::VARCHAR || 's' WHEN (date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts))) % 20000 < 3600 THEN (((date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts))) % 20000) // 60)::VARCHAR || 'm' ELSE (((date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts))) % 20000) // 3600)::VARCHAR || 'h' END AS age FROM events""")
def b13(spark: SparkSession, d: str) -> DataFrame:
    s = F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp"))) % 20000
    e = table(spark, d, "events", "event_id", "ts").select("event_id", C.clock(s).alias("clock"), C.age_text(s).alias("age"))
    return e.withColumn("seconds", C.elapsed_seconds(F.col("clock")).cast("long"))


@query("b18_keyword_mentions", "SELECT doc_id, list_filter(['License', 'token', 'password', 'the '], lambda k: contains(text, k)) AS keywords FROM documents")
def b18(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", C.mentions(F.col("text"), ["License", "token", "password", "the "]).alias("keywords"))


@query("b19_step_from_name", r"SELECT c_custkey, regexp_extract(c_name, '#0*(\d+)$', 1)::INTEGER AS step FROM customer")
def b19(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer", "c_custkey", "c_name").select("c_custkey", F.regexp_extract("c_name", r"#0*(\d+)$", 1).cast("int").alias("step"))


@query("b20_formatted_cells", "SELECT o_orderkey, '| ' || o_orderstatus || ' | ' || printf('%.2f', o_totalprice) || ' |' AS cell FROM orders")
def b20(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice").select("o_orderkey", F.format_string("| %s | %.2f |", "o_orderstatus", "o_totalprice").alias("cell"))


@query("b21_blocks", "SELECT event_id, greatest(1, round_even(value / 0.5, 0)::INTEGER) AS blocks FROM events WHERE value IS NOT NULL")
def b21(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_id", "value").filter("value is not null").select("event_id", C.blocks_of(F.col("value"), 0.5).alias("blocks"))


@query("c1_validated_join", "SELECT o_orderkey, o_custkey, c_name, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey")
def c1(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders", "o_orderkey", "o_custkey"), table(spark, d, "customer", "c_custkey", "c_name", "c_acctbal").withColumnRenamed("c_custkey", "o_custkey")
    return joins.validated_left(o, c, "o_custkey")


@query("c2_dimension_complete", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def c2(spark: SparkSession, d: str) -> DataFrame:
    dim = table(spark, d, "part", "p_partkey", "p_brand").withColumnRenamed("p_partkey", "l_partkey")
    facts = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    return gates.require_known(facts, dim, "l_partkey").join(dim, "l_partkey", "left").drop("l_partkey")


@query("c3_lookup", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def c3(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer", "c_custkey", "c_nationkey"), table(spark, d, "nation", "n_nationkey", "n_name")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", "n_name")


@query("c4_semi_join", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def c4(spark: SparkSession, d: str) -> DataFrame:
    rich = table(spark, d, "customer", "c_custkey", "c_acctbal").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders", "o_orderkey", "o_custkey").join(rich, "o_custkey", "left_semi").select("o_orderkey")


RULES = [("A", 5, None), ("N", 7, [1, 2]), ("R", None, [3])]
_RULES_SQL = "rules(rule, flag, line, parts) AS (VALUES (0, 'A', 5, NULL), (1, 'N', 7, [1, 2]), (2, 'R', NULL, [3]))"
_MATCH = "l_returnflag = flag AND (line IS NULL OR l_linenumber = line) AND (parts IS NULL OR list_contains(parts, (l_partkey % 10)::INTEGER))"


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)], "rule int, flag string, line int, parts array<int>")


def _matches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    on = (F.col("l_returnflag") == F.col("flag")) & (F.col("line").isNull() | (F.col("l_linenumber") == F.col("line"))) & (F.col("parts").isNull() | F.array_contains("parts", (F.col("l_partkey") % 10).cast("int")))
    return li, on


@query("c5_exclusion_rules", f"WITH {_RULES_SQL} SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM rules WHERE {_MATCH})")
def c5(spark: SparkSession, d: str) -> DataFrame:
    li, on = _matches(spark, d)
    return li.join(F.broadcast(_rules(spark)), on, "left_anti").select("l_orderkey", "l_linenumber")


@query("c5_exclusion_audit", f"WITH {_RULES_SQL} SELECT rule, count(l_orderkey) AS n_dropped FROM rules LEFT JOIN lineitem ON {_MATCH} GROUP BY 1")
def c5b(spark: SparkSession, d: str) -> DataFrame:
    li, on = _matches(spark, d)
    hits = li.join(F.broadcast(_rules(spark)), on).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    return _rules(spark).join(hits, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n_dropped"))


@query("c14_parameter_grid", "SELECT source, t AS threshold, count(CASE WHEN n_chars < t THEN 1 END) AS n_below FROM documents, (VALUES (500), (1000), (2000)) v(t) GROUP BY 1, 2")
def c14(spark: SparkSession, d: str) -> DataFrame:
    grid = F.explode(F.array(*map(F.lit, (500, 1000, 2000))))
    counts = table(spark, d, "documents", "source", "n_chars").groupBy("source").agg(*[F.count_if(F.col("n_chars") < t).alias(str(t)) for t in (500, 1000, 2000)])
    return counts.withColumn("threshold", grid).select("source", "threshold", F.coalesce(*[F.when(F.col("threshold") == t, F.col(str(t))) for t in (500, 1000, 2000)]).alias("n_below"))


@query("c15_plan_truth", """SELECT l_returnflag AS pool, count(CASE WHEN o_orderkey IS NULL THEN 1 END) AS orphan, count(CASE WHEN l_shipdate < o_orderdate THEN 1 END) AS early, count(CASE WHEN l_extendedprice > o_totalprice THEN 1 END) AS over
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def c15(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_shipdate", "l_extendedprice"), table(spark, d, "orders", "o_orderkey", "o_orderdate", "o_totalprice")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "left").withColumn("pool", F.col("l_returnflag"))
    return gates.violations(j, ["pool"], orphan=F.col("o_orderkey").isNull(), early=F.col("l_shipdate") < F.col("o_orderdate"), over=F.col("l_extendedprice") > F.col("o_totalprice"))


@query("c16_outer_align", """WITH a AS (SELECT o_custkey song, count(*) n_f FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey song, count(*) n_o FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT song, coalesce(n_f, 0) AS n_f, coalesce(n_o, 0) AS n_o FROM a FULL JOIN b USING (song)""")
def c16(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_custkey", "o_orderstatus").withColumnRenamed("o_custkey", "song")
    return joins.aligned_counts([o.filter("o_orderstatus = 'F'").groupBy("song").agg(F.count(F.lit(1)).alias("n_f")), o.filter("o_orderstatus = 'O'").groupBy("song").agg(F.count(F.lit(1)).alias("n_o"))], "song")


@query("c17_required_lookup", "SELECT o_orderkey, c_nationkey AS lag FROM orders JOIN customer ON o_custkey = c_custkey")
def c17(spark: SparkSession, d: str) -> DataFrame:
    o, lag = table(spark, d, "orders", "o_orderkey", "o_custkey"), table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("lag"))
    return joins.validated_left(o, lag, "o_custkey").select("o_orderkey", "lag")


@query("c18_one_master", """SELECT l_orderkey AS song, count(CASE WHEN l_linenumber = 1 THEN 1 END) AS n_masters, count(CASE WHEN l_linenumber > 1 THEN 1 END) AS n_stems, list(l_partkey ORDER BY l_partkey) FILTER (WHERE l_linenumber > 1) AS stems
FROM lineitem GROUP BY 1 HAVING count(CASE WHEN l_linenumber = 1 THEN 1 END) = 1 AND count(CASE WHEN l_linenumber > 1 THEN 1 END) >= 1""")
def c18(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    return joins.one_master(li, "l_orderkey", F.col("l_linenumber") == 1, "l_partkey").withColumnRenamed("l_orderkey", "song")


@query("h1_version_diff", """WITH o AS (SELECT o_orderkey k FROM orders), n AS (SELECT o_orderkey k FROM orders WHERE o_orderkey % 7 <> 0 UNION SELECT -1), e AS (SELECT o_orderkey k FROM orders WHERE o_orderkey % 14 = 0 OR o_orderkey % 5 = 1)
SELECT k, 'removed' AS status FROM (SELECT k FROM o EXCEPT SELECT k FROM n) UNION ALL SELECT k, 'added' FROM (SELECT k FROM n EXCEPT SELECT k FROM o)
UNION ALL SELECT k, 'unexpected' FROM (SELECT k FROM o EXCEPT SELECT k FROM n EXCEPT SELECT k FROM e) UNION ALL SELECT k, 'still_present' FROM (SELECT k FROM e INTERSECT SELECT k FROM n)""")
def h1(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey").withColumnRenamed("o_orderkey", "k")
    new = o.filter("k % 7 <> 0").unionByName(spark.createDataFrame([(-1,)], o.schema))
    return gates.version_diff(o, new, "k", o.filter("k % 14 = 0 or k % 5 = 1"))


@query("h2_changed_columns", """SELECT 'o_totalprice' AS "column", count(*) AS n_changed FROM orders WHERE o_orderkey % 10 = 0 AND o_totalprice <> round(o_totalprice, 0) UNION ALL SELECT 'o_orderstatus', count(*) FROM orders WHERE o_orderkey % 4 = 0 AND o_orderstatus <> 'X'""")
def h2(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderstatus")
    b = a.withColumns({"o_totalprice": F.when(F.col("o_orderkey") % 10 == 0, F.round("o_totalprice", 0)).otherwise(F.col("o_totalprice")), "o_orderstatus": F.when(F.col("o_orderkey") % 4 == 0, "X").otherwise(F.col("o_orderstatus"))})
    return gates.changed_columns(a, b, "o_orderkey")


@query("h3_keep_list", "SELECT n_nationkey AS class, count(c_custkey) AS n, count(c_custkey) = 0 AS empty FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 9000 GROUP BY 1")
def h3(spark: SparkSession, d: str) -> DataFrame:
    pool = table(spark, d, "customer", "c_nationkey", "c_acctbal").filter("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    n = table(spark, d, "nation", "n_nationkey")
    return n.join(pool, n.n_nationkey == pool.c_nationkey, "left").select(F.col("n_nationkey").alias("class"), F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("empty"))


@query("h4_leaf_diff", """WITH a AS (SELECT event_id, event_type AS path, value AS was FROM events WHERE event_id % 11 <> 0), b AS (SELECT event_id, event_type AS path, CASE WHEN event_id % 5 = 0 THEN value + 1 ELSE value END AS now FROM events)
SELECT event_id, path, CASE WHEN was IS NOT DISTINCT FROM now THEN 'unchanged' WHEN path = 'click' THEN 'pass' ELSE 'unexpected' END AS verdict FROM a FULL JOIN b USING (event_id, path)""")
def h4(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "event_type", "value").withColumnRenamed("event_type", "path")
    b = e.withColumn("value", F.when(F.col("event_id") % 5 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return gates.leaf_diff(e.filter("event_id % 11 <> 0"), b, ["event_id", "path"], "value", F.col("path") == "click").drop("was", "now")


@query("h14_labelled_union", "SELECT l_orderkey AS id, 'early' AS run FROM lineitem WHERE l_shipdate < DATE '1995-01-01' UNION ALL SELECT l_orderkey, 'late' FROM lineitem WHERE l_shipdate >= DATE '1995-01-01'")
def h14(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_shipdate")
    early = F.col("l_shipdate") < F.lit("1995-01-01").cast("date")
    return joins.labelled_union({"early": li.filter(early), "late": li.filter(~early)}, "run").select(F.col("l_orderkey").alias("id"), "run")


@query("h16_orphan_outputs", "SELECT o_custkey AS id FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def h16(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "customer", "c_custkey", "c_acctbal").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct().join(have, "id", "left_anti")
