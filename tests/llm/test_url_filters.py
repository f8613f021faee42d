import random
import time

from pyspark.sql import functions as F

from trackworks.llm import url_filters as U
from trackworks.llm.queries import LISTED_PAGES, URL_RULES, op6_url_filter

RULES = URL_RULES
URLS = {1: "http://A.Example.NET/en/x", 2: "https://example.net", 3: "https://x.example.net/fr/", 4: "ftp://b.example.com/de/1?q#z", 5: "http://b.example.com/en/", 6: "http://w.org/fr/a",
        7: "http://w.org/de/a", 8: None, 9: "no scheme", 10: "http://net", 11: "http://net/", 12: "http://u.com://net/en/", 13: "://net/x", 14: "http://notexample.net.com/de/", 15: "", 16: "http://É.net/Ü?x", 17: "a\nb://q.net/x"}


def brute(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, rest = rest[:cut].translate({i: i + 32 for i in range(65, 91)}), rest[cut:]
        path = rest[: min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))]
    best = None
    for verdict, rule in RULES:
        rh, rp = rule.split("/", 1)
        if (host == rh or host.endswith("." + rh)) and path.startswith("/" + rp) and (best is None or len(rh) > len(best[1].split("/")[0])):
            best = (verdict, rule)
    return (host, path, best[1] if best else None, best[0] if best else ("block" if host + path in listed else "allow"))


def test_same_as_brute_force(spark):
    pages = spark.createDataFrame(list(URLS.items()), "page_id long, url string")
    listed = {"w.org/de/a", "nowhere/x"}
    r = U.judge_urls(pages, RULES, spark.createDataFrame([(x,) for x in listed], "key string")).collect()
    assert {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in r} == {i: brute(u, listed) for i, u in URLS.items()}


def test_cascade_is_exact_for_its_universe_in_one_part_and_in_many(spark):
    rng = random.Random(1)
    universe = [f"k{i}" for i in range(3000)]
    listed = set(rng.sample(universe, 700))
    u = spark.createDataFrame([(k,) for k in universe], "key string")
    ours = spark.createDataFrame([(k,) for k in [*listed, *listed, "elsewhere"]], "key string")
    for words in (1 << 17, 30):
        c = U.Cascade(ours, u, max_words=words)
        assert (c.parts > 1) == (words == 30) and len(c.levels) >= 3
        df = u.unionByName(u).unionByName(spark.createDataFrame([(None,)], "key string")).withColumns({"part": F.lit(7), "filters": F.lit("f")})
        got = c.listed(df, "key", "hit").collect()
        assert len(got) == 6001 and {r["key"] for r in got if r["hit"]} == listed and sum(r["hit"] for r in got) == 1400
        assert all(r["part"] == 7 and r["filters"] == "f" for r in got)


def test_a_long_filter_is_built_in_linear_time(spark):
    u = spark.range(300_000).select(F.concat(F.lit("k"), "id").alias("key"))
    began = time.perf_counter()
    c = U.Cascade(u.filter("hash(key) % 3 = 0"), u, max_words=1 << 20)
    assert c.parts == 1 and time.perf_counter() - began < 60
    assert c.listed(u, "key", "hit").filter("hit != (hash(key) % 3 = 0)").count() == 0


def test_empty_tables_nulls_and_clashes(spark):
    pages = spark.createDataFrame([(1, None, "h", "keep"), (1, None, "h", "keep")], "page_id long, url string, HOST string, url_key string")
    none = spark.createDataFrame([], "key string")
    r = U.judge_urls(pages, RULES, none)
    assert r.columns == ["page_id", "url", "url_key", "host", "path", "rule", "verdict"]
    assert [(x["host"], x["verdict"], x["url_key"]) for x in r.collect()] == [("", "allow", "keep")] * 2
    assert U.judge_urls(pages.limit(0), RULES, none).count() == 0
    assert U.Cascade(none, none).listed(spark.createDataFrame([(None,)], "key string"), "key", "hit").first()["hit"] is False


def test_addresses_and_a_very_long_url(spark):
    long = "http://Host.net/" + "p" * 200_000
    pages = spark.createDataFrame([(1, "http://a/x?1"), (2, "https://A/x#2"), (3, "http://b"), (4, None), (5, None), (6, long)], "page_id long, url string")
    assert sorted(r["key"] for r in U.addresses(pages).collect()) == sorted(["a/x", "b", "host.net/" + "p" * 200_000])
    r = {x["page_id"]: x for x in U.judge_urls(pages, RULES, U.addresses(pages.filter("page_id = 1"))).collect()}
    assert [r[i]["verdict"] for i in range(1, 7)] == ["block", "block", "allow", "allow", "allow", "block"] and r[6]["rule"] == "net/" and len(r[6]["path"]) == 200_001


def test_the_query_has_several_levels(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    keys = U.addresses(pages)
    listed = U.addresses(pages.filter(F.col("page_id") % LISTED_PAGES == 0))
    c = U.Cascade(listed, keys)
    assert listed.count() > 20 and len(c.levels) >= 3
    verdicts = {(r["rule"], r["verdict"]): r["count"] for r in op6_url_filter(spark, "/root/testdata/sf0.01").groupBy("rule", "verdict").count().collect()}
    assert verdicts[None, "block"] > 0 and verdicts[None, "allow"] > 0
