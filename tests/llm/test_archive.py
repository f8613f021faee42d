"""The archive against hashes of the pages it was made from, an exact round trip of WARC files, and damage."""

import hashlib

import pytest
from pyspark.sql import functions as F

from trackworks.llm import archive

PAGES = "page_id long, url string, html string, header string, digest string, payload string"
LONG = "x" * 300


def rows():
    own = [
        (5, "http://a.org/", LONG), (3, "http://b.org/?q=%20", LONG), (9, None, LONG), (4, "http://c.org", "é" * 50), (8, "http://c.org", "é" * 50),
        (1, "http://d.org", "short"), (2, "http://d.org", "short"), (6, "", None), (7, "http://e\r\nWARC-Type: revisit", ""), (10, " http://f\n", "a\r\n\r\nWARC/1.1\r\n\r\n" * 20),
        (None, "http://g", LONG), (3, "http://again", LONG), (11, "http://long", "y" * 2_000_000), (-4, "http://n", "é" * 49 + "a"),
    ]
    return [(*r, "h", "d", "p") for r in own]


def wanted(own):
    ids = {}
    for i, _, html, *_ in own:
        if i is not None:
            ids[html or ""] = min(i, ids.get(html or "", i))
    out = []
    for i, url, html, *_ in own:
        b = (html or "").encode()
        again = len(b) >= 100 and i != ids.get(html or "")
        out.append((i, url, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", ids[html] if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=str)


def test_records_read_back_are_the_pages(spark):
    assert got(archive.archived(spark.createDataFrame(rows(), PAGES).repartition(3))) == wanted(rows())


def test_all_ids_null_and_empty_tables(spark):
    null = [(None, "u", LONG), (None, "v", LONG)]
    assert {(r["record_type"], r["refers_to"]) for r in archive.archived(spark.createDataFrame(null, "page_id long, url string, html string")).collect()} == {("response", None)}
    assert archive.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_payloads_are_kept_once_and_records_put_together_whole(spark):
    path = archive.write_archive(spark.createDataFrame(rows(), PAGES))
    texts = {(r[2] or "").encode() for r in rows()}
    assert sorted(bytes(r["payload"]) for r in archive.payloads(spark, path).collect()) == sorted(texts)
    whole = archive.parsed(archive.records(spark, path)).collect()
    assert sorted((str(r["record_id"]), bytes(r["payload"])) for r in whole) == sorted((str(i), (h or "").encode()) for i, _, h, *_ in rows())


def test_warc_files_hold_exact_headers_and_blocks(spark, tmp_path):
    path = archive.write_archive(spark.createDataFrame(rows(), PAGES))
    archive.write_warc(archive.records(spark, path), f"file://{tmp_path}/warc")
    back = archive.parsed(archive.read_warc(spark, f"file://{tmp_path}/warc")).collect()
    heads = sorted(r["header"] for r in archive.headers(spark, path).collect())
    assert sorted(r["header"] for r in back) == heads and all(h.startswith("WARC/1.1\r\nWARC-Type: ") and h.endswith("\r\n") for h in heads)
    for r in back:
        assert len(r["block"]) == r["content_length"]
        if r["record_type"] == "response":
            assert hashlib.sha256(r["block"]).hexdigest() == r["payload_digest"]
    assert sum(len(r["block"]) for r in back) == sum(n for _, _, n, _, t, _ in wanted(rows()) if t == "response")


def test_damage_is_found(spark, tmp_path):
    path = archive.write_archive(spark.createDataFrame(rows(), PAGES))
    bad = f"file://{tmp_path}/bad"
    spark.read.parquet(f"{path}/headers").write.parquet(f"{bad}/headers")
    stored = spark.read.parquet(f"{path}/payloads")
    stored.withColumn("payload", F.when(F.octet_length("payload") == 300, F.encode(F.repeat(F.lit("z"), 300), "utf-8")).otherwise(F.col("payload"))).write.parquet(f"{bad}/payloads")
    with pytest.raises(Exception, match="payload damaged"):
        archive.records(spark, bad).collect()
    stored.filter(F.octet_length("payload") != 300).write.mode("overwrite").parquet(f"{bad}/payloads")
    with pytest.raises(Exception, match="no payload"):
        archive.records(spark, bad).collect()
