"""Content-addressed WARC archive: payload bytes once by digest, record headers apart, records put together by joins."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackworks.llm.shared import forget, own_name, shared_dir, stored

#: Payloads of fewer bytes are written with each record; equal ones of more are revisited.
LEAST_REVISITED = 100
#: The capture time of records, as pages carry none.
EPOCH = "1970-01-01T00:00:00Z"
#: WARC/1.1: the line that begins a record, its line end, and the end of a record.
VERSION, CRLF, RECORD_END = "WARC/1.1", "\r\n", "\r\n\r\n"
#: The profile of records whose payload another record has.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"


def _digest(payload: Column) -> Column:
    return F.sha2(payload, 256)


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _header(page_id: Column, url: Column, digest: Column, size: Column, first: Column, revisit: Column, date: str) -> Column:
    """Header bytes of a record without the empty line after them.

    An address with line ends can't stand in a header line: they are percent-encoded there, and a further field holds
    the address as it is.
    """
    urn = lambda c: F.concat(F.lit(f"<{_ID}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    odd = url.rlike(r"[\r\n]|^[ \t]|[ \t]$")
    safe = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit(VERSION + CRLF), _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")), _field("WARC-Record-ID", urn(page_id)), _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", safe), _field("X-Target-URI-Base64", F.when(odd, F.base64(F.encode(url, "utf-8")))), _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        _field("WARC-Refers-To", F.when(revisit, urn(first))), _field("WARC-Profile", F.when(revisit, F.lit(SAME_PAYLOAD))), _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.when(revisit, F.lit("0")).otherwise(size.cast("string"))),
    )


def write_archive(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = EPOCH) -> str:
    """Write a record for each row of `pages` to an archive and return its path (new in the shared folder, unless given).

    The archive is two Parquet tables. `payloads` (digest, payload): each payload once, under its SHA-256. `headers`
    (digest, header): the exact header of each record. Of records with equal payloads of at least LEAST_REVISITED bytes the
    one with the smallest id is a response, the others are revisits that refer to it; smaller ones are all responses.

    A null payload is an empty one, a null address gives a record without one; addresses and payloads of any length are
    written whole. Null ids come after all others. Rows that repeat the smallest id are responses too; other repeated rows
    are records of their own. Other columns play no part. An empty table gives an archive without records.

    Only digests and lengths are grouped to find the first records. Payloads are shuffled once, one copy for each digest
    and task; headers are joined with the first ids of repeated payloads only, where adaptive execution splits a hot one.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", _digest(F.col("payload")))
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    narrow = stored(rows.select("id", "url", "digest", F.octet_length("payload").alias("size")), "records")
    sizes = [F.min("size").alias("_a"), F.max("size").alias("_b"), F.count(F.lit(1)).alias("_n")]
    again = narrow.filter(F.col("size") >= LEAST_REVISITED).groupBy("digest").agg(F.min("id").alias("first"), *sizes).filter("_n > 1")
    # equal digests of payloads that differ would lose one of them
    again = again.select("digest", F.when(F.col("_a") == F.col("_b"), F.col("first")).otherwise(F.raise_error(F.lit("payloads of one digest differ in length"))).alias("first"), F.lit(True).alias("many"))
    marked = narrow.join(again, "digest", "left")
    revisit = F.coalesce(F.col("many"), F.lit(False)) & ~F.col("id").eqNullSafe(F.col("first"))
    marked.select("digest", _header(F.col("id"), F.col("url"), F.col("digest"), F.col("size"), F.col("first"), revisit, date).alias("header")).write.parquet(f"{path}/headers")
    forget(narrow)
    return path


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(digest, payload) of an archive; a payload whose bytes don't have its digest raises."""
    df = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    return df.withColumn("payload", F.when(_digest(F.col("payload")) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload damaged: "), F.col("digest"))).cast("binary")))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(digest, header) of an archive."""
    return spark.read.schema("digest string, header string").parquet(f"{path}/headers")


def _value(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, f"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    return F.when(header.contains(f"\r\n{name}: "), found)


def parsed(records: DataFrame, header_col: str = "header") -> DataFrame:
    """`records` and what their headers say: record_id, target_uri, record_type, refers_to, payload_digest, content_length."""
    h = F.col(header_col)
    number = lambda name: F.regexp_extract(_value(h, name), f"<{_ID}(-?[0-9]+)>", 1)
    id_of = lambda name: F.when(number(name) != "", number(name)).cast("long")
    whole = _value(h, "X-Target-URI-Base64")
    return records.select(
        "*", id_of("WARC-Record-ID").alias("record_id"), F.coalesce(F.decode(F.unbase64(whole), "utf-8"), _value(h, "WARC-Target-URI")).alias("target_uri"), _value(h, "WARC-Type").alias("record_type"),
        id_of("WARC-Refers-To").alias("refers_to"), F.regexp_extract(_value(h, "WARC-Payload-Digest"), "sha256:(.*)", 1).alias("payload_digest"), _value(h, "Content-Length").cast("long").alias("content_length"),
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """(header, digest, payload) of all records of an archive as they were before it: headers joined with the payloads they name.

    A revisit gets the payload of the record it refers to. A header whose payload is missing raises.
    """
    found = headers(spark, path).join(payloads(spark, path), "digest", "left")
    return found.select("header", "digest", F.coalesce("payload", F.raise_error(F.concat(F.lit("no payload "), F.col("digest"))).cast("binary")).alias("payload"))


def write_warc(found: DataFrame, path: str) -> None:
    """Write `records` as WARC files: header, empty line, block, two line ends, one record after the other.

    A revisit's block is empty, as its payload is in the record it refers to. Bytes go through the text sink as they are,
    whose line separator is the end of a record. Number and size of files are those of the partitions.
    """
    block = F.when(_value(F.col("header"), "Content-Length") == "0", F.lit(b"")).otherwise(F.col("payload"))
    found.select(F.concat(F.encode(F.col("header"), "utf-8"), F.encode(F.lit(CRLF), "utf-8"), block).cast("string").alias("value")).write.option("lineSep", RECORD_END).text(path)


def _split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of whole files: each header tells how long its block is, so a block may hold anything."""
    for batch in batches:
        for content in batch.column(0):
            data, at, found = content.as_buffer().to_pybytes(), 0, []
            while at < len(data):
                stop = data.index(b"\r\n\r\n", at) + 2
                head = data[at:stop]
                size = int(next(line for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")).split(b":", 1)[1])
                begin = stop + 2
                if data[begin + size : begin + size + 4] != b"\r\n\r\n":
                    raise ValueError(f"record at byte {at} does not end where its length says")
                found.append((head.decode(), data[begin : begin + size]))
                at = begin + size + 4
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([b for _, b in found], pa.binary())], names=["header", "block"])


def read_warc(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(header, block) of the records of uncompressed WARC files; a file is read by one task."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("content").mapInArrow(_split, "header string, block binary")


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write `pages` to an archive, put its records together again and read them: id_col, payload_bytes, payload_digest, record_type, refers_to, url_col.

    See write_archive for what becomes of nulls, repeated rows and empty tables. A header that names another payload than
    the one it is stored with raises.
    """
    found = parsed(records(pages.sparkSession, write_archive(pages, id_col=id_col, url_col=url_col, payload_col=payload_col)))
    kept = F.when(F.col("digest") == F.col("payload_digest"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("not the payload of its header: "), F.col("digest"))))
    return found.select(F.col("record_id").alias(id_col), F.octet_length("payload").cast("long").alias("payload_bytes"), kept.alias("payload_digest"), "record_type", "refers_to", F.col("target_uri").alias(url_col))
