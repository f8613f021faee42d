"""Site-relative line deduplication with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackworks.llm.shared import own_name, stored

#: A line of a page is boilerplate if more than this share of the site's other pages has it too.
MAX_SHARE = 0.02
#: Boilerplate lines of all sites (16 bytes each) up to which they are broadcast; more are joined by site.
BROADCAST_LINES = 500_000
#: Lines that a look-up compares with on average.
_PER_BUCKET = 4


def _key(line: Column) -> Column:
    """128 bits for a line without outer white space."""
    trimmed = F.trim(line)
    return F.struct(F.xxhash64(trimmed).alias("a"), F.xxhash64(F.lit(1), trimmed).alias("b"))


def boilerplate_lines(docs: DataFrame, site_col: str, text_col: str = "text", max_share: float = MAX_SHARE, copies_once: bool = False) -> DataFrame:
    """(site, line): keys of each site's lines that, of the pages other than one that has it, more than `max_share` have too.

    So the ratio stands alone at any size: a site's only page loses nothing, as no other page could share its lines.
    Pages of a site are all its rows, or with `copies_once` its different texts (by 128 bits of the whole text); a line
    counts once a page. Lines are hashed before they are shuffled and counted before and after, so a site with most
    pages is as many small sums. Rows without a site are one of their own; null and empty texts are pages without lines.
    A site has at most its mean number of different lines a page, divided by max_share, of such lines.
    """
    pages = docs.select(F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    page = [F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")).alias("page")] if copies_once else []
    once = (lambda df: df.distinct()) if copies_once else (lambda df: df)
    totals = once(pages.select("site", *page)).groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    line = F.explode(F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), _key)))
    counts = once(pages.select("site", *page, line.alias("line"))).groupBy("site", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)  # a line of one page is no other page's
    return counts.join(totals, "site").filter(F.col("n") - 1 > max_share * (F.col("pages") - 1)).select("site", "line")


def _tables(found: DataFrame) -> DataFrame:
    """(site, lines): an array of buckets for each site, so that a look-up compares with a few lines and not with all."""
    sizes = found.groupBy("site").agg(F.ceil(F.count(F.lit(1)) / _PER_BUCKET).cast("int").alias("buckets"))
    own = found.join(sizes, "site").select("site", F.pmod(F.col("line.a"), F.col("buckets")).cast("int").alias("bucket"), "line")
    every = sizes.select("site", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), F.lit(None).cast(found.schema["line"].dataType).alias("line"))
    by_bucket = own.unionByName(every).groupBy("site", "bucket").agg(F.collect_list("line").alias("lines"))  # nulls aren't collected
    return by_bucket.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "lines"))), lambda x: x["lines"]).alias("lines"))


def without_boilerplate(docs: DataFrame, site_col: str, text_col: str = "text", max_share: float = MAX_SHARE, removed: str | None = None, broadcast_lines: int = BROADCAST_LINES, copies_once: bool = False) -> DataFrame:
    """`docs` with each site's boilerplate lines taken out of every text, whatever is left of it; no row goes.

    With `copies_once` exact copies count as one page, so that their number alone makes no line frequent.

    Lines end at a line feed and are compared without outer spaces; blank lines stay. The other lines keep their order.
    A null text stays null, an empty one empty; rows without a site are a site of their own. Rows that repeat are pages
    that repeat. A text or line of any length is read whole. An empty table gives an empty table. `removed` names a
    further column for the number of lines taken out. Other columns stay as they are, whatever their names.

    The lines found are written first, so that their number is known: up to BROADCAST_LINES they are broadcast and texts
    aren't shuffled; beyond it they are joined by site, where adaptive execution splits a hot one.
    """
    site, lines = own_name(docs, "site_key"), own_name(docs, "site_lines")
    found = stored(boilerplate_lines(docs, site_col, text_col, max_share, copies_once), "boilerplate")
    tables = _tables(found).select(F.col("site").alias(site), F.col("lines").alias(lines))
    if found.count() <= broadcast_lines:
        tables = F.broadcast(tables)
    df = docs.withColumn(site, F.coalesce(F.col(site_col).cast("string"), F.lit(""))).join(tables, site, "left")
    said = F.split(F.col(text_col), "\n")
    kept = own_name(df, "kept_lines")

    def is_boilerplate(x: Column) -> Column:
        return F.array_contains(F.get(F.col(lines), F.pmod(F.xxhash64(F.trim(x)), F.size(lines)).cast("int")), _key(x))

    df = df.withColumn(kept, F.when(F.col(lines).isNotNull(), F.filter(said, lambda x: (F.trim(x) == "") | ~is_boilerplate(x))))
    cut = F.col(kept).isNotNull() & (F.size(kept) < F.size(said))
    names = [F.when(cut, F.array_join(kept, "\n")).otherwise(F.col(text_col)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if removed:
        names.append(F.when(cut, F.size(said) - F.size(kept)).otherwise(0).cast("long").alias(own_name(docs, removed)))
    return df.select(*names)
