"""How far the sources of a language are from each other in their words, and which words set a source apart."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackworks.llm.shared import slices, stored
from trackworks.llm.tallies import Tally

#: What lies between terms: all ASCII but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: A term counts if it is in at least so many documents of its language.
LEAST_DOCS = 10
#: Shares are whole numbers of this, after so much is added to each count.
SCALE, ADDED = 10**9, 2
#: Terms and sources of a shard of merged counts, on average: what one task compares at a time.
SHARD_TERMS, SHARD_SOURCES = 2048, 128
#: Bytes of text that one round of Arrow kernels works on; a longer text is worked on alone.
ROUND_BYTES = 1 << 21
#: Groups (language and source) up to which their totals are broadcast; more are joined.
BROADCAST_GROUPS = 200_000

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def count_terms(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of some documents: occurrences and documents of each term; a row without term for each group."""
    lang, source = (batch.column(batch.schema.get_field_index(c)).dictionary_encode() for c in ("lang", "source"))
    group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(zero_copy_only=False)
    lists = pc.split_pattern_regex(pc.ascii_lower(batch.column(batch.schema.get_field_index("text"))), BETWEEN)
    words, row = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.not_equal(words, "")
    words, row = words.filter(full).dictionary_encode(), row.filter(full)
    by_doc = pa.table({"row": row, "term": words.indices}).group_by(["row", "term"]).aggregate([([], "count_all")])
    own = pa.table({"group": group[by_doc["row"].to_numpy()], "term": by_doc["term"], "n": by_doc["count_all"]}).group_by(["group", "term"]).aggregate([("n", "sum"), ("n", "count")])
    seen = np.unique(group)
    at = np.concatenate([own["group"].to_numpy(), seen])
    term = pa.concat_arrays([words.dictionary.take(own["term"].combine_chunks()), pa.nulls(len(seen), pa.string())])
    none = np.zeros(len(seen), np.int64)
    return pa.table(
        [lang.dictionary.take(pa.array(at // len(source.dictionary))), source.dictionary.take(pa.array(at % len(source.dictionary))), term, np.append(own["n_sum"].to_numpy(), none), np.append(own["n_count"].to_numpy(), none)],
        schema=_COUNTS,
    )


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = Tally(["n", "docs"])
    for batch in slices(batches, "text", ROUND_BYTES):
        yield from tally.add(count_terms(batch))
    yield from tally.rest()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, n_lang, once): counts of the kept terms of each language by source, and a row without term for each group.

    n_lang is the term's count in the language, `once` marks one row of each of its terms. Partial counts of the tasks are
    dealt by language and term, which serves sums by source and by language: one shuffle. A term has as many rows there as
    sources and tasks, however often it occurs.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    parts = rows.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint").repartition("lang", "term")
    merged = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    first = F.row_number().over(term.orderBy("source")) == 1
    found = merged.withColumns({"_docs": F.sum("docs").over(term), "n_lang": F.sum("n").over(term), "once": first})
    return found.filter(F.col("term").isNull() | (F.col("_docs") >= least_docs)).select("lang", "source", "term", "n", "n_lang", "once")


def _share(n: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(SCALE * (n + ADDED) / (total + ADDED * terms)); the product is a decimal, as it may pass 64 bits."""
    whole = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")
    up, down = F.lit(SCALE).cast("decimal(10,0)") * (whole(n) + ADDED).cast("decimal(20,0)"), (whole(total) + ADDED * whole(terms)).cast("decimal(20,0)")
    return 1 + F.call_function("div", up, down)


def _distance(p: Column | str, q: Column | str) -> Column:
    p, q = (F.col(c) if isinstance(c, str) else c for c in (p, q))
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(n: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """As `_share`, by long division in steps of 1000, so that nothing passes 64 bits."""
    left, down, out = n + ADDED, total + ADDED * terms, np.zeros(np.broadcast(n, total).shape, np.int64)
    steps, scale = 0, SCALE
    while scale > 1:
        scale //= 1000
        steps += 1
    out, left = np.divmod(left, down)
    for _ in range(steps):
        q, left = np.divmod(left * 1000, down)
        out = out * 1000 + q
    return out + 1


def _compared(t: pa.Table) -> pa.Table:
    """Sums of distances over a shard's terms, for all pairs of its sources, both ways round.

    Rows without term are the shard's sources, with their totals and the shard's number of terms; side 0 is compared with
    itself, 1 with 2. Terms that no source of the shard has are alike for all: they are counted, not laid out.
    """
    frame = t.filter(pc.is_null(t["term"])).sort_by("source")
    lang, v, in_shard = frame["lang"][0].as_py(), frame["terms"][0].as_py(), frame["in_shard"][0].as_py()
    side, names, total = frame["side"].to_numpy(), frame["source"].combine_chunks(), frame["total"].to_numpy()
    cells = t.filter(pc.is_valid(t["term"]))
    term = cells["term"].combine_chunks().dictionary_encode()
    n = np.zeros((len(names), len(term.dictionary) + 1), np.int64)  # the last column is a term that none has
    n[pc.index_in(cells["source"].combine_chunks(), names).to_numpy(zero_copy_only=False), term.indices.to_numpy(zero_copy_only=False)] = cells["n"].to_numpy()
    times = np.ones(n.shape[1], np.int64)
    times[-1] = in_shard - len(term.dictionary)
    p = shares(n, total[:, None], v) if v else np.ones_like(n)
    one, two, value = [], [], []
    for i in np.flatnonzero(side != 2):
        js = np.flatnonzero(side == 2) if side[i] == 1 else np.arange(i + 1, len(names))
        d = p[js] - p[i]
        one.append(np.full(len(js), i))
        two.append(js)
        value.append((d * d // (p[js] + p[i])) @ times)
    a, b, value = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (one, two, value))
    return pa.table({"lang": pa.array([lang] * 2 * len(a), pa.string()), "source": names.take(pa.array(np.append(a, b))), "item": names.take(pa.array(np.append(b, a))), "value": np.append(value, value)})


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top_terms: int = 10, shard_terms: int = SHARD_TERMS, shard_sources: int = SHARD_SOURCES) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for each source of each language.

    part `pair`: item is every other source of the language, value their distance in the language's kept terms. part
    `term`: the top_terms terms that are more frequent in the source than in its language, value the term's distance.
    Ranks count from 1 by value, largest first, then item by bytes. A term is a run of letters and non-ASCII characters, A-Z
    in lower case; kept if least_docs documents of the language have it. All counts, shares and sums are exact integers.

    Null text, lang and source are empty ones; a document without terms still makes its group. Rows that repeat are
    documents that repeat. Texts of any length are read whole. A language of one source has no pairs; one without kept terms
    has pairs of value 0. An empty table gives none. Other columns play no part.

    Merged counts are compared in shards of some terms and some sources (more sources are tiles of pairs), so that a
    language with most rows or sources is many tasks; only the pairs themselves, which are the result, grow as a square.
    """
    counts = stored(term_counts(docs, lang_col, source_col, text_col, least_docs), "term-counts")
    totals = counts.groupBy("lang", "source").agg(F.coalesce(F.sum(F.when(F.col("term").isNotNull(), F.col("n"))), F.lit(0)).alias("total"), F.sum(F.when(F.col("term").isNotNull() & F.col("once"), 1).otherwise(0)).alias("_own"), F.sum("n").alias("_n"))
    by_lang = totals.groupBy("lang").agg(F.sum("_own").alias("terms"), F.sum("_n").alias("lang_total"), F.count(F.lit(1)).alias("_sources"))
    groups = totals.join(by_lang, "lang").select(
        "lang", "source", "total", "terms", "lang_total",
        F.greatest(F.lit(1), F.ceil(F.col("terms") / shard_terms)).cast("int").alias("parts"), F.ceil(F.col("_sources") / shard_sources).cast("int").alias("tiles"),
    )
    groups = stored(groups, "term-groups")
    known = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    cells = counts.filter("term is not null").join(known, ["lang", "source"])

    up, down = _share("n", "total", "terms"), _share("n_lang", "lang_total", "terms")
    apart = cells.select("lang", "source", F.col("term").alias("item"), up.alias("p"), down.alias("q")).filter("p > q").select("lang", "source", F.lit("term").alias("part"), "item", _distance("p", "q").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    apart = apart.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top_terms)

    shard = F.pmod(F.xxhash64("term"), F.col("parts")).cast("int").alias("shard")
    tile = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")

    def dealt(df: DataFrame) -> DataFrame:
        x = df.select("*", tile.alias("own"), other)
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        return x.select("lang", "shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "source", "term", "n", "total", "terms", "in_shard")

    sizes = cells.filter("once").groupBy("lang", shard).agg(F.count(F.lit(1)).alias("in_shard"))
    frames = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(sizes, ["lang", "shard"], "left").withColumns({"in_shard": F.coalesce("in_shard", F.lit(0)), "term": F.lit(None).cast("string"), "n": F.lit(None).cast("long")})
    filled = dealt(cells.withColumns({"shard": shard, "in_shard": F.lit(None).cast("long")})).unionByName(dealt(frames))
    sums = filled.groupBy("lang", "shard", "i", "j").applyInArrow(_compared, "lang string, source string, item string, value bigint")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(ranked)).withColumn("part", F.lit("pair"))
    return pairs.select("lang", "source", "part", "item", "value", "rank").unionByName(apart)
