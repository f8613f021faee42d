"""Runs, segments, intervals and windows over per-key ordered rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from trackworks.operators import ranges
from trackworks.sources.scratch import kept


def _chunk(at: str, size: int | None) -> Column:
    return F.floor(F.col(at) / (size or ranges.CHUNK))


#: How the folds of spans that become one are merged, by the kind of the fold.
_MERGES = {"sum": F.sum, "max": F.max, "min": F.min, "any": F.bool_or}


def _unions(df: DataFrame, key: str, start: Column, end: Column, begins: Callable[[Column, Column], Column], chunk: int | None, **folds: tuple[str, Column]) -> DataFrame:
    """Groups of spans: key, start, end (the least and the largest), and folds name=(sum, max, min or any, expression).

    A span starts a group where `begins` (of its start and of the largest end before it) holds or nothing is before it;
    `begins` must go on holding as starts grow. Spans are put together within chunks of starts, and what is left is written,
    so the spans themselves are read and sorted once. A chunk's largest end and last start are one row; the rows of the
    chunks before it tell which of its groups go on one that was open.
    """
    x = df.select(key, start.alias("start"), end.alias("end"), *[e.alias(n) for n, (_, e) in folds.items()]).withColumn("_chunk", _chunk("start", chunk))
    near = Window.partitionBy(key, "_chunk").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    is_first = lambda before: F.coalesce(begins(F.col("start"), F.col(before)), F.lit(True))
    x = x.withColumn("_before", F.max("end").over(near)).withColumn("_first", is_first("_before").cast("int"))
    x = x.withColumn("_group", F.sum("_first").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    merges = [F.min("start").alias("start"), F.max("end").alias("end"), *[_MERGES[kind](n).alias(n) for n, (kind, _) in folds.items()]]
    part = kept(x.groupBy(key, "_chunk", "_group").agg(*merges).drop("_group"))
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row a chunk
    chunks = part.groupBy(key, "_chunk").agg(F.max("start").alias("start"), F.max("end").alias("_end")).withColumn("_before", F.max("_end").over(earlier))
    chunks = chunks.withColumn("_open", F.last(F.when(is_first("_before"), F.col("start")), True).over(earlier))
    y = part.alias("a").join(chunks.alias("b"), ranges.same([key, "_chunk"], "a", "b")).select("a.*", "b._before", "b._open")
    return y.groupBy(key, F.when(is_first("_before"), F.col("start")).otherwise(F.col("_open")).alias("_group")).agg(*merges).drop("_group")


def runs(df: DataFrame, key: str, idx: str, flag: Column, chunk: int | None = None, **folds: tuple[str, Column]) -> DataFrame:
    """Maximal runs of consecutive idx where flag holds: key, start, end (exclusive), and folds name=(kind, expression) over the run's rows.

    Rows are put together in chunks of `chunk` positions, so a long file is many tasks; runs over a chunk's end stay whole.
    """
    return _unions(df.filter(flag), key, F.col(idx), F.col(idx) + 1, lambda s, before: s > before, chunk, **folds)


def hysteresis_segments(df: DataFrame, key: str, idx: str, level: str, open_at: float, close_at: float, chunk: int | None = None) -> DataFrame:
    """Runs above close_at that hold at least one level at or above open_at."""
    return runs(df, key, idx, F.col(level) > close_at, chunk, _opens=("any", F.col(level) >= open_at)).filter("_opens").drop("_opens")


def bridged(df: DataFrame, key: str, min_gap: float, chunk: int | None = None) -> DataFrame:
    """Sorted, disjoint spans with gaps shorter than min_gap closed."""
    return _unions(df, key, F.col("start"), F.col("end"), lambda s, before: s - before >= min_gap, chunk)


def merged(df: DataFrame, key: str, chunk: int | None = None) -> DataFrame:
    """Union of spans in any order: overlapping and touching ones become one."""
    return _unions(df, key, F.col("start"), F.col("end"), lambda s, before: s > before, chunk)


def with_tails(df: DataFrame, key: str, margin: float, limit: str, chunk: int | None = None) -> DataFrame:
    """Spans whose ends are moved by margin, not past the key's limit, and merged again."""
    return merged(df.withColumn("end", F.least(F.col("end") + margin, F.col(limit))), key, chunk)


def segments(df: DataFrame, key: str, idx: str, level: str, open_at: float, close_at: float, min_gap: int, min_len: int, margin: int, chunk: int | None = None) -> DataFrame:
    """Activity segments of level envelopes: hysteresis, bridging, least length, tails; a long file is scanned in chunks."""
    n = df.groupBy(key).agg((F.max(idx) + 1).alias("_n"))
    s = hysteresis_segments(df, key, idx, level, open_at, close_at, chunk)
    s = bridged(s, key, min_gap, chunk).filter(F.col("end") - F.col("start") >= min_len).join(n, key)
    return with_tails(s, key, margin, "_n", chunk)


def segment_rows(seg: DataFrame, df: DataFrame, key: str, idx: str, level: str, chunk: int | None = None) -> DataFrame:
    """Segments with their number and the mean and peak level of their blocks.

    Blocks find their segment as the last one before them in a union, in chunks: no range join is made.
    """
    u = df.select(key, F.col(idx).alias("_at"), F.col(level).alias("_v"), F.lit(None).cast("long").alias("_s"), F.lit(None).cast("long").alias("_e"), F.lit(1).alias("_o")).unionByName(
        seg.select(key, F.col("start").alias("_at"), F.lit(None).cast("double").alias("_v"), F.col("start").cast("long").alias("_s"), F.col("end").cast("long").alias("_e"), F.lit(0).alias("_o"))
    )
    x = ranges.carried(u, key, ["_at", "_o"], _chunk("_at", chunk), start=("last", F.col("_s")), end=("last", F.col("_e")))
    rows = kept(x.filter("_o = 1 and _at < end").groupBy(key, "start", "end").agg(F.avg("_v").alias("mean_level"), F.max("_v").alias("peak_level")))
    return ranges.carried(rows, key, ["start"], _chunk("start", chunk), inclusive=False, seg_idx=("sum", F.lit(1))).na.fill({"seg_idx": 0})


def rests(seg: DataFrame, key: str, chunk: int | None = None) -> DataFrame:
    """Gaps between a key's segments."""
    x = ranges.carried(seg, key, ["start"], _chunk("start", chunk), inclusive=False, _before=("last", F.col("end")))
    return x.filter("_before is not null").select(key, F.col("_before").alias("start"), F.col("start").alias("end"), (F.col("start") - F.col("_before")).alias("gap"))


def longest_run(df: DataFrame, key: str, idx: str, flag: Column, chunk: int | None = None) -> DataFrame:
    """The longest run where flag holds and the share of such rows; 0 where there is none."""
    r = runs(df, key, idx, flag, chunk).groupBy(key).agg(F.max(F.col("end") - F.col("start")).alias("longest"))
    share = df.groupBy(key).agg(F.avg(F.coalesce(flag, F.lit(False)).cast("double")).alias("share"))
    return share.join(r, key, "left").na.fill({"longest": 0})


def sliding(df: DataFrame, key: str, idx: str, k: int, chunk: int | None = None, **aggs: Callable[[WindowSpec], Column]) -> DataFrame:
    """Aggregates over each full window of k consecutive rows, named by its first row: start, and aggs (function of the window).

    A chunk of positions also holds the k - 1 rows after it, so a long file is many tasks. Positions are whole numbers without gaps.
    """
    w = Window.partitionBy(key, "_chunk").orderBy(idx).rowsBetween(0, k - 1)
    x = ranges.nearby(df, key, idx, 0, k - 1, chunk)
    x = x.select(key, F.col(idx).alias("start"), "_own", *[f(w).alias(n) for n, f in aggs.items()], F.count(F.lit(1)).over(w).alias("_n"))
    return x.filter((F.col("_n") == k) & F.col("_own")).drop("_n", "_own")


def _next_pick(df: DataFrame, key: str, at: str, order: list, r: int, min_gap: float, wanted: Column | None = None) -> DataFrame:
    """The first row in `order` without a `_pick` gets pick r, and rows without one that are closer than min_gap to it go.

    All rounds use one partitioning and sorting of the rows, so they cost one shuffle together.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    free = F.col("_pick").isNull() if wanted is None else F.col("_pick").isNull() & wanted
    x = df.withColumn("_now", F.first(F.when(free, F.col(at)), ignorenulls=True).over(w))
    x = x.withColumn("_pick", F.when(F.col("_pick").isNull() & (F.col(at) == F.col("_now")), F.lit(r)).otherwise(F.col("_pick")))
    return x.filter(F.col("_pick").isNotNull() | F.col("_now").isNull() | (F.abs(F.col(at) - F.col("_now")) >= min_gap)).drop("_now")


def greedy_spaced(df: DataFrame, key: str, at: str, rank: str, n: int, min_gap: float) -> DataFrame:
    """By key the n best-ranked positions that are at least min_gap apart, taken greedily: key, pick (from 0), at.

    A round for each pick: the best candidate left, then those within the gap go. No candidate is cut before.
    """
    x = df.select(key, F.col(at).cast("double").alias(at), rank, F.lit(None).cast("int").alias("_pick"))
    for r in range(n):
        x = _next_pick(x, key, at, [rank, at], r, min_gap)
    return x.filter("_pick is not null").groupBy(key, F.col("_pick").alias("pick")).agg(F.min(at).alias(at))


def top_by(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows by key in a total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def mean_step(df: DataFrame, key: str, idx: str, value: str, chunk: int | None = None) -> DataFrame:
    """Mean absolute difference of successive values."""
    x = ranges.carried(df, key, [idx], _chunk(idx, chunk), inclusive=False, _before=("last", F.struct(F.col(value).alias("v"))))
    d = x.withColumn("_d", F.abs(F.col(value) - F.col("_before.v")))
    return d.groupBy(key).agg(F.avg("_d").alias("mean_step"))


def filled_forward(df: DataFrame, key: str, idx: str, value: Column, out: str, chunk: int | None = None) -> DataFrame:
    """`df` with the last value that isn't null up to each row, carried from chunk to chunk."""
    return ranges.carried(df, key, [idx], _chunk(idx, chunk), **{out: ("last", value)})


def window_energy(df: DataFrame, key: str, idx: str, energy: Column, k: int, chunk: int | None = None) -> DataFrame:
    """Energy of each window of k rows, named by its first, where k more rows follow it: key, start, energy.

    A prefix sum, carried from chunk to chunk, is taken from the one k rows later. Positions are whole numbers without gaps.
    """
    p = ranges.carried(df.select(key, idx, energy.alias("_e")), key, [idx], _chunk(idx, chunk), inclusive=False, _c=("sum", F.col("_e")))
    p = p.withColumn("_c", F.coalesce("_c", F.lit(0)))
    near = Window.partitionBy(key, "_chunk").orderBy(idx)
    x = ranges.nearby(p, key, idx, 0, k, chunk).withColumn("energy", F.lead("_c", k).over(near) - F.col("_c"))
    return x.filter("_own and energy is not null").select(key, F.col(idx).alias("start"), "energy")


def edge_silence(df: DataFrame, key: str, idx: str, active: Column) -> DataFrame:
    """Blocks before the first and after the last active one; all of them where none is."""
    g = df.groupBy(key).agg(F.min(F.when(active, F.col(idx))).alias("a"), F.max(F.when(active, F.col(idx))).alias("b"), F.count(F.lit(1)).alias("n"))
    return g.select(key, F.coalesce(F.col("a"), F.col("n")).alias("head"), F.coalesce(F.col("n") - 1 - F.col("b"), F.col("n")).alias("tail"))


def coverage(spans: DataFrame, key: str, window: float) -> DataFrame:
    """Share of each tumbling window that a key's disjoint spans cover; only windows with some: a span that ends where one begins isn't in it."""
    w = F.explode(F.sequence(F.floor(F.col("start") / window).cast("long"), F.floor(F.col("end") / window).cast("long")))
    x = spans.filter("end > start").select(key, "start", "end", w.alias("window"))
    part = F.least("end", (F.col("window") + 1) * window) - F.greatest("start", F.col("window") * window)
    return x.filter(part > 0).groupBy(key, "window").agg((F.sum(part) / window).alias("cov"))


def stratified_picks(df: DataFrame, key: str, at: str, score: str, low: float, high: float, bins: int, min_gap: float) -> DataFrame:
    """By key the best position of each equal bin of [low, high), filled up to `bins` with others at least min_gap from all picks.

    Columns: key, at, filled (false for a bin's own best). A key with fewer picks than bins has unfilled ones. All other
    positions are candidates to fill with, best first, in a round for each bin but one.
    """
    width = (high - low) / bins
    x = df.filter((F.col(at) >= low) & (F.col(at) < high)).select(key, F.col(at).cast("double").alias(at), score, F.floor((F.col(at) - low) / width).alias("_b"))
    order = [F.col(score).desc(), F.col(at)]
    whole = Window.partitionBy(key)
    x = x.withColumn("_first", F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order)) == 1)
    x = x.withColumn("_best", F.collect_list(F.when(F.col("_first"), F.col(at))).over(whole))  # one a bin
    x = x.filter(F.col("_first") | ~F.exists("_best", lambda y: F.abs(y - F.col(at)) < min_gap)).withColumn("_pick", F.when(F.col("_first"), F.lit(0)))
    for r in range(1, bins):
        x = _next_pick(x, key, at, order, r, min_gap, F.size("_best") + r <= bins)
    # distinct positions have distinct picks, but for bins' own
    return x.filter("_pick is not null").groupBy(key, at).agg((F.max("_pick") > 0).alias("filled"))


def covering_picks(df: DataFrame, item: str, cls: str, least: int, store: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """Items picked one at a time until each class has `least` picked items that hold it (or all it has), scarcest class first.

    Of the items that hold the scarcest class still short, that with most classes short is next, then the smallest id.
    Items with the same classes differ by id only, so they are grouped first, and of each group as many of the smallest
    ids are kept as picks can be made: classes x least. `store` keeps this table. How many short classes a group holds only
    changes when a class has enough, so a round takes the best rows for the scarcest class (as many as it needs) and picks
    them in order up to the one that gives some class enough: at most a round a class. Class counts and a round's rows, no
    more than `least`, come to the driver.
    """
    df = df.select(item, cls).distinct()
    have = {r[cls]: r["n"] for r in df.groupBy(cls).agg(F.count(F.lit(1)).alias("n")).collect()}
    need = {c: min(least, n) for c, n in have.items()}
    most = sum(need.values())
    sets = df.groupBy(item).agg(F.array_sort(F.collect_set(cls)).alias("_set")).withColumn("_deal", F.pmod(F.xxhash64(item), F.lit(64)))
    few = top_by(top_by(sets, ["_set", "_deal"], [F.col(item)], most), ["_set"], [F.col(item)], most)  # a large group is cut in parts first
    groups = store(few.groupBy("_set").agg(F.array_sort(F.collect_list(item)).alias("_ids")))
    picked: list = []
    taken: dict[tuple, int] = {}
    while short := sorted((c for c in need if need[c] > 0), key=lambda c: (have[c], str(c))):
        left = groups.filter(F.array_contains("_set", short[0]))
        used = F.create_map(*[e for s, k in taken.items() for e in (F.array(*map(F.lit, s)), F.lit(k))]) if taken else F.lit(None)  # at most an entry a pick
        ids = F.slice("_ids", (F.coalesce(F.element_at(used, F.col("_set")), F.lit(0)) if taken else F.lit(0)) + 1, F.lit(need[short[0]]))
        rows = left.select("_set", F.explode(ids).alias("_id"), F.size(F.array_intersect("_set", F.array(*[F.lit(c) for c in short]))).alias("_n"))
        for row in rows.orderBy(F.col("_n").desc(), "_id").limit(need[short[0]]).collect():
            picked.append(row["_id"])
            taken[tuple(row["_set"])] = taken.get(tuple(row["_set"]), 0) + 1
            for c in row["_set"]:
                need[c] -= 1
            if any(need[c] == 0 for c in row["_set"]):
                break
    return df.sparkSession.createDataFrame([(p, k) for k, p in enumerate(picked)], f"{item} {df.schema[item].dataType.simpleString()}, pick int")
