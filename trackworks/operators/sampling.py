"""Hash-driven sampling: every draw is a number from md5 of seed, key and stage, so any partitioning gives the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackworks.operators.columns import draw
from trackworks.operators.ranges import ranked_draws
from trackworks.operators.signals import vector_sum
from trackworks.sources.scratch import kept


def stratified_split(df: DataFrame, key: str, stratum: str, seed: int, share: float = 0.1) -> DataFrame:
    """train, val and test by stratum: a rounded share each for val and test, at least 1 where a stratum has more than 2 rows."""
    u = ranked_draws(df, stratum, draw(seed, F.col(key), "split"), key)
    nv = F.least(F.greatest(F.lit(1.0), F.bround(F.col("_total") * F.lit(share))), F.col("_total") - 2)
    return u.withColumn("split", F.when(F.col("_rank") <= nv, "val").when(F.col("_rank") <= 2 * nv, "test").otherwise("train")).drop("_rank", "_total")


def quota_sample(df: DataFrame, key: str, stratum: str, seed: int, total: int, least: int) -> DataFrame:
    """At least `least` rows of each stratum (or all it has), and for the rest of `total` a share in proportion."""
    c = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    s = c.agg(F.sum("_n").alias("_t"))
    c = c.join(F.broadcast(s)).select(stratum, F.least(F.col("_n"), F.greatest(F.lit(least), F.floor(F.col("_n") * total / F.col("_t")))).alias("_q"))  # one row of totals
    r = ranked_draws(df.join(c, stratum), stratum, draw(seed, F.col(key), "quota"), key, most=F.col("_q"))
    return r.filter("_rank <= _q").drop("_rank", "_total", "_q")


def round_robin(df: DataFrame, key: str, stratum: str, seed: int, n: int, cap: int) -> DataFrame:
    """n rows, one of each stratum in turn, no more than cap of one."""
    r = ranked_draws(df, stratum, draw(seed, F.col(key), "turn"), key, most=F.lit(cap)).withColumnRenamed("_rank", "turn").drop("_total")
    return r.filter(F.col("turn") <= cap).orderBy("turn", stratum).limit(n)


def weighted_span(spans: DataFrame, keys: list[str], start: str, end: str, u: Column) -> DataFrame:
    """By keys the span that holds the u-th part of all the spans' length, and the offset within it: draws in proportion to length."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    x = spans.withColumn("_len", F.col(end) - F.col(start)).withColumns({
        "_before": F.coalesce(F.sum("_len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_total": F.sum("_len").over(Window.partitionBy(*keys)),
    })
    at = u * F.col("_total")
    return x.withColumns({"_at": at}).filter((F.col("_at") >= F.col("_before")) & (F.col("_at") < F.col("_before") + F.col("_len"))).withColumn("offset", F.col("_at") - F.col("_before")).drop("_len", "_before", "_total", "_at")


def clamped_window(start: Column, offset: Column, length: float, end: Column) -> Column:
    """A window's start around start + offset, moved so that it stays between 0 and end."""
    return F.greatest(F.lit(0.0), F.least(start + offset - length / 2, end - length))


def distinct_classes(items: DataFrame, item: str, n: str, classes: DataFrame, cls: str, seed: int) -> DataFrame:
    """For each item n of the classes without replacement; classes are a small fixed list, dealt as one array."""
    names = F.array_sort(F.collect_list(cls))
    pool = classes.agg(names.alias("_pool"))
    x = items.join(F.broadcast(pool)).select(*items.columns, F.explode("_pool").alias(cls))  # one row, the list of classes
    key = F.concat_ws(":", F.col(item).cast("string"), F.col(cls))
    return x.withColumn("_r", F.row_number().over(Window.partitionBy(item).orderBy(draw(seed, key, "class"), cls))).filter(F.col("_r") <= F.col(n)).withColumn("slot", F.col("_r") - 1).drop("_r")


def coherent_count(p: float, n: Column, u: Column) -> Column:
    """floor(p n) plus a coin for the rest; a single coherent slot is none or two, as u falls."""
    k = F.floor(p * n) + (u < (p * n - F.floor(p * n))).cast("int")
    return F.when(k == 1, F.when((n >= 2) & (u < 0.5), 2).otherwise(0)).otherwise(k)


def banded(df: DataFrame, value: str, bands: list[tuple[str, float, float | None]]) -> DataFrame:
    """Rows with their band [low, high); the last band is open-ended; a gap between bands raises."""
    for (a, _, high), (b, low, _) in zip(bands, bands[1:], strict=False):
        if high != low:
            raise ValueError(f"bands {a} and {b} leave a gap or overlap")
    if bands[-1][2] is not None:
        raise ValueError("the last band must be open-ended")
    c = F.lit(None).cast("string")
    for name, low, high in bands:
        inside = F.col(value) >= low if high is None else (F.col(value) >= low) & (F.col(value) < high)
        c = F.when(inside, F.lit(name)).otherwise(c)
    return df.withColumn("band", c)


def normal(u: Column, v: Column) -> Column:
    """A standard normal from two uniform draws."""
    return F.sqrt(-2.0 * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(2.0 * 3.141592653589793 * v)


def _anchor_choice(sets: DataFrame, pairs: DataFrame, held: DataFrame, mode: str) -> DataFrame:
    """(set, slot, song, total): songs that can anchor a set of classes, each in as many slots as its weight.

    sets: set (text), left (array). pairs: song, class_a, class_b of its anchors, held: song, class; no row twice. A song
    can if it has an anchor of two of the set's classes. Its weight is 1, or its classes in the set (overlap_weighted), or 1
    for songs with most of them and 0 for others (greedy).
    """
    eligible = _fitting(sets, pairs).select("set", "song").distinct()
    if mode == "uniform":
        x = eligible.withColumn("w", F.lit(1))
    else:
        x = eligible.join(sets.select("set", F.explode("left").alias("class")), "set").join(held, ["song", "class"]).groupBy("set", "song").agg(F.count(F.lit(1)).cast("int").alias("w"))
        if mode == "greedy":
            x = x.withColumn("w", (F.col("w") == F.max("w").over(Window.partitionBy("set"))).cast("int")).filter("w = 1")
    at = Window.partitionBy("set").orderBy("song")
    x = x.withColumns({"end": F.sum("w").over(at.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("w").over(Window.partitionBy("set"))})
    return x.select("set", "song", "total", F.explode(F.sequence(F.col("end") - F.col("w"), F.col("end") - 1)).alias("slot"))


def cluster_fill(items: DataFrame, item: str, anchors: DataFrame, spans: DataFrame, seed: int, window: float, mode: str = "uniform", least_cover: float = 0.25, melodic: list[str] | None = None, min_melodic: int = 0, store: Callable[[DataFrame], DataFrame] = kept, tables: bool = False) -> DataFrame:
    """Coherent clusters for items: a row a member (item, cluster, song, start, class, role), and a row a shortfall (item, cluster, reason).

    items: item, `classes` (array, no repeats) and `k`, how many of them clusters are to hold. anchors: song, class_a <
    class_b, start, end of joint activity. spans: song, class, start, end of activity. While two or more are wanted, an
    item draws a song that has an anchor of two of its classes left (`mode`: uniform, overlap_weighted by the song's
    classes among those left, or greedy: one of those with most, and one cluster only), one of the song's anchors of such
    classes in proportion to its length, and a window of `window` seconds within it or around it. All classes left that
    cover more than `least_cover` of the window join; if they are more than wanted they are thinned, min_melodic of
    `melodic` ones being drawn first. A single one still wanted at the end is a spare of the last cluster (role grown), or
    none: reason r1_dropped. Other reasons: no_eligible_anchor, greedy_single_anchor. An anchor counts only if min_melodic
    of its classes are melodic. Every draw is a hash, so partitioning changes nothing.

    Songs are drawn by (set of classes left, slot), so items meet songs by equality; there are as many sets as items have.
    Anchors are only looked at one by one for the songs drawn. `store` keeps the tables that a round and the next ones read,
    so that plans stay short; `tables` says that anchors and spans are stored ones already.
    """
    if mode not in ("uniform", "overlap_weighted", "greedy"):
        raise ValueError(f"mode is uniform, overlap_weighted or greedy, not {mode}")
    tune = (lambda c: c.isin(melodic)) if melodic else (lambda c: F.lit(False))
    if min_melodic:
        anchors = anchors.filter(tune(F.col("class_a")).cast("int") + tune(F.col("class_b")).cast("int") >= min_melodic)
    if not tables:
        anchors, spans = store(anchors), store(spans)
    pairs, held = store(anchors.select("song", "class_a", "class_b").distinct()), store(spans.select("song", "class").distinct())
    ends = spans.groupBy("song").agg(F.max("end").alias("_song_end"))
    state = items.select(item, F.array_sort("classes").alias("left"), F.least(F.col("k"), F.size("classes")).cast("int").alias("need"), F.lit(0).alias("cluster"), F.array().cast("array<string>").alias("spares"), F.lit(None).cast(spans.schema["song"].dataType).alias("song"), F.lit(None).cast("double").alias("start"))
    state = store(state)
    most = state.agg(F.max("need")).first()[0] or 0
    rounds = 1 if mode == "greedy" else most // 2  # a cluster holds two or more
    out = []
    for r in range(rounds):
        active = state.filter("need >= 2").withColumn("set", F.concat_ws("\x1f", "left"))
        sets = active.select("set", "left").distinct()
        choice = store(_anchor_choice(sets, pairs, held, mode))
        totals = choice.select("set", "total").distinct()
        a = active.select(item, "left", "need", "set", "cluster").join(F.broadcast(totals), "set", "left")  # a row a set of classes
        a = a.withColumn("slot", F.floor(draw(seed, F.col(item), f"song{r}") * F.col("total"))).drop("total").join(choice.drop("total"), ["set", "slot"], "left").drop("slot")
        a = store(a)
        mine = a.filter("song is not null")
        # an anchor of the song, in proportion to its length
        drawn = mine.select("set", "left", "song").distinct().join(anchors, "song")
        lengths = drawn.filter(F.array_contains("left", F.col("class_a")) & F.array_contains("left", F.col("class_b"))).withColumn("len", F.col("end") - F.col("start"))
        at = Window.partitionBy("set", "song").orderBy("start", "end", "class_a", "class_b")
        lengths = lengths.withColumns({"upto": F.sum("len").over(at.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("len").over(Window.partitionBy("set", "song"))})
        u = mine.join(lengths.select("set", "song", F.col("start").alias("_s"), F.col("end").alias("_e"), "len", "upto", "all"), ["set", "song"]).withColumn("_t", draw(seed, F.col(item), f"span{r}") * F.col("all"))
        u = u.filter((F.col("_t") >= F.col("upto") - F.col("len")) & (F.col("_t") < F.col("upto"))).join(ends, "song")
        low = F.greatest(F.lit(0.0), F.col("_e") - window)
        high = F.greatest(low, F.least(F.col("_s"), F.greatest(F.lit(0.0), F.col("_song_end") - window)))
        v = draw(seed, F.col(item), f"window{r}")
        start = F.when(F.col("_e") - F.col("_s") >= window, F.col("_s") + v * (F.col("_e") - window - F.col("_s"))).otherwise(low + v * (high - low))
        u = store(u.select(item, "left", "need", "cluster", "song", start.alias("start")))
        # classes left that cover enough of the window; windows and spans meet in stretches of a few of them, which most spans lie within
        long = 8 * window
        stretch = lambda x, y: F.explode(F.sequence(F.floor(x / long), F.floor(y / long))).alias("_b")
        near = u.select(item, "left", "song", "start", stretch(F.col("start"), F.col("start") + window)).join(spans.filter("end > start").select("song", F.col("class"), F.col("start").alias("_s"), F.col("end").alias("_e"), stretch(F.col("start"), F.col("end"))), ["song", "_b"])
        part = F.least("_e", F.col("start") + window, (F.col("_b") + 1) * long) - F.greatest("_s", "start", F.col("_b") * long)
        heard = near.filter(F.array_contains("left", F.col("class"))).groupBy(item, "class").agg(F.sum(F.greatest(part, F.lit(0.0))).alias("_cov")).filter(F.col("_cov") > least_cover * window)
        key = F.concat_ws(":", F.col(item).cast("string"), "class")
        ranked = F.struct(F.lit(1).alias("late"), draw(seed, key, f"thin{r}").alias("u"), F.col("class").alias("class"), tune(F.col("class")).alias("tune"))
        sets_heard = heard.groupBy(item).agg(F.array_sort(F.collect_list(ranked)).alias("_h"))
        x = u.join(sets_heard, item, "left").withColumn("_h", F.coalesce("_h", F.array().cast(sets_heard.schema["_h"].dataType)))
        # the first min_melodic melodic ones come before all others
        first = F.transform(F.slice(F.filter("_h", lambda h: h["tune"]), 1, min_melodic), lambda h: h["class"]) if min_melodic else F.array().cast("array<string>")
        x = x.withColumn("_order", F.array_distinct(F.concat(first, F.transform("_h", lambda h: h["class"])))).withColumn("_members", F.slice("_order", F.lit(1), F.least(F.size("_order"), F.col("need"))))
        x = store(x.drop("_h"))
        out.append(x.select(item, "cluster", "song", "start", F.explode(F.array_sort("_members")).alias("class"), F.lit("member").alias("role"), F.lit(None).cast("string").alias("reason")))
        out.append(_short(a.filter("song is null").select(item, "cluster", F.lit("no_eligible_anchor").alias("reason")), item, spans))
        took = x.select(item, F.array_except("left", "_members").alias("left"), (F.col("need") - F.size("_members")).alias("need"), (F.col("cluster") + 1).alias("cluster"), F.array_except("_order", "_members").alias("spares"), "song", "start")
        state = store(took.unionByName(state.filter("need < 2")))
    one = state.filter("need = 1 and cluster > 0")
    spare = F.get(F.array_sort("spares"), F.floor(draw(seed, F.col(item), "grow") * F.size("spares")).cast("int"))
    grown = one.filter(F.size("spares") > 0)
    out.append(grown.select(item, (F.col("cluster") - 1).alias("cluster"), "song", "start", spare.alias("class"), F.lit("grown").alias("role"), F.lit(None).cast("string").alias("reason")))
    out.append(_short(one.filter(F.size("spares") == 0).select(item, "cluster", F.lit("r1_dropped").alias("reason")), item, spans))
    if mode == "greedy":
        out.append(_short(state.filter("need >= 2 and cluster > 0").select(item, "cluster", F.lit("greedy_single_anchor").alias("reason")), item, spans))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _short(df: DataFrame, item: str, spans: DataFrame) -> DataFrame:
    null = lambda kind: F.lit(None).cast(kind)
    return df.select(item, "cluster", null(spans.schema["song"].dataType).alias("song"), null("double").alias("start"), null("string").alias("class"), null("string").alias("role"), "reason")


def _fitting(sets: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchors of two classes of a set, or songs' pairs of such classes, for each set."""
    own = sets.select("set", F.explode("left").alias("class_a")).join(sets.select("set", F.explode("left").alias("class_b")), "set").filter("class_a < class_b")
    return own.join(anchors, ["class_a", "class_b"])


def realised(picks: DataFrame, blocks: DataFrame, item: str, file: str, length: int, samples: str = "samples", bucket: int | None = None) -> DataFrame:
    """The mixture of an item: windows of `length` samples of its picks' files from `start`, each times `gain`, added up: item, first, samples.

    blocks: file, first (frame of the first sample), samples. Picks meet only blocks of their own stretches of `bucket`
    frames (as long as a window by default), so that a window may span several blocks, no file is put together, and a
    long file is many join keys. What they share is added as pieces of the window, `bucket` samples from its place
    `first`, so no sample becomes a row; samples that no block reaches are 0.
    """
    size = bucket or length
    stretch = lambda at, n: F.explode(F.sequence(F.floor(at / size), F.floor((at + n - 1) / size))).alias("_bucket")
    p = picks.select(item, file, "start", "gain", stretch(F.col("start"), F.lit(length)))
    b = blocks.filter(F.size(samples) > 0).select(file, "first", samples, stretch(F.col("first"), F.size(samples)))
    # a pick and a block may meet in several stretches; the first of them counts
    once = F.col("_bucket") == F.floor(F.greatest("start", "first") / size)
    low, high = F.greatest("first", "start"), F.least(F.col("first") + F.size(samples), F.col("start") + length)
    x = p.join(b, [file, "_bucket"]).filter(once & (low < high)).select(item, "gain", (low - F.col("start")).alias("_at"), F.slice(samples, (low - F.col("first") + 1).cast("int"), (high - low).cast("int")).alias("_x"))
    end = F.col("_at") + F.size("_x")
    x = x.select("*", F.explode(F.sequence(F.floor(F.col("_at") / size), F.floor((end - 1) / size))).alias("_cell"))
    begin = F.col("_cell") * size
    lead = F.greatest(F.lit(0), F.col("_at") - begin).cast("int")
    own = F.slice("_x", (F.greatest(begin, "_at") - F.col("_at") + 1).cast("int"), (F.least(begin + size, end) - F.greatest(begin, "_at")).cast("int"))
    piece = F.concat(F.array_repeat(F.lit(0.0), lead), F.transform(own, lambda v: F.col("gain") * v))
    return vector_sum(x.select(item, begin.alias("first"), piece.alias(samples)), [item, "first"], samples)
