"""Orders that no task holds whole: contiguous parts, exact quantiles, running folds over chunks, ranks of draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackworks.sources.scratch import kept

#: Rows that one task sorts at a time.
PART_ROWS = 1 << 20
#: Rows of a key (blocks of a file) that one window runs over.
CHUNK = 1 << 16
#: Keys up to which one row each is broadcast.
BROADCAST_KEYS = 100_000


def in_parts(df: DataFrame, order: Sequence[str | Column], part_rows: int | None = None, parts: int | None = None) -> DataFrame:
    """`df` with `_part`, the number of the contiguous part of the order that a row is in: parts of about part_rows rows.

    Rows are counted, so the number of parts grows with them, unless it is given. Bounds are over all of `order`, so equal
    values of its first column are split by the next ones. Parts are written, as bounds are only known while rows are dealt.
    """
    df = kept(df)
    parts = parts or -(-df.count() // (part_rows or PART_ROWS))
    if parts <= 1:
        return df.withColumn("_part", F.lit(0))
    return kept(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))


def same(keys: Sequence[str], a: str, b: str) -> Column:
    """Keys of two aliased tables are equal, nulls too."""
    found = F.lit(True)
    for k in keys:
        found = found & F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`"))
    return found


def quantiles(df: DataFrame, keys: Sequence[str], value: str | Column, points: Sequence[float], out: str = "q", part_rows: int | None = None) -> DataFrame:
    """By keys the exact quantiles of a number at `points` (linear interpolation), as an array; nulls don't count.

    Different values are counted and dealt into contiguous parts by key and value; the counts of parts tell which of them
    hold the wanted ranks, and only those are sorted. So a key with most rows, or all rows without keys, is many small
    tasks, and no task keeps a group's values. Keys without values are absent, as is the row of an empty table without keys.
    """
    v = F.col(value) if isinstance(value, str) else value
    counts = df.select(*[F.col(f"`{k}`") for k in keys], v.cast("double").alias("_v")).filter("_v is not null").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranged = in_parts(counts, [*keys, "_v"], part_rows)
    sums = ranged.groupBy(*keys, "_part").agg(F.sum("_n").alias("_sum"))
    at = Window.partitionBy(*keys).orderBy("_part") if keys else Window.orderBy("_part")  # one row a part
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    sums = sums.withColumns({"_upto": F.sum("_sum").over(at.rowsBetween(Window.unboundedPreceding, 0)), "_total": F.sum("_sum").over(whole)})
    place = [F.lit(float(p)) * (F.col("_total") - 1) for p in points]
    ranks = F.array_distinct(F.array(*[c.cast("long") for p in place for c in (F.floor(p), F.ceil(p))]))
    base = F.col("_upto") - F.col("_sum")
    held = sums.select(*keys, "_part", "_total", base.alias("_base"), F.filter(ranks, lambda r: (r >= base) & (r < F.col("_upto"))).alias("_ranks")).filter(F.size("_ranks") > 0)
    own = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    x = ranged.alias("r").join(held.alias("h"), same([*keys, "_part"], "r", "h")).select(*[F.col(f"r.`{k}`") for k in keys], "r._part", "_v", "_n", "_total", "_base", "_ranks")
    x = x.withColumn("_end", F.col("_base") + F.sum("_n").over(own))
    hit = x.withColumn("_ranks", F.filter("_ranks", lambda r: (r >= F.col("_end") - F.col("_n")) & (r < F.col("_end")))).filter(F.size("_ranks") > 0)
    g = hit.select(*keys, "_total", "_v", F.explode("_ranks").alias("_rank")).groupBy(*keys, "_total").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))  # two a point

    def found(p: Column) -> Column:
        low, high = (F.element_at("_at", c.cast("long")) for c in (F.floor(p), F.ceil(p)))
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return g.select(*keys, F.array(*[found(p) for p in place]).alias(out))


def with_quantiles(summary: DataFrame, df: DataFrame, keys: Sequence[str], value: str | Column, points: Sequence[float], out: str = "_q", part_rows: int | None = None) -> DataFrame:
    """`summary`, one row a key, and the array of quantiles of df's values of that key; null where it has none."""
    q = quantiles(df, keys, value, points, out, part_rows)
    if not keys:
        return summary.join(F.broadcast(q), how="left")  # one row
    return summary.alias("a").join(q.alias("b"), same(keys, "a", "b"), "left").select("a.*", f"b.{out}")


def with_medians(summary: DataFrame, df: DataFrame, keys: Sequence[str], value: str | Column, out: str = "median", digits: int | None = None) -> DataFrame:
    """`summary`, one row a key, and the exact median of df's values of that key."""
    found = with_quantiles(summary, df, keys, value, (0.5,), "_q")
    m = F.get("_q", F.lit(0))
    return found.withColumn(out, m if digits is None else F.round(m, digits)).drop("_q")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], rank: str, total: str | None = None, part_rows: int | None = None) -> DataFrame:
    """`df` with each row's rank (from 1) within its keys along `order`, and the rows of its keys.

    Rows are in contiguous parts of keys and order; a rank is the place within the part after the rows of the parts before,
    so a key with most rows is many tasks. `order` should have no ties.
    """
    x = in_parts(df, [*keys, *order], part_rows)
    counts = x.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    at = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    base = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(at), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"))
    own = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    found = x.withColumn("_own", own).alias("a").join(base.alias("b"), same([*keys, "_part"], "a", "b")).select("a.*", "b._base", "b._total")
    found = found.withColumn(rank, F.col("_base") + F.col("_own"))
    return (found.withColumn(total, F.col("_total")) if total else found).drop("_part", "_own", "_base", "_total")


_FOLDS = {"sum": F.sum, "max": F.max, "min": F.min}


def carried(df: DataFrame, key: str, order: Sequence[str], chunk: Column, *, inclusive: bool = True, **folds: tuple[str, Column]) -> DataFrame:
    """`df` with running folds by key, none of which runs over more than a chunk: name=(sum, max, min or last, expression).

    A fold is over the rows of the key up to this one in `order` (before it, unless inclusive); `last` is the last that
    isn't null. chunk: a number that never falls along the order. Rows are folded within their chunk, and a chunk's fold is
    one row, which the later chunks of its key get carried in.
    """
    x = df.withColumn("_chunk", chunk)
    to = 0 if inclusive else -1
    local = Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, to)
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row a chunk
    own, whole, carry, both = {}, [], [], {}
    for name, (kind, e) in folds.items():
        if kind == "last":
            own[f"_o_{name}"] = F.last(e, True).over(local)
            whole.append(F.max_by(e, F.when(e.isNotNull(), F.struct(*[F.col(c) for c in order]))).alias(f"_w_{name}"))
            carry.append(F.last(f"_w_{name}", True).over(earlier).alias(f"_c_{name}"))
            both[name] = F.coalesce(f"_o_{name}", f"_c_{name}")
        else:
            f = _FOLDS[kind]
            own[f"_o_{name}"] = f(e).over(local)
            whole.append(f(e).alias(f"_w_{name}"))
            carry.append(f(f"_w_{name}").over(earlier).alias(f"_c_{name}"))
            a, b = F.col(f"_o_{name}"), F.col(f"_c_{name}")
            both[name] = F.coalesce(a + b, a, b) if kind == "sum" else (F.greatest if kind == "max" else F.least)(a, b)
    carries = x.groupBy(key, "_chunk").agg(*whole).select(key, "_chunk", *carry)
    found = x.withColumns(own).alias("a").join(carries.alias("b"), same([key, "_chunk"], "a", "b"), "left").select("a.*", *[f"b._c_{n}" for n in folds])
    return found.withColumns(both).drop("_chunk", *own, *[f"_c_{n}" for n in folds])


def nearby(df: DataFrame, key: str, idx: str, before: int, after: int, size: int | None = None) -> DataFrame:
    """`df` in chunks of `size` positions, each with copies of the rows up to `before` under and `after` over it: _chunk, _own.

    Windows by (key, _chunk) that reach no further see what they would see by key alone; rows that aren't `_own` go after.
    Positions of a key are whole numbers without gaps.
    """
    n = size or CHUNK
    own = F.floor(F.col(idx) / n)
    near = F.sequence(F.floor((F.col(idx) - after) / n), F.floor((F.col(idx) + before) / n))
    return df.withColumn("_chunk", F.explode(near)).withColumn("_own", F.col("_chunk") == own)


def ranked_draws(df: DataFrame, stratum: str, draw: Column, key: str, most: Column | None = None, cell_rows: int | None = None) -> DataFrame:
    """`df` with `_rank` (from 1, by draw and then key) within its stratum and `_total`, its rows; beyond `most` rows may go.

    Draws are uniform in [0, 1), so equal cells of them hold about cell_rows rows each: cells are counted, and rows are
    ranked within their cell, after the cells before it. Cells that lie wholly beyond `most` (an expression of _total)
    aren't ranked at all.
    """
    rows = cell_rows or PART_ROWS
    totals = kept(df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_total")))
    totals = F.broadcast(totals) if totals.count() <= BROADCAST_KEYS else totals
    u = df.withColumn("_u", draw).alias("a").join(totals.alias("b"), same([stratum], "a", "b")).select("a.*", "b._total")
    u = u.withColumn("_cell", F.floor(F.col("_u") * F.ceil(F.col("_total") / rows)))
    at = Window.partitionBy(stratum).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # one row a cell
    cells = u.groupBy(stratum, "_cell").agg(F.count(F.lit(1)).alias("_n")).select(stratum, "_cell", F.coalesce(F.sum("_n").over(at), F.lit(0)).alias("_before"))
    x = u.alias("a").join(cells.alias("b"), same([stratum, "_cell"], "a", "b")).select("a.*", "b._before")
    if most is not None:
        x = x.filter(F.col("_before") < most)
    own = Window.partitionBy(stratum, "_cell").orderBy("_u", key)
    return x.withColumn("_rank", F.col("_before") + F.row_number().over(own)).drop("_u", "_cell", "_before")
