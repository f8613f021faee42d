"""Measurements of sample blocks.

Every measure is a set of sums that can be merged (n, sum of x, of x squared, of products, maxima), formed inside each
block with array functions and then added up by file: a file of any length is many block rows, and no task holds one
whole. Blocks are (file_id, block_idx, samples array<double>).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackworks.operators.ranges import quantiles

#: Caps of scores in dB, and the small number that keeps logs finite.
CAP_DB, EPS = 100.0, 1e-8
#: Samples of sums that a task keeps before it hands them out.
SUM_SAMPLES = 1 << 22


def total(a: Column, f: Callable[[Column], Column]) -> Column:
    """Sum of f over an array's elements, in double precision; 0 for an empty one."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays, to the end of the shorter one."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def db(power: Column) -> Column:
    return 10 * F.log10(power)


def file_metrics(blocks: DataFrame, keys: list[str], samples: str = "samples", full_scale: float = 1.0, active_at: float = 1e-3, dead_at: float = 1e-4) -> DataFrame:
    """Peak, rms, mean, share of clipped and of active samples, and whether a file is dead (peak under dead_at)."""
    a = F.col(samples)
    part = blocks.select(
        *keys, F.size(a).alias("_n"), total(a, lambda x: x).alias("_s"), total(a, lambda x: x * x).alias("_q"), F.array_max(F.transform(a, lambda x: F.abs(x.cast("double")))).alias("_m"),
        total(a, lambda x: F.when(F.abs(x) >= full_scale, 1.0).otherwise(0.0)).alias("_c"), total(a, lambda x: F.when(F.abs(x) > active_at, 1.0).otherwise(0.0)).alias("_a"),
    )
    n = F.sum("_n")
    return part.groupBy(*keys).agg(
        F.max("_m").alias("peak"), F.sqrt(F.sum("_q") / n).alias("rms"), (F.sum("_s") / n).alias("dc_offset"), (F.sum("_c") / n).alias("clip_frac"), (F.sum("_a") / n).alias("active_frac"),
        (F.coalesce(F.max("_m"), F.lit(0.0)) < dead_at).alias("dead"),
    )


def crest_db(peak: Column, rms: Column) -> Column:
    return F.when((peak > 0) & (rms > 0), 20 * F.log10(peak / rms))


def products(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Sums over pairs of aligned blocks: n, sx, sy, sxx, syy, sxy, and the largest difference."""
    a, b = F.col(x), F.col(y)
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    part = pairs.select(
        *keys, n.alias("_n"), total(a, lambda v: v).alias("_x"), total(b, lambda v: v).alias("_y"), dot(a, a).alias("_xx"), dot(b, b).alias("_yy"), dot(a, b).alias("_xy"),
        F.array_max(F.zip_with(a, b, lambda v, w: F.abs(v.cast("double") - w.cast("double")))).alias("_d"),
    )
    return part.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum("_x").alias("sx"), F.sum("_y").alias("sy"), F.sum("_xx").alias("sxx"), F.sum("_yy").alias("syy"), F.sum("_xy").alias("sxy"), F.max("_d").alias("max_diff"))


def correlation(constant_at: float = 1e-9) -> Column:
    """Pearson correlation from products(); two constant channels are 1, one is 0."""
    vx, vy = F.col("sxx") / F.col("n") - F.pow(F.col("sx") / F.col("n"), 2), F.col("syy") / F.col("n") - F.pow(F.col("sy") / F.col("n"), 2)
    cov = F.col("sxy") / F.col("n") - F.col("sx") / F.col("n") * F.col("sy") / F.col("n")
    still_x, still_y = vx < constant_at**2, vy < constant_at**2
    return F.when(still_x & still_y, 1.0).when(still_x | still_y, 0.0).otherwise(cov / F.sqrt(vx * vy))


def gain_fit() -> tuple[Column, Column, Column]:
    """From products(): the gain g that makes y nearest to g x, the residual of y against x and against g x, in dB of y."""
    g = F.col("sxy") / F.greatest(F.col("sxx"), F.lit(EPS))
    raw = F.col("syy") - 2 * F.col("sxy") + F.col("sxx")
    fitted = F.col("syy") - 2 * g * F.col("sxy") + g * g * F.col("sxx")
    y = F.greatest(F.col("syy"), F.lit(EPS))
    return g, db(F.greatest(raw / y, F.lit(EPS))), db(F.greatest(fitted / y, F.lit(EPS)))


def capped(x: Column) -> Column:
    return F.greatest(F.lit(-CAP_DB), F.least(F.lit(CAP_DB), x))


def si_sdr() -> Column:
    """Scale-invariant signal-to-distortion ratio from products() of reference x and estimate y, capped."""
    scale = (F.col("sxy") + EPS) / (F.col("sxx") + EPS)
    target = scale * scale * F.col("sxx")
    noise = target - 2 * scale * F.col("sxy") + F.col("syy")
    return capped(db((target + EPS) / (F.greatest(noise, F.lit(0.0)) + EPS)))


def usdr() -> Column:
    """Signal-to-distortion ratio without scaling, capped."""
    return capped(db((F.col("sxx") + EPS) / (F.greatest(F.col("sxx") - 2 * F.col("sxy") + F.col("syy"), F.lit(0.0)) + EPS)))


#: Scores by name; what they need is products() of reference and estimate.
METRICS: dict[str, Callable[[], Column]] = {"si_sdr": si_sdr, "usdr": usdr}


def score(pairs: DataFrame, keys: list[str], reference: str, estimate: str, names: list[str]) -> DataFrame:
    """Named scores by keys; an unknown name, or one of a key, raises."""
    for n in names:
        if n not in METRICS:
            raise ValueError(f"unknown metric {n}")
        if n in keys:
            raise ValueError(f"{n} is the name of a key")
    return products(pairs, keys, reference, estimate).select(*keys, *[METRICS[n]().alias(n) for n in names])


def _added(keys: list[str], samples: str, in_order: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of the blocks of each key. Where rows come in order of keys, a sum is done when the next key begins; else all are kept until they are large."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        kinds: pa.Schema | None = None

        def out(done: dict[tuple, np.ndarray]) -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in done], kinds.field(n).type) for i, n in enumerate(keys)]
            ends = np.cumsum([0, *map(len, done.values())])
            return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(list(done.values()))))], names=[*keys, samples])

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = batch.schema
            own = [batch.column(kinds.get_field_index(n)).to_pylist() for n in keys]
            column = batch.column(kinds.get_field_index(samples))
            values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.append(0, pc.list_value_length(column).to_numpy(zero_copy_only=False)))
            for i, key in enumerate(zip(*own, strict=True) if keys else [()] * batch.num_rows):
                x = values[ends[i] : ends[i + 1]]
                have = sums.get(key)
                if have is None or len(have) < len(x):
                    have, x = x.copy(), have if have is not None else x[:0]
                    sums[key] = have
                have[: len(x)] += x
            if in_order and len(sums) > 1:
                last = next(reversed(sums))
                yield out({k: v for k, v in sums.items() if k != last})
                sums = {last: sums[last]}
            elif not in_order and sum(map(len, sums.values())) > SUM_SAMPLES:
                yield out(sums)
                sums = {}
        if sums:
            yield out(sums)

    return run


def vector_sum(df: DataFrame, keys: list[str], samples: str = "samples") -> DataFrame:
    """Sum of blocks by keys, sample by sample from their first; a shorter block counts as 0 beyond its end, nulls as 0.

    Blocks are added as arrays: each task adds its own, and the sums, no more than a block a key and task, are dealt by key
    and added in order, so a task holds one sum and no sample is ever a row. Null and empty blocks go.
    """
    rows = df.filter(F.size(samples) > 0).select(*keys, F.transform(samples, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias(samples))
    kinds = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + [f"`{samples}` array<double>"])
    part = rows.mapInArrow(_added(keys, samples, False), kinds)
    if not keys:
        return part.coalesce(1).mapInArrow(_added(keys, samples, True), kinds)  # a block a task
    return part.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_added(keys, samples, True), kinds)


def bus_allocated(stems: DataFrame, keys: list[str], stem: str, ratio: float, ceiling: float, samples: str = "samples") -> DataFrame:
    """Stems at `ratio`; where their sum is over the ceiling, the loudest stem of each sample (of equals the first) takes the difference.

    So stems add up to the limited bus. A key has a row a stem, all of one length; its few stems meet in one row of blocks.
    """
    bus = stems.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(stem).alias("stem"), F.col(samples).alias("x")))).alias("_stems"))
    at = F.sequence(F.lit(0), F.size(F.get("_stems", F.lit(0))["x"]) - 1)
    total = F.transform(at, lambda i: F.aggregate("_stems", F.lit(0.0), lambda s, e: s + F.get(e["x"], i)))
    loudest = F.transform(at, lambda i: F.aggregate("_stems", F.struct(F.lit(-1.0).alias("v"), F.get("_stems", F.lit(0))["stem"].alias("stem")), lambda s, e: F.when(F.abs(F.get(e["x"], i)) > s["v"], F.struct(F.abs(F.get(e["x"], i)).alias("v"), e["stem"].alias("stem"))).otherwise(s))["stem"])
    x = bus.select(*keys, "_stems", total.alias("_total"), loudest.alias("_loudest")).select(*keys, "_total", "_loudest", F.explode("_stems").alias("_s"))
    rest = F.transform("_total", lambda y: F.greatest(F.lit(-ceiling), F.least(F.lit(ceiling), y * ratio)) - y * ratio)
    own = F.transform(F.zip_with(rest, "_loudest", lambda r, t: F.when(t == F.col("_s.stem"), r).otherwise(0.0)), lambda v: v)
    return x.select(*keys, F.col("_s.stem").alias(stem), F.zip_with("_s.x", own, lambda v, r: v * ratio + r).alias(samples))


def peak_scaled(df: DataFrame, keys: list[str], samples: str = "samples", ceiling: float = 0.99) -> DataFrame:
    """Blocks scaled by one factor a file where its peak is over the ceiling."""
    peak = df.groupBy(*keys).agg(F.max(F.array_max(F.transform(samples, lambda x: F.abs(x)))).alias("_p"))
    gain = F.when(F.col("_p") > ceiling, ceiling / F.col("_p")).otherwise(1.0)
    return df.join(peak, keys).withColumn("gain", gain).withColumn(samples, F.transform(samples, lambda x: x * F.col("gain"))).drop("_p")


def lags(pairs: DataFrame, keys: list[str], x: str, y: str, max_lag: int) -> DataFrame:
    """Correlation sums of block pairs at every lag within max_lag: keys, lag, c. Positive lags: y comes later."""
    n = F.least(F.size(x), F.size(y))
    at = F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag)))
    p = pairs.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"), n.alias("_n"), at.alias("lag")).filter(F.abs("lag") < F.col("_n"))
    size = F.col("_n") - F.abs("lag")
    a = F.slice("_x", F.greatest(F.lit(0), -F.col("lag")) + 1, size)
    b = F.slice("_y", F.greatest(F.lit(0), F.col("lag")) + 1, size)
    return p.select(*keys, "lag", dot(a, b).alias("_c")).groupBy(*keys, "lag").agg(F.sum("_c").alias("c"))


def best_lag(pairs: DataFrame, keys: list[str], x: str, y: str, max_lag: int) -> DataFrame:
    """The lag of the largest sum (of equals the smallest lag), its sum, and the one at zero."""
    c = lags(pairs, keys, x, y, max_lag)
    return c.groupBy(*keys).agg(F.max_by("lag", F.struct(F.round("c", 9), -F.col("lag"))).alias("lag"), F.max("c").alias("c_at_lag"), F.max(F.when(F.col("lag") == 0, F.col("c"))).alias("c_at_zero"))


def overview(blocks: DataFrame, keys: list[str], samples: str, every: int) -> DataFrame:
    """Least and most of each `every` samples of a block: keys, cell, least, most. Cells are cut out of the array, a row a cell."""
    n = F.ceil(F.size(samples) / every)
    x = blocks.filter(F.size(samples) > 0).select(*keys, samples, F.explode(F.sequence(F.lit(0), n - 1)).alias("cell"))
    own = F.slice(samples, (F.col("cell") * every + 1).cast("int"), F.lit(every))
    return x.select(*keys, "cell", F.array_min(own).alias("least"), F.array_max(own).alias("most"))


def block_crests(blocks: DataFrame, keys: list[str], block: str, samples: str = "samples", silent: float = 1e-6) -> DataFrame:
    """By keys the median and 95th percentile of the crests of single blocks; blocks whose RMS is no more than `silent` have none."""
    peak = F.array_max(F.transform(samples, lambda x: F.abs(x)))
    rms = F.sqrt(dot(F.col(samples), F.col(samples)) / F.size(samples))
    c = blocks.select(*keys, block, peak.alias("_p"), rms.alias("_r")).filter(F.col("_r") > silent).withColumn("_c", crest_db(F.col("_p"), F.col("_r")))
    return quantiles(c, keys, "_c", (0.5, 0.95)).select(*keys, *[F.round(F.get("q", F.lit(i)), 5).alias(n) for i, n in enumerate(("crest_p50_db", "crest_p95_db"))])


def with_noise(df: DataFrame, samples: str, noise: str, snr_db: float) -> DataFrame:
    """samples plus noise at the gain that puts it snr_db under them; without noise or signal nothing is added."""
    x, n = F.col(samples), F.col(noise)
    power = dot(n, n)
    gain = F.when(power > 0, F.sqrt(dot(x, x) / (power * 10 ** (snr_db / 10)))).otherwise(0.0)
    return df.withColumn("_gain", gain).withColumn(samples, F.zip_with(samples, noise, lambda a, b: a + F.col("_gain") * b)).drop("_gain")
