"""Levels, loudness and spectra of sample blocks that follow one another in a file."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackworks.operators import signals as X
from trackworks.operators.ranges import CHUNK, carried, nearby, quantiles, ranked
from trackworks.operators.rollups import gaussian_fit, mahalanobis

#: Pre-filter of ITU-R BS.1770 as analogue prototypes (fixed values): shelf frequency, gain in dB, quality; high-pass frequency, quality.
SHELF_HZ, SHELF_DB, SHELF_Q = 1681.974450955533, 3.999843853973347, 0.7071752369554196
HIGH_HZ, HIGH_Q = 38.13547087602444, 0.5003270373238773
#: Absolute gate, relative gate and offset of the same recommendation (fixed values).
ABSOLUTE_LUFS, RELATIVE_LU, OFFSET_LU = -70.0, -10.0, -0.691
#: Frames that the filter takes as one step.
STEP = 128


def level_envelope(blocks: DataFrame, file: str, start: str, samples: str, size: int, floor_db: float = -120.0) -> DataFrame:
    """RMS level in dB of each `size` frames of a file, whatever its stored blocks' lengths; the last, partial one goes.

    start: the first frame of a stored block. Each stored block gives a sum for every level block that it touches.
    """
    n = F.size(samples)
    touched = F.explode(F.sequence(F.floor(F.col(start) / size), F.floor((F.col(start) + n - 1) / size)))
    x = blocks.filter(n > 0).select(file, F.col(start).alias("_at"), F.col(samples).alias("_s"), touched.alias("block_idx"))
    lo = F.greatest(F.col("_at"), F.col("block_idx") * size)
    hi = F.least(F.col("_at") + F.size("_s"), (F.col("block_idx") + 1) * size)
    part = F.slice("_s", (lo - F.col("_at") + 1).cast("int"), (hi - lo).cast("int"))
    g = x.select(file, "block_idx", X.total(part, lambda v: v * v).alias("_q"), (hi - lo).alias("_n")).groupBy(file, "block_idx").agg(F.sum("_q").alias("_q"), F.sum("_n").alias("_n"))
    q = F.col("_q") / size
    return g.filter(F.col("_n") == size).select(file, "block_idx", F.when(q > 0, F.greatest(F.lit(floor_db), 10 * F.log10(q))).otherwise(F.lit(floor_db)).alias("dbfs"))


class StateSpace:
    """A linear filter as state and output: s' = A s + B x, y = C s + D x, and the same for STEP frames at a time."""

    def __init__(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: float) -> None:
        self.a, self.b, self.c, self.d = a, b, c, d
        powers = [np.eye(len(a))]
        for _ in range(STEP):
            powers.append(a @ powers[-1])
        self.powers = np.array(powers)
        self.seen = np.array([c @ p for p in powers[:STEP]])  # what the state adds to the output k frames later
        self.fed = np.array([p @ b for p in powers[:STEP]])  # what a frame adds to the state k frames later
        h = np.append(d, self.fed[: STEP - 1] @ c)
        at = np.subtract.outer(np.arange(STEP), np.arange(STEP))
        self.response = np.where(at >= 0, h[at], 0.0)

    def advanced(self, n: int) -> np.ndarray:
        """A to the power of n."""
        return np.linalg.matrix_power(self.a, n)

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output of x from a state, and the state after it."""
        steps = len(x) // STEP
        whole = x[: steps * STEP].reshape(steps, STEP)
        fed = whole @ self.fed[::-1]
        states = np.zeros((steps, len(state)))
        for j in range(steps):
            states[j] = state
            state = self.powers[STEP] @ state + fed[j]
        y = whole @ self.response.T + states @ self.seen.T
        rest = x[steps * STEP :]
        n = len(rest)
        last = self.response[:n, :n] @ rest + self.seen[:n] @ state
        if n:
            state = self.powers[n] @ state + rest @ self.fed[:n][::-1]
        return np.append(y.ravel(), last), state


@functools.cache
def k_coefficients(sr: int) -> tuple[tuple[list[float], list[float]], tuple[list[float], list[float]]]:
    """(b, a) of the K-weighting's two filters at a sample rate, from their analogue prototypes."""
    k = math.tan(math.pi * SHELF_HZ / sr)
    vh = 10 ** (SHELF_DB / 20)
    vb = vh**0.4996667741545416
    a0 = 1 + k / SHELF_Q + k * k
    shelf = [(vh + vb * k / SHELF_Q + k * k) / a0, 2 * (k * k - vh) / a0, (vh - vb * k / SHELF_Q + k * k) / a0], [1.0, 2 * (k * k - 1) / a0, (1 - k / SHELF_Q + k * k) / a0]
    k = math.tan(math.pi * HIGH_HZ / sr)
    a0 = 1 + k / HIGH_Q + k * k
    return shelf, ([1.0, -2.0, 1.0], [1.0, 2 * (k * k - 1) / a0, (1 - k / HIGH_Q + k * k) / a0])


@functools.cache
def k_weighting(sr: int) -> StateSpace:
    """Both filters, one after the other, as one system of four numbers."""
    parts = []
    for b, a in k_coefficients(sr):
        parts.append((np.array([[-a[1], 1.0], [-a[2], 0.0]]), np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]]), np.array([1.0, 0.0]), b[0]))
    (a1, b1, c1, d1), (a2, b2, c2, d2) = parts
    a = np.zeros((4, 4))
    a[:2, :2], a[2:, 2:], a[2:, :2] = a1, a2, np.outer(b2, c1)
    return StateSpace(a, np.append(b1, b2 * d1), np.append(d2 * c1, c2), d1 * d2)


def _left_behind(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """By block the state that its own frames leave behind, from rest: four numbers a channel."""
    for f in frames:
        out = []
        for file, sr, start, samples in zip(f["file_id"], f["sr"], f["start"], f["samples"], strict=True):
            left = [k_weighting(int(sr)).run(np.asarray(x, float), np.zeros(4))[1] for x in samples]
            out.append((file, int(sr), int(start), len(samples[0]), [float(v) for s in left for v in s]))
        yield pd.DataFrame(out, columns=["file_id", "sr", "start", "n", "state"])


def _entered(f: pd.DataFrame) -> pd.DataFrame:
    """The state in which each block of a file begins: the state before it, advanced by its frames, and what it left behind."""
    f = f.sort_values("start")
    states, powers, state = [], {}, None
    for sr, n, left in zip(f["sr"], f["n"], f["state"], strict=True):
        left = np.asarray(left).reshape(-1, 4)
        state = np.zeros_like(left) if state is None or len(state) != len(left) else state
        states.append(state.ravel().tolist())
        if (sr, n) not in powers:
            powers[sr, n] = k_weighting(int(sr)).advanced(int(n))
        state = state @ powers[sr, n].T + left
    return pd.DataFrame({"file_id": f["file_id"], "start": f["start"], "state": states})


def _hop_energies(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for file, sr, start, samples, state in zip(f["file_id"], f["sr"], f["start"], f["samples"], f["state"], strict=True):
            hop, energy = int(sr) // 10, 0.0
            for x, s in zip(samples, np.asarray(state).reshape(-1, 4), strict=True):
                y = k_weighting(int(sr)).run(np.asarray(x, float), s)[0]
                energy = energy + y * y
            at = (start + np.arange(len(energy))) // hop
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            out += [(file, int(sr), int(k), float(e), int(n)) for k, e, n in zip(at[first], np.add.reduceat(energy, first), np.diff(np.append(first, len(at))), strict=True)]
        yield pd.DataFrame(out, columns=["file_id", "sr", "hop", "energy", "n"])


def _hops(blocks: DataFrame) -> DataFrame:
    """Energy after K-weighting by full tenth of a second: file_id, sr, hop, e, n.

    A block's effect on the filter is a matrix (of its length) and four numbers a channel. Blocks are filtered on their own
    first; those numbers, a small row a block, give by file the state in which each block begins, and blocks are then
    filtered from there: as exact as one recursion over the file, which no task holds.
    """
    kind = blocks.schema["file_id"].dataType.simpleString()
    b = blocks.select("file_id", F.col("sr").cast("int").alias("sr"), F.col("start").cast("long").alias("start"), "samples").filter(F.size(F.get("samples", F.lit(0))) > 0)
    left = b.mapInPandas(_left_behind, f"file_id {kind}, sr int, start long, n int, state array<double>")
    states = left.groupBy("file_id").applyInPandas(_entered, f"file_id {kind}, start long, state array<double>")
    x = b.join(states, ["file_id", "start"])
    hops = x.mapInPandas(_hop_energies, f"file_id {kind}, sr int, hop long, energy double, n int").groupBy("file_id", "sr", "hop").agg(F.sum("energy").alias("e"), F.sum("n").alias("n"))
    return hops.filter(F.col("n") == F.floor(F.col("sr") / 10))


def _gated(hops: DataFrame, keys: list[str]) -> DataFrame:
    """Gated loudness of each key's runs of four hops: keys, lufs, n_blocks; keys where nothing passes are absent."""
    four = Window.partitionBy(*keys).orderBy("hop").rowsBetween(0, 3)
    p = hops.select(*keys, (F.sum("e").over(four) / F.sum("n").over(four)).alias("power"), F.count(F.lit(1)).over(four).alias("k")).filter("k = 4")
    lufs = lambda c: OFFSET_LU + 10 * F.log10(c)
    loud = p.filter((F.col("power") > 0) & (lufs(F.col("power")) > ABSOLUTE_LUFS))
    gate = loud.groupBy(*keys).agg((lufs(F.avg("power")) + RELATIVE_LU).alias("gate"))
    return loud.join(gate, keys).filter(lufs(F.col("power")) > F.col("gate")).groupBy(*keys).agg(lufs(F.avg("power")).alias("lufs"), F.count(F.lit(1)).alias("n_blocks"))


def integrated_loudness(blocks: DataFrame) -> DataFrame:
    """Gated loudness (ITU-R BS.1770) by file: file_id, lufs (null where nothing passes the gate), n_blocks.

    blocks: file_id, sr, start (first frame), samples (an array a channel, one or two); a file's blocks follow one another
    without gaps and have the same channels.
    """
    return blocks.select("file_id").distinct().join(_gated(_hops(blocks), ["file_id"]), "file_id", "left").na.fill({"n_blocks": 0})


def window_loudness(blocks: DataFrame, seconds: float) -> DataFrame:
    """Gated loudness of each full window of `seconds` (whole tenths): file_id, window, lufs, measurable, minus_file.

    A window in which nothing passes the gate is kept: lufs is null and measurable false, so that the distribution keeps
    its shape. minus_file: what the window has over its file's integrated loudness.
    """
    size = round(seconds * 10)
    hops = _hops(blocks).withColumn("window", F.floor(F.col("hop") / size))
    full = hops.groupBy("file_id", "window").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == size).drop("_n")
    whole = _gated(hops, ["file_id"]).select("file_id", F.col("lufs").alias("_file"))
    x = full.join(_gated(hops, ["file_id", "window"]).drop("n_blocks"), ["file_id", "window"], "left").join(whole, "file_id", "left")
    return x.select("file_id", "window", "lufs", F.col("lufs").isNotNull().alias("measurable"), (F.col("lufs") - F.col("_file")).alias("minus_file"))


def loudness_measures(blocks: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """The first stage of a loudness profile, a row a file: file_id, lufs, n_blocks, peak, rms, crest_db; not a number where there is no signal.

    done: what an earlier run measured; its files aren't read again, and its rows come first. Sums of blocks give all of
    it, so no task holds a file.
    """
    todo = blocks if done is None else blocks.join(done.select("file_id"), "file_id", "left_anti")
    levels = X.file_metrics(todo.select("file_id", F.flatten("samples").alias("samples")), ["file_id"])
    found = integrated_loudness(todo).join(levels, "file_id").select("file_id", "lufs", "n_blocks", "peak", "rms", X.crest_db(F.col("peak"), F.col("rms")).alias("crest_db"))
    return found if done is None else done.select(found.columns).unionByName(found)


def profile_ranking(measures: DataFrame, dataset: str, reference: Column, prior: float, chi2: float = 5.991, part_rows: int | None = None) -> DataFrame:
    """The second stage: how much like the reference files' loudness and crest each other file's are, against those of its own dataset.

    Both are 2-D normal populations, fitted by sums. Columns: those of measures, log_odds (with the prior of being such a
    file), inside (whether the file is within the reference's ellipse; 5.991 is its 95 %), rank_in_dataset and
    sources_in_dataset. Files without loudness or crest are left out; the ranking is one for review, not a verdict.
    """
    usable = measures.filter("lufs is not null and not isnan(lufs) and crest_db is not null and not isnan(crest_db)").withColumn("_ref", reference)
    fit = lambda df, keys: gaussian_fit(df, keys, "lufs", "crest_db")
    terms = [mahalanobis("lufs", "crest_db").alias("_d"), F.log(F.col("vx") * F.col("vy") - F.col("cxy") * F.col("cxy")).alias("_l")]
    rest = usable.filter("not _ref").drop("_ref")
    own = rest.join(fit(rest, [dataset]), dataset).select(*rest.columns, *terms).withColumnsRenamed({"_d": "_own_d", "_l": "_own_l"})
    both = own.join(F.broadcast(fit(usable.filter("_ref"), [])), how="left").select(*own.columns, *terms)  # one row
    odds = (F.col("_own_d") + F.col("_own_l") - F.col("_d") - F.col("_l")) / 2 + math.log(prior / (1 - prior))
    scored = both.select(*rest.columns, odds.alias("log_odds"), (F.col("_d") < chi2).alias("inside")).withColumn("_against", -F.col("log_odds"))
    return ranked(scored, [dataset], ["_against", "file_id"], "rank_in_dataset", "sources_in_dataset", part_rows).drop("_against")


def spectra(blocks: DataFrame, keys: list[str], samples: str = "samples") -> DataFrame:
    """Power of each frequency bin of each block (Hann window): keys, bin, power. Blocks of one length are transformed together."""
    kinds = ", ".join(f"{k} {blocks.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for n, own in f.groupby(f[samples].map(len)):
                if not n:
                    continue
                p = np.abs(np.fft.rfft(np.stack(own[samples].to_list()).astype(float) * np.hanning(n), axis=1)) ** 2
                bins = p.shape[1]
                yield pd.DataFrame({**{k: own[k].repeat(bins).to_numpy() for k in keys}, "bin": np.tile(np.arange(bins, dtype=np.int32), len(own)), "power": p.ravel()})

    return blocks.select(*keys, samples).mapInPandas(run, f"{kinds}, bin int, power double")


def median_spectrum(spectrum: DataFrame, keys: list[str], floor: float = 1e-20) -> DataFrame:
    """Median over blocks of each bin's power, in dB: keys, bin, level_db."""
    q = quantiles(spectrum, [*keys, "bin"], "power", (0.5,))
    return q.select(*keys, "bin", (10 * F.log10(F.greatest(F.get("q", F.lit(0)), F.lit(floor)))).alias("level_db"))


def flatness(spectrum: DataFrame, keys: list[str], low: int, high: int) -> DataFrame:
    """Spectral flatness of bins [low, high) and the share of power they hold, by keys."""
    band = (F.col("bin") >= low) & (F.col("bin") < high)
    p = F.greatest(F.col("power"), F.lit(1e-20))
    g = spectrum.groupBy(*keys).agg(F.avg(F.when(band, F.log(p))).alias("_l"), F.avg(F.when(band, p)).alias("_m"), F.sum(F.when(band, p)).alias("_b"), F.sum(p).alias("_t"))
    return g.select(*keys, (F.exp("_l") / F.col("_m")).alias("flatness"), (F.col("_b") / F.col("_t")).alias("share"))


def mix_weights(stems: DataFrame, master: DataFrame, song: str, block: str, stem: str, samples: str = "samples", ridge: float = 1e-6) -> DataFrame:
    """Least-squares weights of a song's stems in its master: song, stem, weight.

    Products of stems are summed over blocks by the cluster; what is left for one task is a song's small system.
    """
    a = stems.select(song, block, F.col(stem).alias("i"), F.col(samples).alias("x"))
    pairs = a.join(a.select(song, block, F.col("i").alias("j"), F.col("x").alias("y")), [song, block]).groupBy(song, "i", "j").agg(F.sum(X.dot(F.col("x"), F.col("y"))).alias("v"))
    right = a.join(master.select(song, block, F.col(samples).alias("y")), [song, block]).groupBy(song, "i").agg(F.sum(X.dot(F.col("x"), F.col("y"))).alias("v"))
    kind_song, kind_stem = stems.schema[song].dataType.simpleString(), stems.schema[stem].dataType.simpleString()

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        names = sorted(f["i"].unique())
        at = {n: k for k, n in enumerate(names)}
        g, b = np.zeros((len(names), len(names))), np.zeros(len(names))
        for i, j, v, is_right in zip(f["i"], f["j"], f["v"], f["right"], strict=True):
            if is_right:
                b[at[i]] = v
            else:
                g[at[i], at[j]] = v
        w = np.linalg.solve(g + ridge * np.eye(len(names)) * max(1.0, np.trace(g) / len(names)), b)
        return pd.DataFrame({song: f[song].iloc[0], stem: names, "weight": w})

    u = pairs.withColumn("right", F.lit(False)).unionByName(right.withColumns({"j": F.col("i"), "right": F.lit(True)}))
    return u.groupBy(song).applyInPandas(solve, f"{song} {kind_song}, {stem} {kind_stem}, weight double")


def limiter_gain(df: DataFrame, key: str, idx: str, value: str, ceiling: float, ahead: int, chunk: int | None = None) -> DataFrame:
    """Look-ahead limiter: needed gain, its least over the next rows, smoothed over as many, never over what is needed.

    A key's positions are whole numbers without gaps; it is worked on in chunks that see `ahead` rows of their neighbours.
    """
    x = nearby(df, key, idx, ahead, ahead, chunk)
    w = Window.partitionBy(key, "_chunk").orderBy(idx)
    x = x.withColumn("_g", F.when(F.abs(value) > ceiling, ceiling / F.abs(value)).otherwise(1.0))
    x = x.withColumn("_m", F.min("_g").over(w.rowsBetween(0, ahead)))
    return x.withColumn("gain", F.least(F.avg("_m").over(w.rowsBetween(-ahead, 0)), F.col("_g"))).filter("_own").drop("_g", "_m", "_chunk", "_own")


def interpolated(df: DataFrame, points: DataFrame, key: str, idx: str, value: str, chunk: int | None = None) -> DataFrame:
    """df with `value` interpolated between the points before and after each row (constant beyond the first and last).

    The last point before a row and the first after it are both last values, along the order and against it, folded in
    chunks: the cost grows with the rows of a key, and no task holds them all.
    """
    cols = [c for c in df.columns if c not in (key, idx)]
    u = df.select(key, idx, *cols, F.lit(None).cast("struct<v double, t double>").alias("_p"), F.lit(1).alias("_o")).unionByName(
        points.select(key, idx, F.struct(F.col(value).cast("double").alias("v"), F.col(idx).cast("double").alias("t")).alias("_p"), F.lit(0).alias("_o")), allowMissingColumns=True
    )
    size = chunk or CHUNK
    x = carried(u, key, [idx, "_o"], F.floor(F.col(idx) / size), _a=("last", F.col("_p"))).withColumn("_against", -F.col(idx))
    x = carried(x, key, ["_against", "_o"], F.floor(F.col("_against") / size), _b=("last", F.col("_p"))).filter("_o = 1")
    a, b, at = F.col("_a"), F.col("_b"), F.col(idx)
    y = F.when(a.isNull(), b["v"]).when(b.isNull() | (b["t"] == a["t"]), a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (at - a["t"]) / (b["t"] - a["t"]))
    return x.withColumn(value, y).drop("_p", "_o", "_a", "_b", "_against")


def pitch_agreement(tracks: DataFrame, song: str, frame: str, cls: str, f0: str, within: float = 50.0) -> DataFrame:
    """By pair of classes: co-voiced frames and those whose pitches agree within some cents, octaves folded."""
    a = tracks.filter(F.col(f0) > 0).select(song, frame, F.col(cls).alias("a"), F.col(f0).alias("fa"))
    j = a.join(a.select(song, frame, F.col("a").alias("b"), F.col("fa").alias("fb")), [song, frame]).filter("a < b")
    cents = 1200 * F.log2(F.col("fa") / F.col("fb"))
    folded = F.pmod(cents + 600, F.lit(1200.0)) - 600
    return j.groupBy("a", "b").agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.abs(folded) < within).alias("hits"))
