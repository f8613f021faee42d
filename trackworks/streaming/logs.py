"""Streams: log digests, level envelopes, activity sessions and file ingest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackworks.functions.logs import line_events


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a folder's log files as they arrive; the run is the file's name."""
    return spark.readStream.text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1).alias("run"), F.col("value").alias("line"))


def log_events(spark: SparkSession, path: str) -> DataFrame:
    return line_events(log_lines(spark, path))


def running_digest(events: DataFrame) -> DataFrame:
    """By run: last epoch, best average, averages, skipped non-finite steps, NaN losses, whether it ended and whether it crashed; update mode."""
    e = F.col("kind")
    return events.groupBy("run").agg(
        F.max(F.when(e == "epoch", F.col("value"))).cast("long").alias("epoch"), F.max(F.when(e == "average", F.col("value"))).alias("best"),
        F.count_if(e == "average").alias("n_evals"), F.coalesce(F.sum(F.when(e == "non_finite", F.col("value"))), F.lit(0.0)).alias("non_finite"), F.count_if(e == "nan_loss").alias("nan_losses"),
        F.bool_or(e == "trailer").alias("done"), F.coalesce(F.bool_or((e == "trailer") & F.col("name").startswith("CRASHED")), F.lit(False)).alias("crashed"),
    )


def level_windows(readings: DataFrame, ts: str, key: str, level: str, length: str, late: str, slide: str | None = None, active_at: float = 0.0) -> DataFrame:
    """Mean and peak level, and the share of active readings, by key and window; rows later than `late` are dropped."""
    r = readings.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    g = r.groupBy(F.window(ts, length, slide or length).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.avg(level).alias("mean_level"), F.max(level).alias("peak_level"), F.avg((F.col(level) > active_at).cast("double")).alias("cov"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean_level", "peak_level", "cov")


def activity_sessions(readings: DataFrame, ts: str, key: str, level: str, active_at: float, gap: str, late: str) -> DataFrame:
    """Runs of active readings bridged over gaps shorter than `gap`."""
    r = readings.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).filter(F.col(level) > active_at)
    g = r.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.max(level).alias("peak_level"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "peak_level")


def stalls(events: DataFrame, late: str = "0 seconds", fallback_s: float = 3600.0) -> DataFrame:
    """By run a `stalled` row when it has been silent for twice its median epoch time (or fallback_s before it has two).

    events: run, kind, at (timestamp). Silence is measured against the watermark, `late` behind the latest event of any
    run, so a replay says the same as the live stream. Each batch with a run's events gives an `ok` row, or `done` after
    its trailer. State is the epoch times of a run, 8 bytes each: the median is of all its steps, also where epochs come out
    of order. It leaves when the run is done or stalled.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def row(status: str, last: float, n: int) -> pd.DataFrame:
            return pd.DataFrame({"run": [key[0]], "status": [status], "last_seen": [last], "epochs": [n]})

        if state.hasTimedOut:
            last, times = state.get
            state.remove()
            yield row("stalled", last, len(times))
            return
        last, times = state.get if state.exists else (0.0, [])
        done = False
        for f in frames:
            seconds = f["at"].astype("datetime64[us]").astype("int64") / 1e6
            last = max([last, *seconds])
            times = sorted({*times, *seconds[f["kind"] == "epoch"]})
            done |= bool((f["kind"] == "trailer").any())
        if done:
            if state.exists:
                state.remove()
            yield row("done", last, len(times))
            return
        steps = pd.Series(times).diff().dropna()
        until = int(1000 * (last + (2 * steps.median() if len(steps) else fallback_s)))
        if until <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            yield row("stalled", last, len(times))
            return
        state.update((float(last), [float(t) for t in times]))
        state.setTimeoutTimestamp(until)
        yield row("ok", last, len(times))

    marked = events.select("run", "kind", F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    return marked.groupBy("run").applyInPandasWithState(step, "run string, status string, last_seen double, epochs long", "last double, times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def arriving_files(spark: SparkSession, path: str) -> DataFrame:
    """Each new file of a folder once, even if it is written again under the same name; the sink's checkpoint resumes it.

    A file counts by its path, whatever its modification time: the source takes files of any age, and the paths seen are
    state that no watermark drops (a path a file, dealt over the cluster), so a file that is copied in with an old time
    comes too.
    """
    f = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    f = f.option("recursiveFileLookup", "true").option("maxFileAge", "36500d").load(path)
    return f.select("path", "length", "modificationTime").dropDuplicates(["path"])
