"""Streams give what the batch gives on the same rows."""

import datetime

from pyspark.sql import functions as F

from trackworks.functions.logs import line_events
from trackworks.streaming import logs as S


def drained(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    return df.sparkSession.sql(f"select * from {name}")


LINES = ["Train epoch: 1 Learning rate: 0.1", "Metric avg si_sdr : 3.5", "Train epoch: 2 Learning rate: 0.1", "Metric avg si_sdr : 2.5", "Training loss: 0.3 (over 398 finite steps; 2 non-finite skipped)", "loss=inf", "=== run7 CRASHED"]


def test_log_events_and_digest(spark, tmp_path):
    (tmp_path / "run7.log").write_text("\r".join(LINES))  # bars are redrawn after carriage returns
    got = sorted((r["kind"], r["value"] or 0) for r in drained(S.log_events(spark, str(tmp_path)), "ev", "append").collect())
    batch = line_events(spark.createDataFrame([(x,) for x in LINES], "line string")).collect()
    assert got == sorted((r["kind"], r["value"] or 0) for r in batch)
    d = drained(S.running_digest(S.log_events(spark, str(tmp_path))), "dg", "complete").first()
    assert (d["run"], d["epoch"], d["best"], d["n_evals"], d["non_finite"], d["nan_losses"], d["done"], d["crashed"]) == ("run7", 2, 3.5, 2, 2.0, 1, True, True)


def readings(spark, path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [("a", t0 + datetime.timedelta(seconds=s), float(s % 7)) for s in (*range(0, 40), *range(90, 120))] + [("b", t0 + datetime.timedelta(seconds=5), 1.0), ("z", t0 + datetime.timedelta(days=1), 5.0)]
    spark.createDataFrame(rows, "k string, ts timestamp, level double").coalesce(1).write.parquet(path)
    return spark.read.parquet(path), spark.readStream.schema("k string, ts timestamp, level double").parquet(path)


def test_windows_and_sessions_equal_batch(spark, tmp_path):
    batch, stream = readings(spark, str(tmp_path / "r"))
    for k, slide in enumerate((None, "10 seconds")):
        args = ("ts", "k", "level", "20 seconds", "10 seconds", slide, 2.0)
        want = S.level_windows(batch, *args).filter("k <> 'z'").collect()
        got = drained(S.level_windows(stream, *args), f"w{k}", "append").filter("k <> 'z'").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got
    args = ("ts", "k", "level", 0.5, "15 seconds", "10 seconds")
    got = drained(S.activity_sessions(stream, *args), "s", "append").filter("k <> 'z'").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, S.activity_sessions(batch, *args).filter("k <> 'z'").collect()))
    assert len([r for r in got if r["k"] == "a"]) == 2


def test_stall_states(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [("r1", "epoch", t0 + datetime.timedelta(seconds=60 * i)) for i in range(3)] + [("r2", "epoch", t0), ("r2", "trailer", t0), ("r3", "epoch", t0), ("r4", "other", t0 + datetime.timedelta(seconds=300))]
    spark.createDataFrame(rows, "run string, kind string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("run string, kind string, at timestamp").parquet(str(tmp_path / "e"))
    got = {(r["run"], r["status"], r["epochs"]) for r in drained(S.stalls(stream), "st", "append").collect()}
    # the watermark ends at 300 s: r1 should have come again by 240 s, r3 has an hour
    assert got == {("r1", "ok", 3), ("r1", "stalled", 3), ("r2", "done", 1), ("r3", "ok", 1), ("r4", "ok", 0)}


def test_files_come_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in "ab":
        (tmp_path / "in" / n).write_bytes(n.encode())
    got = drained(S.arriving_files(spark, str(tmp_path / "in")), "fs", "append").select(F.regexp_extract("path", "[^/]*$", 0).alias("p"), "length").collect()
    assert sorted(map(tuple, got)) == [("a", 1), ("b", 1)]


def test_a_file_copied_in_late_with_an_old_time_comes_too(spark, tmp_path):
    import os

    from trackworks.sources import scratch

    (tmp_path / "in").mkdir()
    out = scratch.scratch(spark, "ledger")
    now = datetime.datetime.now().timestamp()

    def put(name, age_s):
        (tmp_path / "in" / name).write_text(name)
        os.utime(tmp_path / "in" / name, (now - age_s, now - age_s))

    put("a", 0)
    scratch.drained(S.arriving_files(spark, f"file://{tmp_path}/in"), "files", out)
    put("b", 5 * 86400)
    put("c", 400 * 86400)
    put("a", -60)  # written again under its name
    found = scratch.drained(S.arriving_files(spark, f"file://{tmp_path}/in"), "files", out)
    assert sorted(r["path"][-1] for r in found.collect()) == ["a", "b", "c"]


def test_stalls_take_the_median_of_all_steps(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    # 60 steps of 10 s, then 50 of 1 s: the median of all is 10 s, that of the last ones 1 s
    at = [t0 + datetime.timedelta(seconds=10 * i if i <= 60 else 600 + i - 60) for i in range(111)]
    rows = [("r", "epoch", t) for t in at] + [("other", "epoch", at[-1] + datetime.timedelta(seconds=15))]
    spark.createDataFrame(rows, "run string, kind string, at timestamp").repartition(3).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("run string, kind string, at timestamp").parquet(str(tmp_path / "e"))
    got = {(r["run"], r["status"], r["epochs"]) for r in drained(S.stalls(stream), "st2", "append").collect()}
    assert ("r", "ok", 111) in got and ("r", "stalled", 111) not in got
