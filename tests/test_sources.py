import wave

import numpy as np
import pyarrow as pa
import pytest

from trackworks.functions import logs as L
from trackworks.sources import files as S


def write_wav(path, x, width=2, sr=8000):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(x.shape[1]), w.setsampwidth(width), w.setframerate(sr)
        q = np.round(x * ((1 << (8 * width - 1)) - 1)).astype("<i4")
        w.writeframes(q.astype("<i2").tobytes() if width == 2 else q.tobytes() if width == 4 else q.reshape(-1).view(np.uint8).reshape(-1, 4)[:, :3].tobytes())


def test_wav_blocks_round_trip_and_errors_are_rows(spark, tmp_path):
    x = np.random.default_rng(0).uniform(-0.9, 0.9, (2500, 2))
    for width in (2, 3, 4):
        write_wav(tmp_path / f"a{width}.wav", x, width)
    (tmp_path / "bad.wav").write_bytes(b"no wave")
    rows = S.read_wav_blocks(spark, str(tmp_path), 1000).collect()
    assert sum(r["error"] is not None for r in rows) == 1
    for width in (2, 3, 4):
        own = sorted((r for r in rows if r["path"].endswith(f"a{width}.wav")), key=lambda r: r["block_idx"])
        assert [r["n_frames"] for r in own] == [1000, 1000, 500]
        assert np.abs(np.concatenate([np.array(r["samples"]).T for r in own]) - x).max() < 1e-4


def test_a_file_in_many_ranges_is_the_file(spark, tmp_path):
    x = np.random.default_rng(1).uniform(-0.9, 0.9, (10_007, 2))
    for width in (2, 3, 4):
        write_wav(tmp_path / f"a {width}%.wav", x, width)
    (tmp_path / "bad.wav").write_bytes(b"RIFF\0\0\0\0WAVEdata\4\0\0\0abcd")
    whole = {(r["path"], r["block_idx"]): r for r in S.read_wav_blocks(spark, str(tmp_path), 1000).collect()}
    parts = {(r["path"], r["block_idx"]): r for r in S.read_wav_blocks(spark, str(tmp_path), 1000, range_bytes=9000).collect()}
    assert whole == parts and len(whole) == 34 and [r["error"] for (p, _), r in whole.items() if p.endswith("bad.wav")] == ["ValueError: samples before their format"]
    table = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(str(tmp_path))
    good = lambda rows: {(r["path"], r["block_idx"]): r for r in rows if r["error"] is None}
    assert good(S.wav_blocks(table, 1000).collect()) == good(whole.values())


def test_a_three_gigabyte_file_is_many_tasks(spark, tmp_path):
    write_wav(tmp_path / "long.wav", np.zeros((10, 2)))
    frames = 3 * 1024**3 // 4
    with open(tmp_path / "long.wav", "r+b") as f:  # the same header over a sparse file
        f.seek(40)
        f.write((frames * 4).to_bytes(4, "little"))
        f.truncate(44 + frames * 4)
    r = S.wav_ranges(spark, str(tmp_path)).orderBy("first_block").collect()
    assert len(r) == 96 and sum(x["frames"] for x in r) == frames and r[0]["at"] == 44 and all(b["at"] - a["at"] == a["frames"] * 4 for a, b in zip(r, r[1:], strict=False))


def test_inventory_roles(spark, tmp_path):
    for n in ("s_1.wav", "s_master.wav", "t.txt"):
        (tmp_path / n).write_bytes(b"1234")
    rows = {r["path"].rsplit("/", 1)[1]: (r["role"], r["length"]) for r in S.inventory(spark, str(tmp_path)).collect()}
    assert rows == {"s_1.wav": ("stem", 4), "s_master.wav": ("master", 4)}


def test_manifest_is_never_replaced_and_has_fixed_columns(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "id int, v string")
    S.write_manifest(df, f"{tmp_path}/m1", ["v", "absent", "id"], ["id"])
    back = spark.read.parquet(f"{tmp_path}/m1/parquet")
    assert back.columns == ["v", "absent", "id"] and [r["id"] for r in back.collect()] == [1, 2]
    assert spark.read.csv(f"{tmp_path}/m1/csv", header=True).count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        S.write_manifest(df, f"{tmp_path}/m1", ["id"], ["id"])


def test_csv_and_json_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text("song,genre\néa,x\n")
    assert S.read_metadata(spark, str(tmp_path / "m.csv"), "song string, genre string", "song").first()["song"] == "éa"
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "17.json").write_text('{"instrument_cd": "A1",\n "genre_cd": 4}')
    (tmp_path / "j" / "18.json").write_text("{broken")
    got = {r["id"]: r["instrument_cd"] for r in S.read_label_json(spark, str(tmp_path / "j"), "instrument_cd string, genre_cd int").collect()}
    assert got == {"17": "A1", "18": None}


def test_log_lines(spark):
    lines = ["Train epoch: 3 Learning rate: 1e-4", "Instr flute si_sdr: 4.25 (Std: 1)", "Metric avg si_sdr     : nan", "Training loss: 0.41 (over 39997 finite steps; 3 non-finite skipped)", "100%|####| 500/500 [1:02:03<00:00]", "42%|##  | 210/500 [0:30:00<0:41:00, loss=0.2]",
             "=== exp009 finished clean", "=== a_b CRASHED TWICE (exit 1)", "210/500 loss=-inf", "other"]
    rows = L.line_events(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [(r["kind"], r["name"], r["elapsed"]) for r in rows] == [
        ("epoch", None, None), ("class_value", "flute", None), ("average", "si_sdr", None), ("non_finite", None, None), ("bar", None, "1:02:03"), ("trailer", "finished clean", None), ("trailer", "CRASHED TWICE", None), ("nan_loss", "-inf", None),
    ]
    assert [rows[i]["value"] for i in (0, 1, 3, 4)] == [3.0, 4.25, 3.0, 500.0] and rows[2]["value"] != rows[2]["value"]


def test_lines_of_several_events(spark):
    lines = ["100%|##| 7/7 [0:12<00:00, loss=nan]100%|##| 3/3 [1:00:12<00:00] === r1 stopped by SIGINT", "loss=0.2, val_loss=inf Metric avg a: 1.5 Metric avg b: -2", "7/8 [0:12<00:00]", "x/x [0:12<00:00]", "===  CRASHED", "=== r CRASHEDX", "loss=nanometer", None, ""]
    rows = L.line_events(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")).orderBy("i", "place").collect()
    assert [(r["i"], r["kind"], r["name"], r["value"], r["elapsed"]) for r in rows] == [
        (0, "bar", None, 7.0, "0:12"), (0, "nan_loss", "nan", None, None), (0, "bar", None, 3.0, "1:00:12"), (0, "trailer", "stopped by SIGINT", None, None),
        (1, "nan_loss", "inf", None, None), (1, "average", "a", 1.5, None), (1, "average", "b", -2.0, None), (5, "trailer", "CRASHED", None, None),
    ]
    assert [r["place"] for r in rows if r["i"] == 0] == sorted(r["place"] for r in rows if r["i"] == 0)


def test_wav_tables_round_trip_and_clip(spark):
    df = spark.createDataFrame([("a", [[0.5, -0.25, 1.5], [0.0, -1.0, 3 / 65536]])], "name string, ch array<array<double>>")
    r = S.wav_blocks(S.wav_files(df, "name", "ch", 8000)).first()
    assert r["samples"] == [[0.5, -0.25, 32767 / 32768], [0.0, -1.0, 2 / 32768]] and (r["sr"], r["n_frames"], r["error"]) == (8000, 3, None)


def test_programmes_blocks_and_credits(spark):
    df = spark.createDataFrame([(1, "intro\n0:00 Opening\n[1:02:03] - Second part \n1. First\nx a\n2. Next\nflute/kim·lee drum/park voice/kim")], "k int, t string")
    assert [(r["start_s"], r["title"]) for r in L.programme(df, "k", "t").orderBy("pos").collect()] == [(0, "Opening"), (3723, "Second part")]
    assert [(r["number"], r["title"], r["line"]) for r in L.numbered_blocks(df, "k", "t").orderBy("pos").collect()] == [(1, "First", "x a"), (2, "Next", "flute/kim·lee drum/park voice/kim")]
    r = df.select(L.credits(df["t"], ["flute", "voice"], ["lee"]).alias("c")).first()["c"]
    assert [(x["instrument"], x["n"], x["players"]) for x in r] == [("flute", 1, ["kim"]), ("voice", 1, ["kim"])]


def test_short_blocks_leave_a_task_together(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(2).uniform(-0.9, 0.9, (100, 2)).astype(np.float32)
    blocks = [("a", k, 8000, x[k : k + 1], None) for k in range(100)] + [("b", None, None, None, "bad"), ("c", 0, 8000, x, None)]
    (one,) = S._batches(blocks)
    assert one.num_rows == 102 and one.column(4)[100].as_py() is None and np.array_equal(np.array(one.column(4)[101].as_py(), np.float32).T, x)
    monkeypatch.setattr(S, "BATCH_SAMPLES", 40)
    many = list(S._batches(blocks))
    assert [b.num_rows for b in many] == [20, 20, 20, 20, 21, 1] and [r for b in many for r in b.to_pylist()] == one.to_pylist()
    # Arrow batches that leave the decoding of 3,000 files are few
    files = S.wav_files(spark.range(3000).selectExpr("id", "array(array(0.5, 0.25, 0.125)) channels").coalesce(1), "id", "channels", 8000)
    sent = S.wav_blocks(files, 1).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in bs), "n long")
    assert sent.selectExpr("sum(n)", "count(1) < 10").first() == (9000, True)
