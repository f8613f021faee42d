import numpy as np
import pytest
from pyspark.sql import functions as F

from trackworks.operators import sequences as Q
from trackworks.operators import signals as X
from trackworks.operators import spectral as S


def test_loudness_of_sines_and_silence(spark):
    sr, size = 8000, 8192
    t = np.arange(5 * size) / sr
    one = np.sin(2 * np.pi * 997 * t)
    rows = []
    for name, channels in (("mono", [one]), ("stereo", [one, one]), ("half", [one / 2]), ("silent", [one * 0])):
        for at in range(0, len(t), size):
            rows.append((name, sr, at, [c[at : at + size].tolist() for c in channels]))
    df = spark.createDataFrame(rows, "file_id string, sr int, start long, samples array<array<double>>")
    got = {r["file_id"]: r["lufs"] for r in S.integrated_loudness(df).collect()}
    assert got["mono"] == pytest.approx(-3.01, abs=0.1)
    assert got["stereo"] == pytest.approx(0.0, abs=0.1)
    assert got["half"] == pytest.approx(-9.03, abs=0.1)
    assert got["silent"] is None
    small = [(n, s, a + k, [c[k : k + 2048] for c in x]) for n, s, a, x in rows for k in range(0, size, 2048)]
    again = {r["file_id"]: r["lufs"] for r in S.integrated_loudness(spark.createDataFrame(small, df.schema)).collect()}
    assert again["mono"] == pytest.approx(got["mono"], abs=1e-9)


def test_envelope_does_not_depend_on_stored_blocks(spark):
    x = np.random.default_rng(0).normal(size=1000)
    want = [10 * np.log10((x[i : i + 90] ** 2).mean()) for i in range(0, 990, 90)]
    for size in (1000, 64, 7):
        df = spark.createDataFrame([("a", i, x[i : i + size].tolist()) for i in range(0, 1000, size)], "f string, start long, s array<double>")
        got = [r["dbfs"] for r in S.level_envelope(df, "f", "start", "s", 90).orderBy("block_idx").collect()]
        assert np.allclose(got, want)


def test_mix_weights_are_recovered(spark):
    rng = np.random.default_rng(1)
    stems = rng.normal(size=(3, 4, 50))
    w = [0.5, 1.0, 2.0]
    a = spark.createDataFrame([(1, b, s, stems[s, b].tolist()) for s in range(3) for b in range(4)], "song int, block int, stem int, samples array<double>")
    m = spark.createDataFrame([(1, b, sum(w[s] * stems[s, b] for s in range(3)).tolist()) for b in range(4)], "song int, block int, samples array<double>")
    got = {r["stem"]: r["weight"] for r in S.mix_weights(a, m, "song", "block", "stem").collect()}
    assert np.allclose([got[s] for s in range(3)], w, atol=1e-4)


def test_flatness_of_noise_and_of_a_tone(spark):
    rng = np.random.default_rng(2)
    t = np.arange(256)
    df = spark.createDataFrame([(1, rng.normal(size=256).tolist()), (2, np.sin(2 * np.pi * 16 * t / 256).tolist())], "k int, samples array<double>")
    f = {r["k"]: r["flatness"] for r in S.flatness(S.spectra(df, ["k"]), ["k"], 4, 100).collect()}
    assert f[1] > 0.3 > 0.01 > f[2]


def test_scores_have_closed_forms(spark):
    x = np.random.default_rng(3).normal(size=200)
    df = spark.createDataFrame([(1, x.tolist(), (x / 2).tolist()), (2, x.tolist(), x.tolist()), (3, x.tolist(), (x * 0).tolist())], "k int, r array<double>, e array<double>")
    s = {r["k"]: r for r in X.score(df, ["k"], "r", "e", ["si_sdr", "usdr"]).collect()}
    assert s[1]["usdr"] == pytest.approx(6.0206, abs=1e-3) and s[1]["si_sdr"] > 90
    assert s[2]["usdr"] == 100.0 and s[3]["usdr"] == pytest.approx(0.0, abs=1e-6)
    with pytest.raises(ValueError, match="unknown"):
        X.score(df, ["k"], "r", "e", ["pesq"])


def test_limiter_never_exceeds_the_ceiling(spark):
    x = np.random.default_rng(4).normal(size=300)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, i int, v double")
    r = S.limiter_gain(df, "k", "i", "v", 0.8, 5).collect()
    assert max(abs(q["v"] * q["gain"]) for q in r) <= 0.8 + 1e-12


def test_covering_picks_cover(spark):
    rows = [(i, c) for i in range(30) for c in ("x" if i % 2 else "y", f"r{i % 7}")]
    picks = [r["i"] for r in Q.covering_picks(spark.createDataFrame(rows, "i int, c string"), "i", "c", 2).collect()]
    counts = {c: sum(1 for i, k in rows if k == c and i in picks) for c in {c for _, c in rows}}
    assert all(n >= 2 for n in counts.values())


def test_stratified_picks_fill_up(spark):
    df = spark.createDataFrame([("a", float(t), float(t % 10)) for t in range(0, 50)], "k string, t double, s double")
    r = Q.stratified_picks(df, "k", "t", "s", 0.0, 100.0, 10, 3.0).collect()
    assert len([x for x in r if not x["filled"]]) == 5 and len(r) == 10
    at = sorted(x["t"] for x in r)
    assert min(b - a for a, b in zip(at, at[1:], strict=False)) >= 3.0


def test_window_loudness_keeps_silent_windows_and_flags_them(spark):
    sr, size = 8000, 2000
    t = np.arange(4 * sr + 900) / sr
    x = np.sin(2 * np.pi * 997 * t) * np.where((t >= 1) & (t < 3), 0.0, 1.0) * np.where(t >= 3, 0.5, 1.0)
    rows = [(name, sr, at, [(g * x[at : at + size]).tolist()]) for name, g in (("a", 1.0), ("none", 0.0)) for at in range(0, len(x), size)]
    df = spark.createDataFrame(rows, "file_id string, sr int, start long, samples array<array<double>>")
    got = {(r["file_id"], r["window"]): r for r in S.window_loudness(df, 1.0).collect()}
    assert sorted(got) == [(f, w) for f in ("a", "none") for w in range(4)]  # the last, partial second goes
    a = [got["a", w] for w in range(4)]
    assert a[0]["lufs"] == pytest.approx(-3.01, abs=0.1) and a[3]["lufs"] == pytest.approx(-9.03, abs=0.2)
    assert [a[w]["measurable"] for w in (0, 2, 3)] == [True, False, True] and a[2]["lufs"] is None and a[2]["minus_file"] is None  # window 1 has the filter's decay
    whole = S.integrated_loudness(df).filter("file_id = 'a'").first()["lufs"]
    assert a[0]["minus_file"] == pytest.approx(a[0]["lufs"] - whole)
    assert not any(got["none", w]["measurable"] for w in range(4))


def test_spectra_of_mixed_lengths_and_medians(spark):
    rng = np.random.default_rng(5)
    blocks = [(i % 2, i, rng.normal(size=n)) for i, n in enumerate([16, 16, 8, 16, 16, 0, 16, 16])]
    df = spark.createDataFrame([(k, i, x.tolist()) for k, i, x in blocks], "k int, i int, samples array<double>")
    got = {(r["i"], r["bin"]): r["power"] for r in S.spectra(df, ["k", "i"]).collect()}
    want = {i: np.abs(np.fft.rfft(x * np.hanning(len(x)))) ** 2 for _, i, x in blocks if len(x)}
    assert set(got) == {(i, b) for i, p in want.items() for b in range(len(p))} and all(np.isclose(got[i, b], want[i][b]) for i, b in got)
    long = S.spectra(df.filter("size(samples) = 16"), ["k"])
    for r in S.median_spectrum(long, ["k"]).collect():
        assert np.isclose(r["level_db"], 10 * np.log10(np.median([want[i][r["bin"]] for k, i, x in blocks if k == r["k"] and len(x) == 16])))


def test_noise_is_put_at_its_ratio_and_crests_skip_silence(spark):
    rng = np.random.default_rng(6)
    x, n = rng.normal(size=500), rng.normal(size=500)
    df = spark.createDataFrame([(1, x.tolist(), n.tolist()), (2, (x * 0).tolist(), n.tolist()), (3, x.tolist(), (n * 0).tolist())], "k int, s array<double>, n array<double>")
    got = {r["k"]: np.array(r["s"]) for r in X.with_noise(df, "s", "n", 15.0).collect()}
    assert 10 * np.log10((x**2).sum() / ((got[1] - x) ** 2).sum()) == pytest.approx(15.0)
    assert (got[2] == 0).all() and np.allclose(got[3], x)
    parts = [x[i : i + 50] for i in range(0, 500, 50)] + [np.zeros(50)]
    b = spark.createDataFrame([("f", i, p.tolist()) for i, p in enumerate(parts)] + [("silent", 0, [0.0] * 4)], "f string, i int, samples array<double>")
    r = X.block_crests(b, ["f"], "i").collect()
    crests = [20 * np.log10(np.abs(p).max() / np.sqrt((p**2).mean())) for p in parts[:-1]]
    assert len(r) == 1 and r[0]["crest_p50_db"] == pytest.approx(np.percentile(crests, 50), abs=1e-5) and r[0]["crest_p95_db"] == pytest.approx(np.percentile(crests, 95), abs=1e-5)


def plain_k(x, sr):
    """Both filters as plain recursions."""
    for b, a in S.k_coefficients(sr):
        y = np.zeros_like(x)
        x1 = x2 = y1 = y2 = 0.0
        for i, v in enumerate(x):
            y[i] = b[0] * v + b[1] * x1 + b[2] * x2 - a[1] * y1 - a[2] * y2
            x2, x1, y2, y1 = x1, v, y1, y[i]
        x = y
    return x


def test_k_weighting_is_the_plain_recursion_over_ten_minutes():
    sr = 4000
    t = np.arange(600 * sr) / sr
    x = np.sin(2 * np.pi * 440 * t) * (1 + 0.3 * np.sin(2 * np.pi * 0.1 * t)) + 0.2
    f, state, parts = S.k_weighting(sr), np.zeros(4), []
    for at in range(0, len(x), 100_003):
        y, state = f.run(x[at : at + 100_003], state)
        parts.append(y)
    assert np.abs(np.concatenate(parts) - plain_k(x, sr)).max() < 1e-9


def test_hops_are_those_of_one_recursion_whatever_the_blocks(spark):
    sr, rng = 8000, np.random.default_rng(8)
    x = rng.normal(size=(2, 5000))
    want = sum(plain_k(c, sr) ** 2 for c in x)
    for size in (5000, 700, 37):
        rows = [("f", sr, at, x[:, at : at + size].tolist()) for at in range(0, 5000, size)]
        df = spark.createDataFrame(rows, "file_id string, sr int, start long, samples array<array<double>>").repartition(3)
        got = {r["hop"]: r["e"] for r in S._hops(df).collect()}
        assert sorted(got) == list(range(6)) and all(abs(got[k] - want[k * 800 : k * 800 + 800].sum()) < 1e-9 * got[k] + 1e-9 for k in got)


def test_vector_sums_of_uneven_blocks(spark, monkeypatch):
    monkeypatch.setattr(X, "SUM_SAMPLES", 50)
    rng = np.random.default_rng(9)
    rows = [(k, g, rng.normal(size=n)) for k, g, n in [(i % 7, None if i % 3 else "x", int(rng.integers(0, 12))) for i in range(300)]]
    df = spark.createDataFrame([(k, g, x.tolist()) for k, g, x in rows] + [(1, "x", None), (99, "n", [])], "k int, g string, samples array<double>").repartition(6)
    want = {}
    for k, g, x in rows:
        if len(x):
            have = want.get((k, g), np.zeros(0))
            n = max(len(have), len(x))
            want[k, g] = np.pad(have, (0, n - len(have))) + np.pad(x, (0, n - len(x)))
    got = {(r["k"], r["g"]): np.array(r["samples"]) for r in X.vector_sum(df, ["k", "g"]).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    (whole,) = X.vector_sum(df.select("samples"), []).collect()
    assert np.allclose(whole["samples"][0], sum(x[0] for *_, x in rows if len(x)))
    plan = X.vector_sum(df, ["k", "g"])._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan.lower()


def test_bus_residual_goes_to_the_loudest_stem(spark):
    rng = np.random.default_rng(10)
    stems = rng.normal(size=(3, 40))
    df = spark.createDataFrame([("s", i, x.tolist()) for i, x in enumerate(stems)], "song string, stem int, samples array<double>")
    got = {r["stem"]: np.array(r["samples"]) for r in X.bus_allocated(df, ["song"], "stem", 0.7, 0.5).collect()}
    assert np.allclose(sum(got.values()), np.clip(0.7 * stems.sum(0), -0.5, 0.5))
    top = np.abs(stems).argmax(0)
    assert all(np.allclose(got[i][top != i], 0.7 * stems[i][top != i]) for i in range(3))


def test_interpolation_and_limiter_in_chunks(spark):
    rng = np.random.default_rng(11)
    n = 500
    level = rng.normal(size=n) * 2
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(level)], "k string, idx long, level double").repartition(5)
    at = sorted(rng.choice(n, 30, replace=False).tolist())
    points = spark.createDataFrame([("a", i, float(i % 13)) for i in at], "k string, idx long, gain double")
    got = [r["gain"] for r in S.interpolated(df, points, "k", "idx", "gain", chunk=11).orderBy("idx").collect()]
    assert np.allclose(got, np.interp(np.arange(n), at, [i % 13 for i in at]))
    need = np.where(np.abs(level) > 1.5, 1.5 / np.abs(level), 1.0)
    low = np.array([need[i : i + 4].min() for i in range(n)])
    want = [min(low[max(0, i - 3) : i + 1].mean(), need[i]) for i in range(n)]
    assert np.allclose([r["gain"] for r in S.limiter_gain(df, "k", "idx", "level", 1.5, 3, chunk=10).orderBy("idx").collect()], want)


def test_a_loudness_profile_resumes_and_ranks(spark):
    rng, sr = np.random.default_rng(12), 4000
    rows, want = [], {}
    for f in range(24):
        loud = 2.0 if f % 4 == 0 or f == 5 else rng.uniform(0.05, 0.4)
        x = loud * np.clip(rng.normal(size=2400), -1, 1) if f % 4 == 0 or f == 5 else loud * rng.normal(size=2400)
        want[f] = 20 * np.log10(np.abs(x).max() / np.sqrt((x**2).mean()))
        rows += [(f, sr, at, [x[at : at + 500].tolist()]) for at in range(0, 2400, 500)]
    rows.append((99, sr, 0, [[0.0] * 2400]))
    df = spark.createDataFrame(rows, "file_id int, sr int, start long, samples array<array<double>>").repartition(3)
    whole = {r["file_id"]: r for r in S.loudness_measures(df).collect()}
    assert all(whole[f]["crest_db"] == pytest.approx(want[f]) for f in want) and whole[99]["lufs"] is None
    done = S.loudness_measures(df.filter("file_id < 10"))
    again = {r["file_id"]: r for r in S.loudness_measures(df, done).collect()}
    assert again.keys() == whole.keys() and all(again[f]["lufs"] == pytest.approx(whole[f]["lufs"]) for f in want)
    m = S.loudness_measures(df).selectExpr("*", "file_id % 2 as dataset")
    r = {x["file_id"]: x for x in S.profile_ranking(m, "dataset", F.col("file_id") % 4 == 0, 1e-3).collect()}
    assert 99 not in r and 0 not in r and r[5]["rank_in_dataset"] == 1 and r[5]["sources_in_dataset"] == 12 and r[2]["sources_in_dataset"] == 6
