"""Edge rows, on hand-made frames."""

import random

import pytest
from pyspark.sql import functions as F

from trackworks.operators import columns as C
from trackworks.operators import gates, joins, sampling
from trackworks.operators import sequences as S


def levels(spark, *values):
    return spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "k string, idx long, level double")


def spans(df):
    return sorted((r["start"], r["end"]) for r in df.collect())


def test_hysteresis_opens_at_equal_and_closes_at_equal(spark):
    df = levels(spark, 5, 2, 1, 4, 5, 0)
    assert spans(S.hysteresis_segments(df, "k", "idx", "level", 5.0, 1.0)) == [(0, 2), (3, 5)]
    assert spans(S.hysteresis_segments(levels(spark, 2, 3, 4), "k", "idx", "level", 5.0, 1.0)) == []


def test_gap_of_exactly_min_gap_is_kept(spark):
    df = spark.createDataFrame([("a", 0, 2), ("a", 5, 6), ("a", 8, 9)], "k string, start long, end long")
    assert spans(S.bridged(df, "k", 3)) == [(0, 2), (5, 9)]


def test_merged_touching_nested_identical_and_empty(spark):
    df = spark.createDataFrame([("a", 0, 2), ("a", 2, 3), ("a", 5, 9), ("a", 6, 7), ("a", 5, 9)], "k string, start long, end long")
    assert spans(S.merged(df, "k")) == [(0, 3), (5, 9)]
    assert spans(S.merged(df.limit(0), "k")) == []


def test_tail_stops_at_the_end_of_the_file(spark):
    df = levels(spark, 9, 9, 9)
    assert spans(S.segments(df, "k", "idx", "level", 5, 1, 2, 1, 10)) == [(0, 3)]


def test_edge_silence_without_any_activity(spark):
    r = S.edge_silence(levels(spark, 0, 0), "k", "idx", F.col("level") > 1).first()
    assert (r["head"], r["tail"]) == (2, 2)


def test_greedy_spaced_takes_the_best_first(spark):
    df = spark.createDataFrame([("a", 0.0, 3), ("a", 1.0, 1), ("a", 2.0, 2), ("a", 5.0, 4)], "k string, at double, rank int")
    assert [r["at"] for r in S.greedy_spaced(df, "k", "at", "rank", 5, 2.0).orderBy("pick").collect()] == [1.0, 5.0]


def test_coverage_of_a_span_over_two_windows(spark):
    df = spark.createDataFrame([("a", 5, 15)], "k string, start long, end long")
    assert {(r["window"], r["cov"]) for r in S.coverage(df, "k", 10.0).collect()} == {(0, 0.5), (1, 0.5)}


def test_intersections_come_once_over_bucket_borders(spark):
    a = spark.createDataFrame([("x", 0.0, 100.0)], "k string, start double, end double")
    b = spark.createDataFrame([("x", 5.0, 95.0), ("x", 100.0, 120.0)], "k string, start double, end double")
    got = joins.interval_intersections(a, b, ["k"], 1.0, bucket=10.0).collect()
    assert [(r["start"], r["end"]) for r in got] == [(5.0, 95.0)]


def test_asof_before_the_first_is_null(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5)], "k string, t long")
    right = spark.createDataFrame([("a", 3, 7.0), ("a", 5, 8.0)], "k string, t long, v double")
    assert {(r["t"], r["v"]) for r in joins.asof(left, right, ["k"], "t", "v").collect()} == {(1, None), (5, 8.0)}


def test_gates_raise(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, v string")
    with pytest.raises(gates.GateError):
        gates.require_unique(df, "k")
    with pytest.raises(gates.GateError):
        gates.require_present(df, "v")
    with pytest.raises(gates.GateError):
        gates.require_constant(df, "v", "k")
    with pytest.raises(gates.GateError):
        joins.validated_left(df, spark.createDataFrame([(1, "x")], "k int, w string"), "k")
    assert gates.require_unique(df.filter("k = 2"), "k").count() == 1


def test_prefix_offsets_over_partitions(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("n"))
    got = {r["id"]: r["at"] for r in joins.prefix_offsets(df, "id", "n", "at", parts=8).collect()}
    assert all(got[i] == sum(j % 7 for j in range(i)) for i in range(100))


def test_level_and_elapsed_edges(spark):
    r = spark.range(1).select(C.level_db(F.lit(0.0)).alias("a"), C.level_db(F.lit(1.0)).alias("b"), C.elapsed_seconds(F.lit("1:02:03")).alias("c"), C.elapsed_seconds(F.lit("x")).alias("d"), C.blocks_of(F.lit(1.25), 0.5).alias("e")).first()
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == (-120.0, 0.0, 3723, None, 2)


def test_results_do_not_depend_on_order_or_partitions(spark):
    df = levels(spark, *[(i * 37) % 11 for i in range(200)])
    args = ("k", "idx", "level", 8, 3, 3, 2, 1)
    assert spans(S.segments(df.coalesce(1), *args)) == spans(S.segments(df.orderBy(F.rand(3)).repartition(7), *args))


def plain_greedy(rows, n, gap, picked=()):
    picked = list(picked)
    for at in rows:
        if len(picked) < n and all(abs(at - p) >= gap for p in picked):
            picked.append(at)
    return picked


def test_greedy_picks_over_many_fine_positions(spark):
    rng = random.Random(4)
    rows = [(k, i / 100, rng.randint(0, 40)) for k in "ab" for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, at double, rank int").repartition(5)
    got = {}
    for r in S.greedy_spaced(df, "k", "at", "rank", 4, 6.0).orderBy("k", "pick").collect():
        got.setdefault(r["k"], []).append(r["at"])
    for k in "ab":
        assert got[k] == plain_greedy([at for _, at in sorted((r, at) for kk, at, r in rows if kk == k)], 4, 6.0)


def test_stratified_picks_fill_what_bins_leave(spark):
    rng = random.Random(5)
    rows = [(k, float(i), rng.randint(0, 30)) for k in range(6) for i in rng.sample(range(100), 12 + 10 * k)]
    df = spark.createDataFrame(rows, "k int, at double, score int")
    got = {}
    for r in S.stratified_picks(df, "k", "at", "score", 20.0, 80.0, 6, 7.0).collect():
        got.setdefault(r["k"], set()).add((r["at"], r["filled"]))
    for k in range(6):
        own = sorted(((-s, at) for kk, at, s in rows if kk == k and 20 <= at < 80))
        best = {}
        for s, at in own:
            best.setdefault(int((at - 20) // 10), at)
        rest = [at for _, at in own if at not in best.values()]
        all_ = plain_greedy(rest, 6, 7.0, best.values())
        assert got.get(k, set()) == {(at, at not in best.values()) for at in all_}


def test_covering_picks_are_those_of_a_plain_loop(spark):
    rng = random.Random(6)
    for least in (1, 3):
        holds = {i: set(rng.sample("abcdefgh", rng.choice([1, 1, 2, 3]))) for i in range(60)}
        df = spark.createDataFrame([(i, c) for i, own in holds.items() for c in own], "item int, cls string")
        have = {c: sum(c in own for own in holds.values()) for c in "abcdefgh"}
        need, want, left = {c: min(least, n) for c, n in have.items()}, [], dict(holds)
        while short := sorted((c for c in need if need[c] > 0), key=lambda c: (have[c], c)):
            best = min((i for i in left if short[0] in left[i]), key=lambda i: (-len(left[i] & set(short)), i))
            want.append(best)
            for c in left.pop(best):
                need[c] -= 1
        assert [r["item"] for r in S.covering_picks(df, "item", "cls", least).orderBy("pick").collect()] == want


def clusters(spark, mode, parts, **kw):
    rng = random.Random(9)
    classes = list("abcde")
    spans, anchors = [], []
    for song in range(12):
        own = {c: sorted(rng.sample(range(0, 400, 10), 2)) for c in rng.sample(classes, rng.choice([2, 3, 4]))}
        spans += [(song, c, float(a), float(b)) for c, (a, b) in own.items()]
        anchors += [(song, c, d, float(max(own[c][0], own[d][0])), float(min(own[c][1], own[d][1]))) for c in own for d in own if c < d and min(own[c][1], own[d][1]) - max(own[c][0], own[d][0]) >= 20]
    items = [(i, rng.sample(classes, rng.choice([2, 3, 5])), rng.choice([0, 2, 3, 5])) for i in range(60)]
    rows = sampling.cluster_fill(
        spark.createDataFrame(items, "item int, classes array<string>, k int").repartition(parts), "item", spark.createDataFrame(anchors, "song int, class_a string, class_b string, start double, end double").repartition(parts),
        spark.createDataFrame(spans, "song int, class string, start double, end double").repartition(parts), 3, 50.0, mode, **kw,
    ).collect()
    return items, anchors, spans, rows


@pytest.mark.parametrize("mode", ["uniform", "overlap_weighted", "greedy"])
def test_cluster_fill_keeps_its_rules(spark, mode):
    items, anchors, spans, rows = clusters(spark, mode, 3)
    assert sorted(map(str, rows)) == sorted(map(str, clusters(spark, mode, 7)[3]))  # partitions change nothing
    held = {}
    for song, c, a, b in spans:
        held.setdefault(song, {})[c] = (a, b)
    for item, classes, k in items:
        own = [r for r in rows if r["item"] == item]
        picks, reasons = [r for r in own if r["class"]], [r["reason"] for r in own if r["reason"]]
        assert len({r["class"] for r in picks}) == len(picks) <= min(k, len(classes)) and {r["class"] for r in picks} <= set(classes)
        left, need = set(classes), min(k, len(classes))
        for n in sorted({r["cluster"] for r in picks}):
            mine = [r for r in picks if r["cluster"] == n and r["role"] == "member"]
            (song,), (start,) = {r["song"] for r in mine}, {r["start"] for r in mine}
            can = [s for s in held if any(s == a[0] and {a[1], a[2]} <= left for a in anchors)]
            assert song in can and any(a[0] == song and {a[1], a[2]} <= left and (a[3] <= start and start + 50 <= a[4] or start <= a[3] and a[4] <= start + 50 or a[4] - a[3] >= 50) for a in anchors)
            heard = {c for c, (a, b) in held[song].items() if c in left and min(b, start + 50) - max(a, start) > 12.5}
            assert {r["class"] for r in mine} <= heard and len(mine) == min(len(heard), need) >= 2
            if mode == "greedy":
                assert len(set(held[song]) & left) == max(len(set(held[s]) & left) for s in can) and n == 0
            left -= {r["class"] for r in mine}
            need -= len(mine)
        if "no_eligible_anchor" in reasons:
            assert need >= 2 and not any({a[1], a[2]} <= left for a in anchors)
        elif need == 1 and picks:
            assert reasons == ["r1_dropped"]
        elif need >= 2:
            assert mode == "greedy" and reasons == ["greedy_single_anchor"]
        else:
            assert not reasons
    assert {r["role"] for r in rows} >= {"member"} and len({r["song"] for r in rows}) > 3


def test_cluster_fill_draws_melodic_members_first(spark):
    _, _, _, rows = clusters(spark, "uniform", 3, melodic=["a", "b", "c"], min_melodic=2)
    by = {}
    for r in rows:
        if r["class"]:
            by.setdefault((r["item"], r["cluster"]), []).append(r["class"])
    assert by and all(sum(c in "abc" for c in own) >= 2 for own in by.values())


def test_rules_must_match_and_reports_count(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, None)], "k int, v string")
    rules = spark.createDataFrame([(1, None), (2, "b"), (None, "a"), (3, None), (1, "b")], "k int, v string")
    assert sorted(map(tuple, gates.unmatched(rules, df, ["k", "v"]).collect()), key=str) == [(1, "b"), (3, None)]
    with pytest.raises(gates.GateError):
        gates.require_matched(rules, df, ["k", "v"])
    assert gates.require_matched(rules.limit(0), df, ["k", "v"]).count() == 3
    report = gates.constraint_report(unique=gates.not_unique(df, "k"), present=gates.absent(df, "v"), fine=gates.absent(df, "k"))
    assert {r["rule"]: r["n"] for r in report.collect()} == {"unique": 1, "present": 1, "fine": 0}


def test_clusters_look_at_anchors_one_by_one_only_for_songs_drawn(spark, monkeypatch):
    fitting = sampling._fitting

    def seen(sets, pairs):
        assert sorted(pairs.columns) == ["class_a", "class_b", "song"] and pairs.count() == pairs.distinct().count()
        return fitting(sets, pairs)

    monkeypatch.setattr(sampling, "_fitting", seen)
    assert clusters(spark, "uniform", 3)[3]
