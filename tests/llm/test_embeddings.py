import numpy as np
from pyspark.sql import functions as F

from trackworks.llm import embeddings as E

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, least):
    ok = {}
    for i, v, lab in rows:
        a = None if v is None or any(x is None for x in v) else np.array(v, float)
        if a is not None and lab is not None and len(a) and np.isfinite(a).all() and a.any():
            ok[i] = (a / np.linalg.norm(a), lab)
    root = {i: i for i, _, _ in rows}
    n = dict.fromkeys(root, 0)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ok:
        for j in ok:
            if i != j and ok[i][1] == ok[j][1] and len(ok[i][0]) == len(ok[j][0]) and ok[i][0] @ ok[j][0] >= least:
                n[i] += 1
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (n[i], top(i)) for i in root}


def rows_of(seed=0, n=700, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, dim))
    x = np.concatenate([base, base[: n // 3] + rng.normal(scale=0.03, size=(n // 3, dim)), np.repeat(base[:3], n // 9, axis=0), base[5] + rng.normal(scale=0.02, size=(120, dim))])
    return [(i, [float(np.float32(y)) for y in v], int(i % 3)) for i, v in enumerate(x)]


def got(spark, rows, **kw):
    r = E.near_duplicate_vectors(spark.createDataFrame(rows, KIND), 0.98, **kw).collect()
    return {x["vec_id"]: (x["n_links"], x["component_id"]) for x in r}


def test_same_as_brute_force_in_one_shard_and_in_many(spark):
    rows = rows_of()
    want = brute(rows, 0.98)
    assert got(spark, rows) == want
    assert got(spark, rows, shard_rows=60) == want


def test_recall_of_the_graph_alone():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:300] + rng.normal(scale=0.02, size=(300, 32)).astype(np.float32)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    ids, _ = E.Graph(x).search(q, E.SEARCH_BEAM)
    assert (ids[:, 0] == (q @ x.T).argmax(1)).mean() >= 0.9
    truth = (q @ x.T) >= 0.98
    links, audit = E.links_of(E.Graph(x), q, 0.98)
    assert sum(len(a) for _, a in links) >= 0.99 * truth.sum()
    assert audit["links"] >= E.AUDIT_LINKS and audit["hits"] >= 0.99 * audit["links"]


def test_a_stored_graph_finds_what_the_graph_does():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    g = E.Graph(x / np.linalg.norm(x, axis=1, keepdims=True))
    again = E.Graph.unpacked(g.packed())
    assert all((a == b).all() for a, b in zip(g.search(g.x[:50], 32), again.search(g.x[:50], 32), strict=True))


def test_audits_count_links_between_shards_and_leave_selves_out(spark):
    rows = rows_of(5, 900)
    audits = []
    r = E.near_duplicate_vectors(spark.createDataFrame(rows, KIND), 0.98, shard_rows=80, audit=lambda df: audits.extend(df.collect()))
    assert {x["vec_id"]: (x["n_links"], x["component_id"]) for x in r.collect()} == brute(rows, 0.98)
    links, hits = sum(a["links"] for a in audits), sum(a["hits"] for a in audits)
    assert links > 100 and hits >= E.RECALL * links
    alone = [(i, [float(i == j) for j in range(20)], 0) for i in range(20)]
    audits.clear()
    E.near_duplicate_vectors(spark.createDataFrame(alone, KIND), 0.98, audit=lambda df: audits.extend(df.collect()))
    assert [(a["queries"], a["links"]) for a in audits] == [(20, 0)]


def test_an_id_with_several_vectors_is_one_node(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    for rows in ([(5, a, 0), (5, b, 0), (3, b, 0), (7, a, 0)], [(5, a, 0), (5, b, 0), (9, b, 1), (7, a, 0), (7, [1.0, 1.0], 0)]):
        r = E.near_duplicate_vectors(spark.createDataFrame(rows, KIND)).collect()
        least = min(i for i, _, lab in rows if lab == 0)
        assert all(x["component_id"] == (9 if x["vec_id"] == 9 else least) for x in r) and len(r) == len(rows)


def test_odd_vectors_repeats_and_clashes(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None, 0), (2, [0.0, 0.0], 0), (3, [1.0, nan], 0), (4, [inf, 1.0], 0), (5, [1.0, None], 0), (6, [], 0), (7, [1.0, 2.0], None), (8, [1.0, 2.0], 0), (9, [2.0, 4.0], 0), (10, [1.0, 2.0, 0.0], 0), (11, [1e-38, 2e-38], 0), (12, [1.0, 2.0], 1)]
    want = {i: (0, i) for i in range(1, 13)} | {8: (2, 8), 9: (2, 8), 11: (2, 8)}
    assert got(spark, rows) == want
    twice = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0)], KIND).withColumn("n_links", F.lit(5))
    assert sorted(((r["vec_id"], r["n_links"], r["kept"]) for r in E.near_duplicate_vectors(twice).collect()), key=str) == sorted([(1, 1, True), (1, 1, True), (None, 0, True)], key=str)
    assert got(spark, []) == {}


def test_audits_have_links_where_the_vectors_have_none(spark):
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=24).tolist(), 0) for i in range(1500)]
    audits = []
    r = E.near_duplicate_vectors(spark.createDataFrame(rows, KIND), 0.98, shard_rows=400, audit=lambda df: audits.extend(df.collect()))
    assert all(x["n_links"] == 0 and x["kept"] for x in r.collect()) and len(audits) == 4
    assert all(a["links"] == 0 and a["planted"] >= E.AUDIT_PLANTED and a["planted_hits"] >= E.RECALL * a["planted"] for a in audits)


def test_links_planted_between_shards_are_found(spark, monkeypatch):
    """Groups of two and three whose members the shards part, at cosines from just over the threshold; and every pair of shards is searched once."""
    monkeypatch.setattr(E, "STRETCH", 2)
    rng = np.random.default_rng(12)
    base = rng.normal(size=(1200, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(base)]
    for k in range(400):
        away = rng.normal(size=32)
        away -= away @ base[k] * base[k]
        c = rng.uniform(0.9801, 0.9999)
        rows.append((5000 + k, (c * base[k] + np.sqrt(1 - c * c) * away / np.linalg.norm(away)).tolist(), k % 2))
    want = brute(rows, 0.98)
    for shard_rows in (60, 90, 10_000):  # an even and an odd number of shards, and one
        r = {i: x for i, x in got(spark, rows, shard_rows=shard_rows).items()}
        found, there = sum(n for n, _ in r.values()), sum(n for n, _ in want.values())
        assert there >= 800 and all(r[i][0] <= want[i][0] for i in r) and found >= 0.99 * there


def test_double_vectors_keep_their_precision(spark):
    rng = np.random.default_rng(13)
    a = rng.normal(size=16)
    a /= np.linalg.norm(a)
    b = rng.normal(size=16)
    b -= b @ a * a
    b /= np.linalg.norm(b)
    at = lambda c: (c * a + np.sqrt(1 - c * c) * b).tolist()
    rows = [(1, a.tolist(), 0), (2, at(0.98 + 1e-9), 0), (3, (1e200 * np.array(at(0.98 - 1e-9))).tolist(), 0)]
    r = {x["vec_id"]: x["n_links"] for x in E.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.98).collect()}
    assert r == {1: 1, 2: 2, 3: 1}  # 2 and 3 are near each other, 3 not to 1


def test_cells_lose_no_link_and_have_few_guests():
    """Each pair of shards was searched before, so a class met half of the 40 shards."""
    rng = np.random.default_rng(14)
    x = rng.normal(size=(3000, 16))
    x = np.concatenate([x, x + rng.normal(scale=0.15, size=(3000, 16)) * rng.uniform(0, 1, size=(3000, 1)), x[7] + rng.normal(scale=0.3, size=(300, 16))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows, cells = E._cells(x, x[:40], 0.98)
    assert (np.unique(rows) == np.arange(len(x))).all() and len(rows) < 5 * len(x)
    at = {}
    for r, c in zip(rows.tolist(), cells.tolist(), strict=True):
        at.setdefault(r, []).append(c)
    a, b = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
    apart = [(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if at[i][0] != at[j][0]]
    assert len(apart) > 100 and all(at[i][0] in at[j] or at[j][0] in at[i] for i, j in apart)


def test_a_large_group_goes_part_by_part_and_each_link_counts_once(spark, monkeypatch):
    monkeypatch.setattr(E, "STRETCH", 1)
    rng = np.random.default_rng(15)
    x = np.concatenate([rng.normal(size=(300, 16)), rng.normal(size=16) + rng.normal(scale=0.1, size=(500, 16))])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    want = brute(rows, 0.98)
    assert max(n for n, _ in want.values()) > 250 and len({n for n, _ in want.values()}) > 50
    tasks = []
    r = E.near_duplicate_vectors(spark.createDataFrame(rows, KIND.replace("float", "double")), 0.98, shard_rows=100, audit=lambda df: tasks.extend(df.collect()))
    assert {y["vec_id"]: (y["n_links"], y["component_id"]) for y in r.collect()} == want
    assert len(tasks) > 20


def test_a_full_beam_is_not_widened_where_comparing_all_is_cheaper():
    """Rows of large groups went through beams of four times the width, up to an eighth of the shard."""
    rng = np.random.default_rng(16)
    x = np.concatenate([rng.normal(size=(4000, 16)), rng.normal(size=16) + rng.normal(scale=0.05, size=(800, 16))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    g, beams = E.Graph(x), []
    beam = g.search
    g.search = lambda q, width, own=None: beams.append((len(q), width)) or beam(q, width, own)
    found = sum(len(ids) for _, ids in E.links_of(g, x, 0.98)[0])
    assert found == (x @ x.T >= 0.98 - E.SINGLE).sum() and max(w for n, w in beams) <= E.SEARCH_BEAM
