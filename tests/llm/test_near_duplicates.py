import math
import random
import re

from pyspark.sql import functions as F

from trackworks.llm import near_duplicates as N
from trackworks.llm.components import connected_components


def shingles(text, k=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if x]
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(docs, percent):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def got(docs, percent, **kw):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(docs, percent, **kw).collect()}


def family(rng, n, size, edits, base=None):
    words = base or [f"w{rng.randint(0, 5000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 9999)}"
        out.append(" ".join(w))
    return out


def test_same_as_brute_force(make_docs):
    rng = random.Random(3)
    texts = [t for _ in range(12) for t in family(rng, 8, rng.choice([30, 80, 200]), 3)] + family(rng, 4, 3, 0) + ["A b C", "a B c", "", " \n", None, "one", "ONE"]
    docs = list(enumerate(texts, 10))
    assert got(make_docs(*docs), 85) == brute(docs, 85)
    assert got(make_docs(*docs), 80) == brute(docs, 80)


def test_a_hub_that_is_not_the_smallest_id(make_docs):
    """Variants differ from each other but not from the middle one, whose id is the largest; tiles are tiny."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for k in range(30):
        w = list(base)
        w[5 + 6 * k] = f"x{k}"
        w[8 + 5 * k] = f"y{k}"
        texts.append(" ".join(w))
    docs = list(enumerate([*texts, " ".join(base)], 1))
    rng.shuffle(docs)
    for percent in (91, 94):
        assert got(make_docs(*docs), percent, tile=4) == brute(docs, percent)


def test_many_copies_long_texts_and_odd_rows(make_docs):
    long = " ".join(f"t{i}" for i in range(30_000))
    docs = [(i, "the same text of six words") for i in range(300)] + [(1000, long), (1001, long + " tail"), (1002, "alone here")]
    r = got(make_docs(*docs), 85)
    assert {c for i, (_, c) in r.items() if i < 300} == {0} and r[1001][1] == 1000 and r[1002] == (1, 1002)
    odd = make_docs((None, "the same text"), (5, "the same text"), (5, "other words entirely"), (7, "other words entirely")).withColumn("component_id", F.lit(3))
    rows = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in N.near_duplicates(odd, 85).collect()), key=str)
    assert rows == sorted([(None, None, True), (5, 5, True), (5, 5, True), (7, 5, False)], key=str)
    assert got(make_docs(), 85) == {}


def test_an_id_with_several_texts_is_one_node(make_docs):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = N.near_duplicates(make_docs((5, a), (5, b), (3, b), (7, a)), 85).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in rows) == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False)]
    rows = N.near_duplicates(make_docs((5, a), (5, b), (8, b + " tail"), (7, a + " tail"), (9, "else")), 85).collect()
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(5, 5), (8, 5), (7, 5), (9, 9)}


def test_one_of_each_group_stays(make_docs):
    d = make_docs((3, "a b c d e f g"), (1, "a b c d e f g"), (9, "q"), (None, "q"), (10, None)).withColumn("gone", F.lit("x"))
    kept = N.deduplicated(d)
    assert kept.columns == d.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 9, 10, None], key=str)


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(500, 500 + i) for i in range(1, 60)] + [(900, 901), (901, 902), (902, 900), (7, 7), (None, 3)]
    rng.shuffle(edges)
    r = {x["id"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(r[i] == 0 for i in range(41)) and all(r[500 + i] == 500 for i in range(60)) and r[902] == 900 and len(r) == 104
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_tiles_are_bounded_by_the_bytes_of_sets(spark, make_docs, monkeypatch):
    """Long texts of one bucket, of which the first is near to few, are dealt into tiles of about TILE_BYTES: the same links."""
    rng = random.Random(21)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(3000)]
    docs = list(enumerate(family(rng, 14, 0, 60, base) + family(rng, 6, 0, 5, base) + ["other text"], 1))
    want = brute(docs, 85)
    for tile_bytes in (N.TILE_BYTES, 60_000):
        monkeypatch.setattr(N, "TILE_BYTES", tile_bytes)
        assert got(make_docs(*docs), 85) == want


def test_the_sketch_bar_loses_less_than_banding():
    """The chance that a pair right at the threshold has too few equal minima, against that of sharing no band."""
    n = N.BANDS * N.ROWS
    for percent, band_loss in ((85, 3e-10), (80, 2e-7)):
        s, bar = percent / 100, math.ceil(N._least(percent))
        few = sum(math.comb(n, k) * s**k * (1 - s) ** (n - k) for k in range(bar))
        assert few < 0.1 * band_loss and few < 2e-10 and (1 - s**N.ROWS) ** N.BANDS < 1.2 * band_loss
