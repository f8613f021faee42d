import random

from pyspark.sql import functions as F

from trackworks.llm import decontamination as D


def brute(docs, bench, k=10):
    out = {}
    windows = {}
    for item, text in bench:
        w = D.words(text)
        n = min(k, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    for i, text in docs:
        w = D.words(text)
        hit, items = set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                found = windows.get(tuple(w[j : j + n]))
                if found:
                    hit.update(range(j, j + n))
                    items |= found
        out[i] = (len(w), len(hit), sorted(items))
    return out


def scanned(docs, bench, **kw):
    hit = F.aggregate("contamination.spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    rows = D.find_contamination(docs, bench, **kw).select("doc_id", "contamination.n_words", hit.alias("h"), "contamination.items").collect()
    return {r["doc_id"]: (r["n_words"], r["h"], r["items"]) for r in rows}


def cases():
    rng = random.Random(5)
    word = lambda: rng.choice(["alpha", "Beta", "gamma", "délta", "漢字", "e1", "zeta"])
    bench = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 4, 10, 14, 40])))) for i in range(12)] + [(90, None), (91, "..."), (92, "uniqueword")]
    docs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        if rng.random() < 0.7:
            parts.append((rng.choice(bench)[1] or "").upper() if rng.random() < 0.3 else rng.choice(bench)[1] or "")
        docs.append((i, ", ".join(parts)))
    return docs + [(100, None), (101, ""), (102, "uniqueword-uniqueword"), (103, "x" * 50_000 + " uniqueword")], bench


def test_same_as_brute_force_in_one_pass_and_in_blocks(spark, make_docs):
    docs, bench = cases()
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = brute(docs, bench)
    assert scanned(make_docs(*docs), b) == want
    assert scanned(make_docs(*docs), b, block_bytes=600) == want


def test_repeated_rows_and_ids_in_blocks_and_a_very_long_text(spark, make_docs):
    b = spark.createDataFrame([(i, f"item {i} has these words one two three four five six") for i in range(40)] + [(99, "lone")], "item_id long, text string")
    long = "pad " * 200_000 + "item 7 has these words one two three four five six"
    docs = make_docs((1, "lone"), (1, "lone"), (2, "item 3 has these words one two three four five six item 4 has these words one two three four five six"), (3, None), (4, long)).withColumn("row_number", F.lit(5))
    rows = D.find_contamination(docs, b, block_bytes=500).collect()
    got = sorted((r["doc_id"], tuple(r["contamination"]["items"]), sum(s["words"] for s in r["contamination"]["spans"]), len(r["contamination"]["spans"]), r["row_number"]) for r in rows)
    assert got == [(1, ("99",), 1, 1, 5), (1, ("99",), 1, 1, 5), (2, ("3", "4"), 22, 1, 5), (3, (), 0, 0, 5), (4, ("7",), 11, 1, 5)]


def test_a_hash_is_no_hit_without_the_words():
    w = D.WindowSet([(1, "one two three"), (2, "ONE two, three"), (3, "four")], 3)
    (h, at, _), (h1, _, _) = w.by_length[3], w.by_length[1]
    assert len(h) == 2 and w.items(3, int(h[0]), b"one two three") == ["1", "2"] and w.items(3, int(h[0]), b"one two four") == []
    assert w.items(1, int(h1[0]), b"four") == ["3"] and w.items(3, 12345, b"one two three") == []


def test_empty_tables_repeated_rows_and_clashing_names(spark, make_docs):
    b = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert scanned(make_docs(), b) == {}
    assert scanned(make_docs("one two three"), b.limit(0)) == {1: (3, 0, [])}
    d = make_docs((1, "one two three"), (1, "one two three")).withColumn("contamination", F.lit(7))
    r = D.find_contamination(d, b).collect()
    assert [(x["contamination"], x["_contamination"]["items"]) for x in r] == [(7, ["1"])] * 2


def test_removal_keeps_clean_documents(spark, make_docs):
    b = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    d = make_docs("clean text é", "été long clean start here, One two THREE. and an end", "one two three", None, "")
    got = {r["doc_id"]: r["text"] for r in D.decontaminate(d, b).collect()}
    assert got == {1: "clean text é", 2: "été long clean start here, . and an end", 4: None, 5: ""}
    assert {r["doc_id"] for r in D.decontaminate(d, b, action="documents").collect()} == {1, 4, 5}


def test_items_without_an_id_are_looked_for_and_not_listed(spark, make_docs):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = make_docs(f"before {passage} after", "short item", "nothing here")
    items = spark.createDataFrame([(None, passage), (None, "short item"), ("k", passage)], "item_id string, text string")
    for block_bytes in (D.BLOCK_BYTES, 30):
        got = {r["doc_id"]: r["contamination"] for r in D.find_contamination(docs, items, block_bytes=block_bytes).collect()}
        assert [sum(s["words"] for s in got[i]["spans"]) for i in (1, 2, 3)] == [11, 2, 0]
        assert [got[i]["items"] for i in (1, 2, 3)] == [["k"], [], []]


def test_a_long_item_is_looked_for_in_pieces(spark, make_docs, monkeypatch):
    rng = random.Random(12)
    said = [f"w{rng.randint(0, 999)}" for _ in range(3000)]
    docs = make_docs(*[f"x {' '.join(said[a : a + n])} y" for a, n in [(0, 10), (45, 12), (95, 30), (2985, 15), (700, 9)]], " ".join(said))
    items = spark.createDataFrame([("long", " ".join(said)), ("other", "a b")], "item_id string, text string")
    hits = lambda: {r["doc_id"]: (sum(s["words"] for s in r["contamination"]["spans"]), r["contamination"]["items"]) for r in D.find_contamination(docs, items, block_bytes=4000).collect()}
    whole = hits()
    for words in (7, 50, 100):
        monkeypatch.setattr(D, "PIECE_BYTES", 100)
        monkeypatch.setattr(D, "PIECE_WORDS", words)
        assert hits() == whole
    assert whole[6] == (3000, ["long"]) and whole[5] == (0, [])
