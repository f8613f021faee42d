from pyspark.sql import functions as F

from trackworks.llm import lines as L


def test_site_relative_share(spark, make_docs):
    a = make_docs(*[(i, f"head \nbody {i}\n\nfoot" if i < 5 else f"head\nbody {i}") for i in range(10)], source="a")
    b = make_docs(*[(100 + i, f"page {i}" if i else "head\npage 0") for i in range(10)], source="b")
    for broadcast in (1000, 0):
        got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in L.without_boilerplate(a.unionByName(b), "source", max_share=0.5, removed="n_removed", broadcast_lines=broadcast).collect()}
        assert got[0] == ("body 0\n\nfoot", 1)  # foot is on half of the pages only
        assert got[7] == ("body 7", 1)
        assert got[100] == ("head\npage 0", 0)


def test_nulls_empty_texts_repeats_and_extra_columns(spark, make_docs):
    d = make_docs((1, None), (2, ""), (3, "x\nyyy"), (3, "x\nyyy"), (4, "x")).withColumn("source", F.lit(None).cast("string")).withColumn("site_key", F.lit(1)).withColumn("n_removed", F.lit(9))
    rows = L.without_boilerplate(d, "source", max_share=0.4, removed="n_removed").collect()
    assert sorted((r["doc_id"], r["text"], r["_n_removed"], r["n_removed"]) for r in rows if r["text"] is not None) == [(2, "", 0, 9), (3, "yyy", 1, 9), (3, "yyy", 1, 9), (4, "", 1, 9)]
    assert [r["_n_removed"] for r in rows if r["text"] is None] == [0]
    assert L.without_boilerplate(d.limit(0), "source").count() == 0


def test_a_long_line_is_one_line(spark, make_docs):
    own = [f"own {i} " + "y" * 200_000 for i in range(4)]
    d = make_docs(*["z" * 200_000 + f"\n{t}" for t in own])
    assert {r["text"] for r in L.without_boilerplate(d, "source").collect()} == set(own)


def test_a_page_may_end_empty(spark, make_docs):
    frame = "\n".join(f"line {i} of the frame" for i in range(6))
    d = make_docs(*[f"{frame}\nown {i}" for i in range(30)], frame)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in L.without_boilerplate(d, "source", removed="n_removed").collect()}
    assert got == {i + 1: (f"own {i}", 6) for i in range(30)} | {31: ("", 6)}


def test_many_lines_of_a_site_and_clashing_names(spark, make_docs):
    frame = [f"frame line {i}" for i in range(300)]
    d = make_docs(*["\n".join([*frame, f"own {i}"]) for i in range(4)]).withColumns({"kept_lines": F.lit(1), "site_lines": F.lit(2), "line": F.lit(3), "site": F.lit(4)})
    for broadcast in (1000, 0):
        rows = L.without_boilerplate(d, "source", broadcast_lines=broadcast).collect()
        assert sorted(r["text"] for r in rows) == [f"own {i}" for i in range(4)] and all((r["kept_lines"], r["site_lines"], r["line"], r["site"]) == (1, 2, 3, 4) for r in rows)


def test_every_page_loses_the_lines_and_copies_count_once(spark, make_docs):
    head = " ".join(["a line that all pages of the site have"] * 5)
    copy = "\n".join(f"line {i} of the page" for i in range(10))
    d = make_docs(*[f"{head}\nown {i}" for i in range(6)], *[copy] * 5, head, None)
    for broadcast in (1000, 0):
        rows = L.without_boilerplate(d, "source", removed="n_removed", broadcast_lines=broadcast, copies_once=True).collect()
        got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in rows}
        assert [got[i + 1] for i in range(6)] == [(f"own {i}", 1) for i in range(6)]
        assert [got[i] for i in range(7, 12)] == [(copy, 0)] * 5 and got[12] == ("", 1) and got[13] == (None, 0)


def test_the_ratio_is_of_other_pages_at_any_size(spark, make_docs):
    rows = [(s, n, k) for s, n, k in [("one", 1, 1), ("two", 2, 2), ("fifty", 50, 2), ("more", 52, 2), ("hundred", 101, 3), ("few", 101, 2)]]
    d = make_docs(*[(1000 * i + j, "shared\nown" + str(j) if j < k else f"own {j}") for i, (_, n, k) in enumerate(rows) for j in range(n)])
    site = F.element_at(F.array(*[F.lit(s) for s, _, _ in rows]), (F.col("doc_id") / 1000).cast("int") + 1)
    gone = {r["source"] for r in L.without_boilerplate(d.withColumn("source", site), "source", removed="gone").filter("gone > 0").collect()}
    # 1 of 1, 1 of 49 and 2 of 100 other pages: only the first two are over 2 %
    assert gone == {"two", "fifty"}
