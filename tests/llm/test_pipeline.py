"""The pipeline's stages against plain versions of them, on planted documents."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.test_near_duplicates import brute as plain_groups
from tests.llm.test_packing import plain_best_fit
from trackworks.llm import decontamination as D
from trackworks.llm import lines as L
from trackworks.llm import quality as Q
from trackworks.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stage_order_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [k for k, _ in P.STAGES] == ["quality", "line dedup", "near-duplicates", "decontamination", "packing"]
    for _, f in P.STAGES[:-1]:
        done = f(spark, docs, SF)
        assert done.columns == docs.columns
        assert done.schema.simpleString() == docs.schema.simpleString()
        docs = done


def test_packed_are_what_the_stages_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, f in P.STAGES[:-1]:
        docs = f(spark, docs, SF).cache()
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {r["doc_id"] for r in P.run(spark, SF).select("doc_id").collect()} == kept
    bench = [set(" ".join(w[i : i + 10]) for i in range(len(w) - 9)) for w in (D.words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect())]
    windows = set().union(*bench)
    for r in docs.collect():
        w = D.words(r["text"])
        assert not any(" ".join(w[i : i + 10]) in windows for i in range(len(w) - 9))


def test_planted_cases(spark, make_docs):
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice(["the", "and", "of", "thing", "ented", "oron", "er", "tion", "blew"]) + rng.choice(["", "", "s", "ing", "th"]) for _ in range(120)).capitalize() + "."
    clean = [text() for _ in range(20)]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    planted = [(i, t) for i, t in enumerate(clean)] + [(100 + i, t) for i, t in enumerate(clean[:5])] + [(200, clean[10].replace("thing", "thong", 1)), (300, clean[11][:400] + "\n" + item + "\n" + text())]
    docs = make_docs(*planted)
    deduped = {r["doc_id"] for r in P.near_duplicate_stage(spark, docs, SF).collect()}
    assert deduped >= set(range(20)) and not deduped & {100, 101, 102, 103, 104, 200}
    left = {r["doc_id"]: r["text"] for r in P.decontamination_stage(spark, docs, SF).collect()}
    assert all(left[i] == t for i, t in enumerate(clean)) and item not in left.get(300, "")


def test_line_stage_takes_boilerplate_from_short_pages_too(spark, make_docs):
    head = " ".join(["a line that all pages of the site have"] * 5)
    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in P.line_stage(spark, make_docs(*[f"{head}\nown {i}" for i in range(6)]), SF).collect()}
    assert left == {i + 1: (f"own {i}", 5) for i in range(6)}


def plain_lines(docs):
    """Lines that over 2 % of the other different texts of a source have go from every text."""
    pages, counts = {}, {}
    for text, source in {(t or "", s or "") for _, t, s in docs}:
        pages[source] = pages.get(source, 0) + 1
        for line in {x.strip(" ") for x in text.split("\n")} - {""}:
            counts[source, line] = counts.get((source, line), 0) + 1
    bad = {k for k, n in counts.items() if n - 1 > L.MAX_SHARE * (pages[k[0]] - 1)}
    return [(i, t if t is None else "\n".join(x for x in t.split("\n") if (s or "", x.strip(" ")) not in bad), s) for i, t, s in docs]


def plain_cut(docs, bench):
    """Benchmark windows of ten words are cut from the texts; texts of which over half is such go."""
    out = []
    for i, text, s in docs:
        w, spans, hit = list(D.WORD.finditer((text or "").translate({i: i + 32 for i in range(65, 91)}))), [], set()
        low = D.words(text)
        for n, windows in bench.items():
            for j in range(len(low) - n + 1):
                if tuple(low[j : j + n]) in windows:
                    hit.update(range(j, j + n))
        if len(hit) > 0.5 * max(1, len(low)):
            continue
        for j in sorted(hit):
            if spans and spans[-1][1] == j:
                spans[-1][1] = j + 1
            else:
                spans.append([j, j + 1])
        for a, b in reversed(spans):
            text = text[: w[a].start()] + text[w[b - 1].end() :]
        out.append((i, text, s))
    return out


def test_all_stages_are_those_of_plain_code(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = Q.fit_quality(docs, labels)
    rows = docs.collect()
    text = Q.text_view(pa.array([r["text"] or "" for r in rows]))
    size = np.array([r["n_chars"] if r["n_chars"] is not None else len(r["text"] or "") for r in rows], float)
    score = model.predict(text, Q.metadata_view(size, [r["lang"] or "" for r in rows], [r["source"] or "" for r in rows]))[0]
    left = [(r["doc_id"], r["text"], r["source"]) for r, s in zip(rows, score, strict=True) if s >= P.LEAST_QUALITY]
    assert 0 < len(left) < len(rows)
    left = plain_lines(left)
    groups = plain_groups([(i, t) for i, t, _ in left], 80)
    left = [r for r in left if groups[r[0]][1] == r[0]]
    bench = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = D.words(r["text"])
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            bench.setdefault(n, set()).add(tuple(w[i : i + n]))
    left = plain_cut(left, bench)
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = {}
    for i, text, _ in left:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want |= {(i, k): ids[at : at + 2048] for k, at in enumerate(range(0, len(ids), 2048))}
    got = P.run(spark, SF).collect()
    assert {(r["doc_id"], r["piece"]): r["ids"] for r in got} == want and len(got) == len(want)
    assert len({r["sequence_id"] for r in got}) == len(plain_best_fit([len(x) for x in want.values()], 2048))


def test_stages_take_nulls_repeats_clashes_and_empty_tables(spark, make_docs):
    clash = {"quality": F.lit(1), "site_lines": F.lit("x"), "cid": F.lit(2), "contamination": F.lit(3), "piece": F.lit(4), "ids": F.lit(5)}
    odd = make_docs((1, None), (1, None), (2, ""), (None, "words " * 50_000), (3, "tie"), (3, "tie")).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")} | clash)
    for name, f in P.STAGES:
        for df in (odd, odd.limit(0)):
            done = f(spark, df, SF)
            rows = done.collect()
            if name != "packing":
                assert done.schema.simpleString() == odd.schema.simpleString()
            if name not in ("packing", "quality"):
                assert len(rows) == (6 if df is odd else 0), name
            assert df is odd or not rows
