"""Divergences against plain sums over all terms, with small shards and tiles too."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from trackworks.llm import divergence


def plain(rows, least=10, top=10):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, d in docs[lang].items() if d >= least]
        v, sources = len(kept), sorted(s for g, s in groups if g == lang)
        all_n = {t: sum(count[lang, s][t] for s in sources) for t in kept}

        def share(c, n, v=v, kept=kept):
            total = sum(n[t] for t in kept)
            return {t: 1 + 10**9 * (n[t] + 2) // (total + 2 * v) for t in kept}

        p = {s: share(None, count[lang, s]) for s in sources}
        q = share(None, all_n)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[lang, s][t] > 0 and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -x, i) for i, (x, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", o, -x, i) for i, (x, _, o) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def corpus(n=500, sources=7, seed=5):
    rng = random.Random(seed)
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["Ärger", "ärger", "日本", "X-y", "a1b"]
    rows = []
    for _ in range(n):
        s = rng.randrange(sources)
        text = rng.choice(["", " ", "--"]).join(rng.choice([words[s], rng.choice(words), rng.choice(words[:30])]) + rng.choice([" ", ".", "\n"]) for _ in range(rng.randint(0, 25)))
        rows.append((text, rng.choice(["en", "en", "fr", None]), rng.choice([f"s{s}", f"s{s}", None, ""])))
    return [*rows, (None, "en", "quiet"), ("", "zz", "one"), ("12", "zz", "two"), ("12", "zz", None), ("word", "yy", "alone"), *([rows[1]] * 30)]


@pytest.mark.parametrize("shard_terms,shard_sources", [(divergence.SHARD_TERMS, divergence.SHARD_SOURCES), (9, 2)])
def test_divergences_are_those_of_plain_sums(spark, shard_terms, shard_sources):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, n int, term string").repartition(4)
    assert got(divergence.source_divergence(docs, shard_terms=shard_terms, shard_sources=shard_sources)) == plain(rows)


def test_joined_and_broadcast_totals_give_the_same(spark, monkeypatch):
    rows = corpus(200, 4, 6)
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    assert got(divergence.source_divergence(spark.createDataFrame(rows, "text string, lang string, source string"))) == plain(rows)


def test_long_texts_and_empty_tables(spark):
    assert divergence.source_divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
    rows = [("ab cd " * 200_000, "en", "long"), *[("ab cd ef", "en", "short")] * 12, ("q" * 1_000_000, "en", "word")]
    assert got(divergence.source_divergence(spark.createDataFrame(rows, "text string, lang string, source string"))) == plain(rows)


def test_shares_are_exact_beyond_64_bits(spark):
    counts, total, terms = [0, 1, 10**12, 4 * 10**15 - 1], 4 * 10**15 + 9, 12345
    want = [1 + 10**9 * (c + 2) // (total + 2 * terms) for c in counts]
    assert divergence.shares(np.array(counts), np.array([total]), terms).tolist() == want
    df = spark.createDataFrame([(c, total, terms) for c in counts], "n long, total long, terms long")
    assert [r[0] for r in df.select(divergence._share("n", "total", "terms")).collect()] == want
