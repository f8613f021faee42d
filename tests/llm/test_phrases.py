"""Tries against dictionaries, words against regular expressions, and collocations against a plain count."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trackworks.llm import phrases


def test_tries_hold_their_keys_and_nothing_else():
    rng = random.Random(1)
    for alphabet, n, longest in ((256, 3000, 5), (3, 400, 9), (200, 20000, 3)):
        keys = sorted({bytes(rng.randrange(alphabet) for _ in range(rng.randint(1, longest))) for _ in range(n)})
        trie = phrases.DoubleArray(*phrases._joined(keys), np.arange(1, len(keys) + 1)).arrays

        def number(key, trie=trie):
            state = np.array([phrases.ROOT])
            for c in key:
                state = phrases.step(trie, state, c)
            return int(trie[2][state[0]])

        assert [number(k) for k in keys] == list(range(1, len(keys) + 1))
        known = set(keys)
        others = {bytes(rng.randrange(256) for _ in range(rng.randint(1, longest))) for _ in range(3000)} - known
        assert not any(number(k) for k in others)
        states = trie[1][trie[1] >= 0]
        assert len(states) == len({k[:i] for k in keys for i in range(1, len(k) + 1)})


def test_an_empty_trie_has_no_keys():
    trie = phrases.DoubleArray(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64)).arrays
    assert phrases.step(trie, np.array([phrases.ROOT]), np.array([65]))[0] == phrases.DEAD


TEXTS = ["", " ", ".", "a", " a", "a ", "a.b", "A b.c D, e\tf", "ä ö. ü", "..a..b  c", "x" * 200 + " y", "\x0b\x0ca\rb\nc d", "\x00 a", "a.", "b c"]


def plain_pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def test_words_are_those_of_plain_expressions():
    data, start, stop, text, fresh = phrases.words_of(pa.array(TEXTS))
    got = [[] for _ in TEXTS]
    for a, b, t, new in zip(start, stop, text, fresh, strict=True):
        word = data[a:b].tobytes().decode()
        got[t].append([word]) if new else got[t][-1].append(word)
    assert got == [[p for p in plain_pieces(t) if p] for t in TEXTS]


def plain(rows, least, first=2000, held=80):
    """Rows of (text, lang): the same by counting everything."""
    f = {}
    for text, lang in rows:
        own = f.setdefault("und" if lang is None else lang, Counter())
        for w in plain_pieces(text):
            own.update(" ".join(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        n = sum(c for p, c in own.items() if " " not in p)
        frequent = {p: c for p, c in own.items() if " " in p and c >= least}
        scored = []
        for p, a in frequent.items():
            if any(100 * c >= held * a and len(q) > len(p) and f" {p} " in f" {q} " for q, c in frequent.items()):
                continue
            w = p.split(" ")
            cuts = [(2_000_000 * a // (own[" ".join(w[:k])] + own[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            scored.append((-score, -a, p.encode(), p, a, own[" ".join(w[:k])], own[" ".join(w[k:])], n, score))
        out += [(lang, i, *x[3:]) for i, x in enumerate(sorted(scored)[:first], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def corpus(n=300, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["Ünder", "x" * 80, "x" * 79 + "y", "new", "york", "city"]
    fixed = ["new york city", "new york", "x" * 80 + " w1", "Ünder w2 w3 w4 w5"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(rng.randint(0, 40)))
        rows.append((text, rng.choice(["en", "en", "de", None, ""])))
    return [*rows, (None, "en"), ("", None), *([rows[0]] * 40)]


@pytest.mark.parametrize("block_bytes", [phrases.BLOCK_BYTES, 150])
def test_collocations_are_those_of_a_plain_count_in_one_block_or_many(spark, block_bytes):
    rows = corpus()
    docs = spark.createDataFrame([(t, g, 1) for t, g in rows], "text string, lang string, phrase int").repartition(5)
    got = rows_of(phrases.collocations(docs, least=8, first=40, block_bytes=block_bytes))
    assert got == plain(rows, 8, 40) and len({g[0] for g in got}) == 4


def test_a_long_text_ties_and_a_ranking_in_parts(spark, monkeypatch):
    rows = [(" ".join(f"a{i % 50} b{i % 50}." for i in range(5000)), "en"), ("z" * 100_000, "en")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(phrases, "ORDERED_ROWS", 10)
    got = rows_of(phrases.collocations(docs, first=7))
    assert got == plain(rows, 30, 7) and [r[2] for r in got] == sorted(f"a{i} b{i}" for i in range(50))[:7]


def test_products_beyond_64_bits_are_exact():
    a, n = 7 * 10**12, 9 * 10**12
    assert phrases.SCALE * a > 2**63 and phrases.SCALE * a // (2 * n) == 777777


def test_nothing_frequent_and_empty_tables(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(spark.createDataFrame([("a b", "en"), (None, None)], "text string, lang string")).count() == 0
    few = spark.createDataFrame([("a. " * 40, "en")], "text string, lang string")
    assert phrases.collocations(few).count() == 0  # frequent words, but no phrase
