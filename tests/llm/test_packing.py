import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trackworks.llm import packing as P
from trackworks.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def plain_best_fit(lengths, capacity):
    """Bins used by best-fit decreasing, one piece at a time."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [c for c in left if c >= n]
        if fits:
            left.remove(min(fits))
            left.append(min(fits) - n)
        else:
            left.append(capacity - n)
    return sorted(left)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for capacity in (7, 32, 100):
        for _ in range(30):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
            counts = {n: lengths.count(n) for n in set(lengths)}
            used = {}
            placed = 0
            for n, _, pieces, each, first, offset in P.best_fit_plan(counts, capacity):
                for r in range(pieces):
                    used.setdefault(first + r // each, []).append((offset + r % each * n, n))
                    placed += 1
            assert placed == len(lengths)
            for at in used.values():
                at.sort()
                assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False))
            assert sorted(capacity - sum(n for _, n in at) for at in used.values()) == plain_best_fit(lengths, capacity)


def test_round_trip(spark, make_docs):
    t = Tokenizer.from_file(PATH)
    texts = {1: "Hello, World. hello", 2: None, 3: "", 4: "long words " * 700, 5: "É\x1cé ΣΑΣ İ <|endoftext|> it's 12 ﬁ", 6: "x" * 9000}
    rows = P.pack_documents(make_docs(*texts.items()).withColumn("piece", F.lit(1)), PATH, capacity=256).collect()
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["length"] == len(r["ids"]) <= 256
    for i, text in texts.items():
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [x for r in own for x in r["ids"]] == [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert [r["start"] for r in own] == [256 * k for k in range(len(own))] and all(r["length"] == 256 for r in own[:-1])
    for at in by_bin.values():
        at.sort()
        assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False)) and sum(n for _, n in at) <= 256


def test_digest_repeats_and_empty(spark, make_docs):
    d = make_docs((1, "same text"), (1, "same text"), (None, "other"))
    rows = P.pack_documents(d, PATH, payload="crc32").collect()
    ids = Tokenizer.from_file(PATH).encode("same text", add_special_tokens=False).ids + [0]
    assert sorted((r["doc_id"] or 0) for r in rows) == [0, 1, 1]
    assert {r["crc32"] for r in rows if r["doc_id"]} == {zlib.crc32(np.array(ids, "<u4").tobytes())}
    assert len({r["sequence_id"] for r in rows}) == 1
    assert P.pack_documents(make_docs(), PATH).count() == 0


def test_words_encode_as_texts():
    rng = random.Random(4)
    alphabet = " \n\t\x1c 　aAzéÉÅÅİΣσςßẞ’'!.,;?<|>endoftext0١½ņ̃́KKǅ漢字한\U0001f600‍_-"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    t = Tokenizer.from_file(PATH)
    assert [x.tolist() for x in P.Encoder(PATH).encode(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_letters_that_normalize_to_a_letter_and_a_mark():
    letters = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x30000)]) if c.isalpha() and not 0x3400 <= ord(c) < 0xD7A4]
    texts = ["\u0938\u095c\u0915", "\u09b8\u09dc\u0995.", "\ufb2a\u05dc\u05d5\u05dd", "ΟΔΟΣ ΣΑΣ. İstanbul", *[f"a{c}b {c}!" for c in letters]]
    t = Tokenizer.from_file(PATH)
    assert [x.tolist() for x in P.Encoder(PATH).encode(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ascii_texts_with_a_table_that_is_always_full():
    rng = random.Random(12)
    printable = [chr(c) for c in range(32, 127)] + list("'s't're've'm'll'd") * 2 + list(" etaoin") * 4
    texts = ["".join(rng.choice(printable) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(chr(rng.randrange(128)) for _ in range(40)) for _ in range(500)] + ["<|endoftext|> It's <|ENDOFTEXT|>.", "A" * 5000 + "!", "x" * 300 + " y.z. ..."]
    t = Tokenizer.from_file(PATH)
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    encoder = P.Encoder(PATH, places=16)
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == want
    assert [x.tolist() for x in P.Encoder(PATH).encode(["", "a", ""])] == [[], t.encode("a", add_special_tokens=False).ids, []]


def test_pieces_carry_the_ids_and_fill_gapless(spark, make_docs):
    rng = random.Random(5)
    docs = make_docs(*[" ".join(rng.choice(["alpha", "Beta.", "gamma", "12", "é!"]) for _ in range(rng.choice([0, 3, 40, 700]))) for _ in range(60)], None)
    t = Tokenizer.from_file(PATH)
    want = {r["doc_id"]: t.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    got, bins = {}, {}
    for r in P.pack_documents(docs.repartition(7), PATH, capacity=100).orderBy("doc_id", "piece").collect():
        own = got.setdefault(r["doc_id"], [])
        assert r["start"] == len(own) and r["length"] == len(r["ids"]) and r["piece"] == r["start"] // 100
        own += r["ids"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == want
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 100
    lengths = [n for own in bins.values() for _, n in own]
    assert len(bins) == len(plain_best_fit(lengths, 100))
