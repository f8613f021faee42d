"""The registered queries of operators that SQL cannot say, against plain versions over whole small tables."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_packing import plain_best_fit
from tests.llm.test_secrets import brute as plain_secrets
from trackworks.llm import queries, secrets, toxicity

SF = "/root/testdata/sf0.001"


def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def plain_spans(text, count):
    """Base spans by the plain patterns, random ones by a scan of characters; each candidate is counted by the tokenizer."""
    body = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
    base = plain_secrets(text)
    found, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in body:
            end += 1
        if end - at >= 20:
            pad = len(text[end : end + 3]) - len(text[end : end + 3].lstrip("="))
            stop = end + pad if pad in (1, 2) and (end + pad == len(text) or text[end + pad] not in body) else end
            s = text[at:stop]
            kinds = sum((any(c.isdigit() for c in s), any(c.islower() for c in s), any(c.isupper() for c in s)))
            covered = {p for _, a, b in base for p in range(a, b)} >= set(range(at, stop))
            if not secrets.is_known(s) and kinds >= 2 and len(s) <= secrets.MAX_CHARS_PER_TOKEN * count(s) and not covered:
                found.append(("random", at, stop))
        at = max(end, at + 1)
    return sorted(base + found, key=lambda x: (x[1], secrets.KINDS.index(x[0]), x[2]))


def test_op3_spans_are_those_of_plain_code(spark, make_docs):
    vocabulary = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    count = secrets.load_counter(vocabulary, public_tokenizers.PATTERN)
    want = {}
    for i, text in texts(spark).items():
        spans = plain_spans(text, count)
        joined = lambda xs: ",".join(f"{k}:{a}:{b}" for k, a, b in xs)
        want[i] = (hashlib.sha256(joined([x for x in spans if x[0] != "random"]).encode()).hexdigest(), joined(spans), *(sum(x[0] == k for x in spans) for k in ("assign", "access", "hex")))
    got = {r["doc_id"]: (r["base_sha256"], r["spans"], r["n_assign"], r["n_access"], r["n_hex"]) for r in queries.op3_secrets(spark, SF).collect()}
    assert got == want
    rng = random.Random(8)
    token = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-") for _ in range(rng.randint(15, 50)))
    planted = [(i, " ".join(rng.choice([token(), token() + "=", f"name={token()}", "plain words", f"secret: {token()}", "0a" * 18, "é"]) for _ in range(12))) for i in range(80)]
    rows = secrets.find_secrets(make_docs(*planted), vocabulary, public_tokenizers.PATTERN).collect()
    found = {r["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["secrets"]] for r in rows}
    assert found == {i: plain_spans(t, count) for i, t in planted} and sum(k == "random" for own in found.values() for k, _, _ in own) > 50


def test_op4_keeps_good_documents_and_scores_every_row(spark):
    rows = {r["doc_id"]: r for r in queries.op4_quality_classifier(spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert rows.keys() == texts(spark).keys() and all(0 <= r["score"] <= 1 and r["kept"] == (r["score"] >= 0.5) for r in rows.values())
    assert sum(rows[i]["kept"] == (q == 1) for i, q in labels.items() if i in rows) >= 0.9 * len(labels)


def test_op7_is_the_tokenizers_output_in_as_many_bins_as_plain_best_fit(spark):
    t = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    want = {}
    for i, text in texts(spark).items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        want |= {(i, k): (at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))}
    rows = queries.op7_best_fit_packing(spark, SF).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for at in bins.values():
        at.sort()
        assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False)) and sum(at[-1]) <= 2048
    assert len(bins) == len(plain_best_fit([n for _, n, _ in want.values()], 2048))


def plain_score(model, text):
    """Forward and backward over one text, token by token, and the regression on its marginals."""
    w = toxicity.Words(pa.array([text]), toxicity.ascii_fold(), toxicity.alnum_words())
    s = np.clip(model.crf.scores(toxicity.token_features(w)), -30, 30)
    a = model.crf.a
    forward, backward = [], [0.0] * len(s)
    for k, x in enumerate(s):  # log-odds of state 1, given what came before
        r = forward[-1] if k else 0.0
        forward.append(x + a[3] if not k else x + np.logaddexp(a[0], r + a[2]) - np.logaddexp(0, r + a[1]))
    for k in range(len(s) - 2, -1, -1):
        e = s[k + 1] + backward[k + 1]
        backward[k] = np.logaddexp(a[1], a[2] + e) - np.logaddexp(0, a[0] + e)
    p = 1 / (1 + np.exp(-(np.array(forward) + np.array(backward)))) if len(s) else np.zeros(0)
    x = np.array([[np.log1p(p.sum()), p.max(), np.sqrt(p.mean())]]) if len(s) else np.zeros((1, 3))
    return model.top.predict(x)[0]


def test_op9_scores_are_those_of_a_plain_chain_fitted_on_other_rows_only(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in queries.op9_toxicity(spark, SF).collect()}
    own = texts(spark)
    assert got.keys() == own.keys() and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    usable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = toxicity.fit_toxicity(docs, labels.filter(usable))  # labels of held-out rows aren't even there
    for i, text in own.items():
        assert abs(got[i]["score"] - plain_score(model, text)) < 1e-6 and got[i]["predicted"] == (got[i]["score"] >= 0.5)
    known = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    wrong = [i for i, y in known.items() if i in got and got[i]["held_out"] and got[i]["predicted"] != y]
    assert len(wrong) <= max(1, 0.1 * sum(r["held_out"] for r in got.values()))
