"""Quality and toxicity: held-out accuracy, exact inference, odd rows."""

import copy
import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackworks.llm import quality as Q
from trackworks.llm import toxicity as T
from trackworks.llm.logistic import Logistic

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(0)
    score, a = rng.normal(size=11), rng.normal(size=4)
    first = np.array([0, 4, 4, 11])
    p = T.Chain.marginals(*T.Chain.ratios(score, first, a))
    for s, e in ((0, 4), (4, 11)):
        total, on = 0.0, np.zeros(e - s)
        for y in itertools.product((0, 1), repeat=e - s):
            w = sum(score[s + i] for i in range(e - s) if y[i]) + a[3] * y[0]
            w += sum({(0, 1): a[0], (1, 0): a[1], (1, 1): a[2]}.get(pair, 0) for pair in zip(y, y[1:], strict=False))
            total += np.exp(w)
            on += np.exp(w) * np.array(y)
        assert np.allclose(p[s:e], on / total)


def test_segments_join_as_one_chain():
    rng = np.random.default_rng(1)
    score, a = rng.normal(size=1000) * 3, np.array([-3.0, -2.0, 4.0, 0.5])
    p = T.Chain.marginals(*T.Chain.ratios(score, np.array([0, 1000]), a))
    r = np.exp(score[0] + a[3])
    f = [r]
    for s in score[1:]:
        r = np.exp(s) * (np.exp(a[0]) + r * np.exp(a[2])) / (1 + r * np.exp(a[1]))
        f.append(r)
    b, g = 1.0, [1.0]
    for s in score[:0:-1]:
        b = (np.exp(a[1]) + np.exp(a[2] + s) * b) / (1 + np.exp(a[0] + s) * b)
        g.append(b)
    z = np.array(f) * np.array(g[::-1])
    assert np.allclose(p, z / (1 + z))


def test_toxicity_of_held_out_documents(tables):
    docs, labels = tables
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = T.fit_toxicity(docs, labels, usable=~held)
    rows = T.score_toxicity(docs.filter(held), model).join(labels, "doc_id").select("toxic", "toxicity", "text").collect()
    wrong = sum((r["toxicity"]["score"] >= 0.5) != (r["toxic"] == 1) for r in rows)
    assert wrong <= 0.06 * len(rows)
    spans = [r["text"].encode()[s["start"] : s["end"]].decode() for r in rows for s in r["toxicity"]["spans"]]
    assert spans


def test_toxicity_of_odd_rows(spark, tables, make_docs):
    docs, labels = tables
    model = T.fit_toxicity(docs, labels)
    odd = make_docs((1, None), (1, None), (2, ""), (3, "…"), (4, "fine words " * 20_000), (5, "you idiot scum")).withColumn("toxicity", F.lit(1))
    r = {x["doc_id"]: x for x in T.score_toxicity(odd, model).collect()}
    assert len(r) == 5 and r[1]["_toxicity"]["score"] == r[2]["_toxicity"]["score"] < 0.5 and r[1]["toxicity"] == 1 and r[4]["_toxicity"]["spans"] == []
    nothing = T.fit_toxicity(docs, labels.limit(0))
    assert {x["toxicity"]["score"] for x in T.score_toxicity(make_docs("a", None), nothing).collect()} == {0.5}
    nulls = labels.withColumns({"toxic": F.lit(None).cast("int")})
    assert T.fit_toxicity(docs, nulls).top is None
    assert T.score_toxicity(make_docs(), model).count() == 0


def test_quality_of_unseen_labels(tables):
    docs, labels = tables
    unseen = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = Q.fit_quality(docs, labels.filter(~unseen))
    assert model.views is not None
    rows = Q.score_quality(docs, model).join(labels.filter(unseen).withColumnRenamed("quality", "y"), "doc_id").select(F.col("quality.score").alias("s"), "y").collect()
    wrong = sum((r["s"] >= 0.5) != (r["y"] == 1) for r in rows)
    assert wrong <= 0.06 * len(rows)


def test_quality_of_odd_rows(tables, make_docs):
    docs, labels = tables
    model = Q.fit_quality(docs, labels)
    odd = make_docs((1, None), (1, None), (2, ""), (None, "w " * 50_000)).withColumns({"lang": F.lit(None).cast("string"), "quality": F.lit(2), "view_text": F.lit("x")})
    r = Q.score_quality(odd, model).collect()
    assert len(r) == 4 and all(0 <= x["_quality"]["score"] <= 1 and x["quality"] == 2 and x["view_text"] == "x" for x in r)
    assert Q.score_quality(make_docs(), model).count() == 0
    flat = Q.fit_quality(docs, labels.filter("quality = 1"))
    assert flat.views is None and Q.score_quality(make_docs("a"), flat).first()["quality"]["score"] == 1.0
    assert Q.fit_quality(docs.limit(0), labels.limit(0)).prior == 0.5


def test_quality_scores_mean_the_same_above_and_below_the_cap(tables):
    docs, _ = tables
    labels = docs.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) != 0).cast("int").alias("quality"))  # four fifths, whatever the text
    for per_class in (100_000, 100):
        model = Q.fit_quality(docs, labels, per_class=per_class)
        assert model.views is not None
        mean = Q.score_quality(docs, model).agg(F.avg("quality.score")).first()[0]
        assert 0.7 < mean < 0.9, (per_class, mean)


def test_quality_prior_is_the_share_of_all_labels():
    y = np.array([1] * 4 + [0])
    assert Q.CoTrained(np.zeros((5, 1)), np.zeros((5, 1)), y, None, (1.0, 10.0)).prior == 40 / 41


def plain_step(m, z, y, gradient, hessian):
    """One bounded step in a loop over rows."""
    g, h = np.array(gradient, float), np.array(hessian, float)
    ridge = np.array([1.0] * (z.shape[1] - 1) + [1e-3])
    for row, label in zip(z, y, strict=True):
        g = g + row * (1 / (1 + np.exp(-np.clip(row @ m.w, -30, 30))) - label)
        h = h + np.outer(row, row) / 4
    return m.w - np.linalg.solve(h + np.diag(ridge), g + ridge * m.w)


def plain_labels(p, prior):
    """Weights of the labels 0 and 1 by row: the surest rows of each class, found by sorting whole bins."""
    at = np.minimum((p * Q.BINS).astype(int), Q.BINS - 1)
    zero, one = np.zeros(len(p)), np.zeros(len(p))
    for want, order, out in ((Q.TAUGHT * (1 - prior) * len(p), sorted(set(at)), zero), (Q.TAUGHT * prior * len(p), sorted(set(at), reverse=True), one)):
        taken = 0
        for b in order:
            if taken >= want:
                break
            out[at == b] = 1
            taken += (at == b).sum()
    return zero * np.clip((prior - p) / prior, 0, 1), one * np.clip((p - prior) / (1 - prior), 0, 1)


def test_quality_is_that_of_co_training_row_by_row(tables):
    """All rows of the pool teach: the fit in Spark gives the weights of a plain loop over every row."""
    docs, labels = tables
    labels = labels.filter("doc_id % 2 = 0")  # half of the labelled rows join the pool
    model = Q.fit_quality(docs, labels)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "n_chars", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect()
    said = {r["doc_id"]: r["quality"] for r in labels.filter("quality in (0, 1)").collect()}
    text = Q.text_view(pa.array([r["text"] for r in rows])).astype(float)
    meta = Q.metadata_view(np.array([r["n_chars"] for r in rows], float), [r["lang"] for r in rows], [r["source"] for r in rows]).astype(float)
    y = np.array([said.get(r["doc_id"], -1) for r in rows])
    assert (y < 0).sum() > 200
    known, pool = np.flatnonzero(y >= 0), np.flatnonzero(y < 0)
    train = known[np.arange(len(known)) % 5 != 0]
    held = known[np.arange(len(known)) % 5 == 0]
    prior = y[known].mean()
    students = [Logistic(x[train], y[train].astype(float)) for x in (text, meta)]
    for _ in range(Q.ROUNDS):
        sure = []
        for m, x in zip(students, (text, meta), strict=True):
            c = Logistic(m.logit(x[held])[:, None], y[held])
            sure.append(plain_labels(c.predict(m.logit(x[pool])[:, None]), prior))
        for _ in range(Q.STEPS):
            weights = []
            for k, x in enumerate((text, meta)):
                m, g, h = students[k], 0, 0
                for c in (0, 1):
                    w = sure[1 - k][c]
                    share = min(1, (y[train] == c).sum() / max(1, w.sum()))
                    for z, own in zip(m.design(x[pool]), w, strict=True):
                        g, h = g + share * own * z * (1 / (1 + np.exp(-np.clip(z @ m.w, -30, 30))) - c), h + share * own * np.outer(z, z) / 4
                weights.append(plain_step(m, m.design(x[train]), y[train], g, h))
            for k, w in enumerate(weights):
                students[k] = copy.copy(students[k])
                students[k].w = w
    for mine, plain in zip(model.views, students, strict=True):
        assert np.allclose(mine.w, plain.w, atol=1e-6)


def planted(n, seed, metadata=1.5):
    """Two views of rows, either of which tells the class about as well, and the classes."""
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.7).astype(int)
    return rng.normal(size=(n, 4)) + 1.5 * y[:, None], rng.normal(size=(n, 3)) + metadata * y[:, None], y


def pool_of(text, meta):
    return lambda f: f(text, meta)


def test_both_views_teach_both_classes():
    text, meta, y = planted(200, 1)
    more_text, more_meta, _ = planted(5000, 2)
    model = Q.CoTrained(text, meta, y, pool_of(more_text, more_meta))
    assert len(model.taught) == Q.ROUNDS and all(n > 0.01 * 5000 for views in model.taught for view in views for n in view)
    new_text, new_meta, truth = planted(4000, 3)
    alone = Q.CoTrained(text, meta, y, None)
    right = lambda m: ((m.predict(new_text, new_meta)[0] >= 0.5) == truth).mean()
    assert right(model) >= right(alone) - 0.005 and right(model) > 0.95


def test_one_wrong_label_moves_a_view_no_further_than_a_row_of_its_own():
    text, meta, y = planted(400, 4)
    text += 4 * y[:, None]  # the text view is all but certain
    alone = Q.CoTrained(text, meta, y, None)
    wrong_text, wrong_meta = np.full((1, 4), 6.0), np.full((1, 3), -3.0)  # good by its text, bad by its metadata
    model = Q.CoTrained(text, meta, y, pool_of(wrong_text, wrong_meta))
    assert any(n for views in model.taught for n in views[0])  # the text view was taught it
    new_text, new_meta, truth = planted(2000, 5)
    new_text += 4 * truth[:, None]
    a, b = alone.predict(new_text, new_meta)[1], model.predict(new_text, new_meta)[1]
    assert ((b >= 0.5) == truth).mean() > 0.995 and np.abs(a - b).max() < 0.1


def test_a_view_that_knows_nothing_spoils_nothing():
    text, meta, y = planted(400, 6, metadata=0.0)
    more_text, more_meta, _ = planted(6000, 7, metadata=0.0)
    new_text, new_meta, truth = planted(3000, 8, metadata=0.0)
    right = lambda m: ((m.predict(new_text, new_meta)[0] >= 0.5) == truth).mean()
    assert right(Q.CoTrained(text, meta, y, pool_of(more_text, more_meta))) >= right(Q.CoTrained(text, meta, y, None)) - 0.01


def test_a_class_that_one_view_never_labels():
    text, meta, y = planted(300, 9)
    more_text, _, _ = planted(1000, 10)
    model = Q.CoTrained(text, meta, y, pool_of(more_text, np.full((1000, 3), 5.0)))  # by its metadata the whole pool is good
    assert model.taught[0][0][0] == 0 < model.taught[0][0][1] and min(model.taught[0][1]) > 0


def test_a_repeated_id_adds_no_rows_to_the_sample(spark, tables):
    docs, labels = tables
    again = docs.filter("doc_id < 40")
    for _ in range(3):
        again = again.unionByName(again)
    once, twice = Q.fit_quality(docs, labels), Q.fit_quality(docs.unionByName(again), labels)
    assert once.top is not None and twice.prior == once.prior and len(twice.top.w) == len(once.top.w)


def test_a_repeated_id_is_one_text_of_the_toxicity_sample(tables):
    docs, labels = (t.select(*c) for t, c in zip(tables, (("doc_id", "text"), ("doc_id", "toxic")), strict=True))
    again = docs.filter("doc_id < 60")
    for _ in range(4):
        again = again.unionByName(again)
    once, often = T.fit_toxicity(docs, labels), T.fit_toxicity(docs.unionByName(again), labels)
    assert once.top is not None and np.allclose(once.crf.w, often.crf.w) and np.allclose(once.top.w, often.top.w)


def test_toxicity_sample_is_not_crowded_out_by_a_long_text(spark, tables):
    docs, labels = (t.select(*c) for t, c in zip(tables, (("doc_id", "text"), ("doc_id", "toxic")), strict=True))
    early = spark.range(10**9, 10**9 + 500_000).orderBy(F.xxhash64("id")).first()["id"]  # first of all in hash order
    long = spark.range(1).select(F.lit(early).alias("doc_id"), F.expr("repeat('word ', 2000000)").alias("text"))
    plain = T.fit_toxicity(docs, labels)
    model = T.fit_toxicity(docs.unionByName(long), labels.unionByName(long.select("doc_id", F.lit(1).alias("toxic").cast(labels.schema["toxic"].dataType))))
    assert model.top is not None and np.allclose(model.crf.w, plain.crf.w)
    only = labels.filter("toxic = 0").unionByName(long.select("doc_id", F.lit(1).alias("toxic").cast(labels.schema["toxic"].dataType)))
    with pytest.raises(ValueError, match="nothing to fit"):
        T.fit_toxicity(docs.unionByName(long), only)
