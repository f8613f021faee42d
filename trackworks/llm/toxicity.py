"""Toxic spans by a linear-chain conditional random field; document scores from its forward-backward marginals."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackworks.llm.logistic import Logistic
from trackworks.llm.shared import Words, alnum_words, ascii_fold, own_name, passed_through, random_words, slices, stored, with_columns

#: Labelled documents of each class that the model is fitted on at most, taken in the order of a hash of their ids.
SAMPLE_PER_CLASS = 1500
#: Bytes of text that the sample may have; documents beyond it are left out of the fit.
SAMPLE_BYTES = 12 << 20
#: Texts of more bytes are sampled only after all others of their class, shortest first, so that they crowd out none.
LONG_TEXT_BYTES = 256 << 10
#: A word or affix marks tokens as toxic if so many toxic sample documents have it, so many times as often as others.
LEAST_DOCS, LEAST_ODDS = 4, 15.0
PREFIXES, SUFFIXES = (4, 5, 6), (4,)
_BITS = (18, 16, 16, 16, 16)
SEGMENT = 64
#: Tokens whose messages the fit holds at a time.
FIT_TOKENS = 100_000


def token_features(w: Words) -> np.ndarray:
    """Rows of feature numbers, a column a token: the word, its first 4, 5 and 6 bytes and its last 4."""
    n = w.end - w.start
    out = np.zeros((len(_BITS), len(n)), np.int32)
    out[0] = w.hash >> np.uint64(64 - _BITS[0])
    c = random_words(23, 16)
    for k, (size, tail) in enumerate([*((p, False) for p in PREFIXES), *((s, True) for s in SUFFIXES)], 1):
        long = np.flatnonzero(n >= size)
        at = w.end[long] - size if tail else w.start[long]
        h = np.full(len(long), np.uint64(size * 2 + tail))
        for j in range(size):
            h = h + (w.data[at + j].astype(np.uint64) + np.uint64(1)) * c[j]
        out[k, long] = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS[k])).astype(np.int32) | 1
    # tables lie one after the other
    out += np.concatenate([[0], np.cumsum([1 << b for b in _BITS])[:-1]]).astype(np.int32)[:, None]
    return out


class Chain:
    """Two states, 0 clean and 1 toxic. Scores are of state 1; a: transition scores 0->1, 1->0, 1->1, and the start's."""

    @staticmethod
    def ratios(score: np.ndarray, first: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward messages of each token, as state 1's over state 0's.

        Texts are cut into segments that advance side by side. What enters a segment is what the one before let out in
        the last sweep; sweeps repeat until nothing changes, so the result is that of one pass over each whole text.
        """
        n = np.diff(first)
        segs = -(-n // SEGMENT)
        text = np.repeat(np.arange(len(n)), segs)
        place = np.arange(len(text)) - np.repeat(np.cumsum(segs) - segs, segs)
        begin = first[text] + place * SEGMENT
        size = np.minimum(SEGMENT, first[text + 1] - begin)
        idx = begin[:, None] + np.arange(SEGMENT)
        ok = np.arange(SEGMENT) < size[:, None]
        idx = np.where(ok, idx, 0)
        e = np.exp(np.clip(score, -30, 30))[idx]
        t01, t10, t11, start = np.exp(np.clip(a, -20, 20))
        head, tail = place == 0, place == segs[text] - 1
        fwd, bwd = np.zeros(idx.shape), np.zeros(idx.shape)
        enter = np.ones(len(text))
        for _ in range(len(text) + 2):
            r = enter
            for j in range(SEGMENT):
                new = e[:, j] * (t01 + r * t11) / (1 + r * t10)
                if j == 0:
                    new = np.where(head, e[:, 0] * start, new)
                r = np.where(ok[:, j], new, r)
                fwd[:, j] = r
            nxt = np.ones(len(text))
            nxt[1:] = r[:-1]
            nxt[head] = 1
            if not len(text) or np.abs(np.log(nxt) - np.log(enter)).max() < 1e-10:
                break
            enter = nxt
        enter = np.ones(len(text))
        for _ in range(len(text) + 2):
            b = enter
            for j in range(SEGMENT - 1, -1, -1):
                bwd[:, j] = b
                new = (t10 + t11 * e[:, j] * b) / (1 + t01 * e[:, j] * b)
                b = np.where(ok[:, j], new, b)
            nxt = np.ones(len(text))
            nxt[:-1] = b[1:]
            nxt[tail] = 1
            if not len(text) or np.abs(np.log(nxt) - np.log(enter)).max() < 1e-10:
                break
            enter = nxt
        f, g = np.empty(len(score)), np.empty(len(score))
        f[idx[ok]], g[idx[ok]] = fwd[ok], bwd[ok]
        return f, g

    @staticmethod
    def marginals(f: np.ndarray, b: np.ndarray) -> np.ndarray:
        return f * b / (1 + f * b)


class Crf:
    def __init__(self) -> None:
        self.w = np.zeros(sum(1 << b for b in _BITS))
        self.bias = -4.0
        self.a = np.array([-2.0, 0.0, 0.0, -2.0])

    def scores(self, feats: np.ndarray) -> np.ndarray:
        s = np.full(feats.shape[1], self.bias)
        for row in feats:
            s += self.w[row]
        return s

    def fit(self, feats: np.ndarray, first: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3, l2: float = 1e-3) -> None:
        """Adam on the mean log-likelihood; toxic tokens are few, so they weigh more in the step sizes than in the sum."""
        used = np.unique(feats)
        to = np.zeros(len(self.w), np.int32)
        to[used] = np.arange(len(used), dtype=np.int32)
        theta = np.concatenate([self.w[used], [self.bias], self.a])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        pos = max(1.0, y.sum())
        cuts = np.unique([*np.searchsorted(first, np.arange(0, first[-1], FIT_TOKENS)), len(first) - 1])
        for k in range(1, rounds + 1):
            g = np.zeros_like(theta)
            for t0, t1 in zip(cuts[:-1], cuts[1:], strict=True):  # some texts at a time, to keep arrays small
                a, b = first[t0], first[t1]
                self._add_gradient(g, theta, to, feats[:, a:b], first[t0 : t1 + 1] - a, y[a:b])
            g = g / pos - l2 * np.concatenate([theta[: len(used)], np.zeros(5)])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        self.w[used], self.bias, self.a = theta[: len(used)], theta[len(used)], theta[len(used) + 1 :]

    @staticmethod
    def _add_gradient(g: np.ndarray, theta: np.ndarray, to: np.ndarray, feats: np.ndarray, first: np.ndarray, y: np.ndarray) -> None:
        """Adds the gradient of some texts' log-likelihood to g."""
        n, size = len(y), len(theta) - 5
        if not n:
            return
        w, a = theta[:size], theta[size + 1 :]
        s = np.full(n, theta[size])
        for row in feats:
            s += w[to[row]]
        f, b = Chain.ratios(s, first, a)
        p = Chain.marginals(f, b)
        d = y - p
        for row in feats:
            g[:size] += np.bincount(to[row], weights=d, minlength=size)
        g[size] += d.sum()
        inner = np.ones(n, bool)
        inner[first[:-1][first[:-1] < n]] = False
        later, begins = np.flatnonzero(inner), np.flatnonzero(~inner)
        r, e = f[later - 1], np.exp(np.clip(s[later], -30, 30)) * b[later]
        pair = np.stack([np.ones(len(later)), np.exp(a[0]) * e, np.exp(a[1]) * r, np.exp(a[2]) * r * e])
        pair /= pair.sum(0)
        was, now = y[later - 1], y[later]
        g[size + 1 :] += [((1 - was) * now - pair[1]).sum(), (was * (1 - now) - pair[2]).sum(), (was * now - pair[3]).sum(), (y[begins] - p[begins]).sum()]


def document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """By text: log of the expected number of toxic tokens, the largest marginal, and the expected share."""
    n = np.diff(first)
    out = np.zeros((len(n), 3))
    full = np.flatnonzero(n)
    if len(full):
        total = np.add.reduceat(p, first[full])
        out[full] = np.stack([np.log1p(total), np.maximum.reduceat(p, first[full]), np.sqrt(total / n[full])], 1)
    return out


def _sample_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and offsets of the words of many texts, and two least hashes of each text's shingles (0: it has none)."""
    feats, sizes, least = [np.zeros((len(_BITS), 0), np.int32)], [], [np.zeros((0, 2), np.uint64)]
    for b in slices([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])], "text"):
        w = Words(b.column(0), ascii_fold(), alnum_words())
        feats.append(token_features(w))
        sizes.append(np.diff(w.first))
        h, at = w.runs(5)
        begin = np.searchsorted(at, w.first)
        full = np.flatnonzero(np.diff(begin))
        own = np.zeros((b.num_rows, 2), np.uint64)
        if len(full):
            for j, c in enumerate(random_words(29, 2)):
                own[full, j] = np.minimum.reduceat(h * c, begin[full])
        least.append(own)
    return np.concatenate(feats, 1), np.concatenate([[0], np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)]))]).astype(np.int64), np.concatenate(least)


class Model:
    """The fitted field and the regression on its marginals; `scores` and `spans` are what it says of texts."""

    def __init__(self, texts: list[str], labels: np.ndarray, class_rows: tuple[int, int]) -> None:
        feats, first, least = _sample_features(texts)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first))
        self.crf, self.top = Crf(), None
        self.prior = (class_rows[1] + 1) / (sum(class_rows) + 2)
        if not len(doc) or labels.min(initial=1) == labels.max(initial=0):
            return
        y = self._token_labels(feats, doc, least, labels)
        self.crf.fit(feats, first, y.astype(float))
        self.crf.w = self.crf.w.astype(np.float32)
        p = self._marginals(feats, first)
        weight = np.where(labels == 1, class_rows[1] / max(1, labels.sum()), class_rows[0] / max(1, (1 - labels).sum()))
        self.top = Logistic(document_features(p, first), labels, weight)

    @staticmethod
    def _token_labels(feats: np.ndarray, doc: np.ndarray, least: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """A token is toxic if its text is labelled so and a feature of it marks toxic texts; near copies count once."""
        once = np.ones(len(labels), bool)
        for column in least.T:
            known = np.flatnonzero(column)
            _, kept = np.unique(column[known], return_index=True)
            once[np.setdiff1d(known, known[kept])] = False
        y = np.zeros(len(doc), bool)
        n1, n0 = max(1, int((labels[once] == 1).sum())), max(1, int((labels[once] == 0).sum()))
        for row in feats:
            pairs = np.unique(row[once[doc]] * np.int64(len(labels)) + doc[once[doc]])  # a feature and a text, once
            f, t = np.divmod(pairs, len(labels))
            c1, c0 = (np.bincount(f[labels[t] == k], minlength=int(row.max()) + 1) for k in (1, 0))
            marks = (c1 >= LEAST_DOCS) & ((c1 + 0.1) / n1 >= LEAST_ODDS * (c0 + 0.1) / n0)
            y |= marks[row]
        return y & (labels[doc] == 1)

    def _marginals(self, feats: np.ndarray, first: np.ndarray) -> np.ndarray:
        return Chain.marginals(*Chain.ratios(self.crf.scores(feats), first, self.crf.a)) if feats.shape[1] else np.empty(0)

    def read(self, column: pa.Array, least: float = 0.5) -> tuple[np.ndarray, list[list[dict]]]:
        """Scores of texts and their toxic spans (byte offsets, end exclusive, mean marginal)."""
        w = Words(column, ascii_fold(), alnum_words())
        if self.top is None:
            return np.full(len(column), self.prior), [[] for _ in range(len(column))]
        p = self._marginals(token_features(w), w.first)
        score = self.top.predict(document_features(p, w.first))
        hot = np.flatnonzero(p >= least)
        text = np.searchsorted(w.first, hot, side="right") - 1
        spans: list[list[dict]] = [[] for _ in range(len(column))]
        cut = np.flatnonzero((np.diff(hot) > 1) | (np.diff(text) > 0)) + 1
        for own in np.split(hot, cut) if len(hot) else []:
            t = int(np.searchsorted(w.first, own[0], side="right") - 1)
            spans[t].append({"start": int(w.start[own[0]] - w.offsets[t]), "end": int(w.end[own[-1]] - w.offsets[t]), "p": float(p[own].mean())})
        return score, spans


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on at most `per_class` labelled rows of each class (those of `labels` where `usable` holds).

    The ids are chosen from labels and sizes of texts, so that only these rows' texts reach the driver. Null labels, ids
    and texts teach nothing; empty texts are rows like any other; empty tables are without labels; of an id with two labels the larger counts, of one
    with several texts the first by bytes. Without labelled texts of both classes the model
    scores every text with the share of toxic labels. If all texts of a class are too long for its half of SAMPLE_BYTES,
    that is an error.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    if usable is not None:
        known = known.join(labels.filter(usable).select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    sizes = texts.select("id", F.octet_length("text").alias("size")).join(known, "id").groupBy("id", "y").agg(F.max("size").alias("size"))
    sizes = sizes.select("id", "y", F.when(F.col("size") > LONG_TEXT_BYTES, F.col("size")).otherwise(0).alias("long"))
    first = lambda y: sizes.filter(F.col("y") == y).orderBy("long", F.xxhash64("id"), "id").limit(per_class)
    chosen = stored(first(1).unionByName(first(0)), "sample")
    # one row an id, so that a repeated one fills neither the sample nor a task
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "y", "long").agg(F.min("text").alias("text"))
    size = F.sum(F.octet_length("text")).over(_by_class())
    rows = rows.withColumn("so_far", size).filter(F.col("so_far") <= SAMPLE_BYTES // 2).select("id", "text", "y").orderBy("id", "text").collect()
    if len({r["y"] for r in rows}) < 2 and (lost := {r["y"] for r in chosen.select("y").distinct().collect()} - {r["y"] for r in rows}):
        raise ValueError(f"every labelled text of class {lost} has more than {SAMPLE_BYTES // 2} bytes, so there is nothing to fit on")
    return Model([r["text"] for r in rows], np.array([r["y"] for r in rows], dtype=int), (counts.get(0, 0), counts.get(1, 0)))


def _by_class():
    from pyspark.sql import Window

    return Window.partitionBy("y").orderBy("long", F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0)


_KIND = "struct<score:double,spans:array<struct<start:bigint,end:bigint,p:double>>>"


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """`docs` and a struct column of the score (0 to 1) and the toxic spans (byte offsets of the UTF-8 text).

    Whole texts are read, in pieces of bounded size unless one text is longer. Null and empty texts have no spans and
    the score of a text without words; an empty table gives an empty table. Only the text is looked at. Other columns stay; a clash puts underscores before
    `out`. Repeated rows get the same score.
    """
    out, text = own_name(docs, out), own_name(docs, "scanned_text")
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])))])
        for batch in slices(batches, text):
            score, spans = model.read(batch.column(batch.schema.get_field_index(text)))
            rows = pa.array([{"score": float(s), "spans": x} for s, x in zip(score, spans, strict=True)], kind)
            yield with_columns(batch, drop=[text], **{out: rows})

    df = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    return df.mapInArrow(run, passed_through(docs, **{out: _KIND}))
