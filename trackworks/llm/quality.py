"""Document quality by co-training: a text view and a metadata view teach each other, and both score every document."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackworks.llm.logistic import CURVATURE, Logistic, sigmoid
from trackworks.llm.shared import Words, ascii_fold, forget, own_name, passed_through, raw, slices, spaced_words, stored, with_columns

#: Labelled rows of each class that the classifiers are fitted on at most, by a hash of ids.
SAMPLE_PER_CLASS = 4000
#: Rounds, and steps a round.
ROUNDS, STEPS = 3, 2
#: The share of the pool that each view labels a round, dealt to the classes by their prior: its surest rows of each.
TAUGHT = 0.2
#: Bins of a view's probabilities that the surest rows are found by.
BINS = 2000
#: Rows whose views a task holds as numbers at a time.
VIEW_ROWS = 4096
META_BUCKETS = 32
_PUNCT = [b for b in range(33, 127) if not chr(b).isalnum()]


def text_view(column: pa.Array) -> np.ndarray:
    """A row a text: shares of byte classes and of each ASCII mark, word lengths, repetition, line structure."""
    w = Words(column, ascii_fold(), spaced_words())
    o = w.offsets
    n = len(column)
    data, _ = raw(column)
    kinds = np.full(256, len(_PUNCT) + 5, np.int64)
    kinds[_PUNCT] = np.arange(len(_PUNCT))
    for k, span in enumerate(((48, 58), (65, 91), (97, 123), (128, 256))):
        kinds[span[0] : span[1]] = len(_PUNCT) + k
    kinds[10] = len(_PUNCT) + 4
    width = len(_PUNCT) + 6
    doc = np.repeat(np.arange(n), np.diff(o))
    counts = np.bincount(doc * width + kinds[data], minlength=n * width).reshape(n, width)
    size = np.maximum(1, np.diff(o))[:, None]
    words = np.diff(w.first)
    own = w.text_of()
    extra = np.zeros((n, 7))
    if len(own):
        length = (w.end - w.start).astype(float)
        total = np.bincount(own, weights=length, minlength=n) / np.maximum(1, words)
        square = np.bincount(own, weights=length**2, minlength=n) / np.maximum(1, words)
        extra[:, 0], extra[:, 1] = total, np.sqrt(np.maximum(0, square - total**2))
        same = np.zeros(len(own), bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (own[1:] == own[:-1])
        extra[:, 2] = np.bincount(own, weights=same, minlength=n) / np.maximum(1, words)
        order = np.lexsort((w.hash, own))
        h, d = w.hash[order], own[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        distinct = np.bincount(d, weights=new, minlength=n)
        extra[:, 3] = distinct / np.maximum(1, words) ** 0.9
        begin = np.flatnonzero(new)
        run = np.diff(np.append(begin, len(h)))
        most = np.zeros(n)
        np.maximum.at(most, d[begin], run)
        extra[:, 4] = most / np.maximum(1, words)
        mark = (w.data[w.end - 1] >= 33) & ~((w.data[w.end - 1] >= 97) & (w.data[w.end - 1] < 123)) & (w.data[w.end - 1] < 128)
        extra[:, 5] = np.bincount(own, weights=mark, minlength=n) / np.maximum(1, words)
        extra[:, 6] = np.bincount(own, weights=length <= 1, minlength=n) / np.maximum(1, words)
    return np.hstack([np.sqrt(counts / size), extra]).astype(np.float32)


def metadata_view(size: np.ndarray, *names: list[str]) -> np.ndarray:
    """A row a document: hashed one-hot values of `names` and powers of the log size."""
    import zlib

    out = np.zeros((len(size), 3 + META_BUCKETS * len(names)), np.float32)
    log = np.log1p(np.maximum(0, size))
    out[:, 0], out[:, 1], out[:, 2] = log, log**2, size <= 0
    for k, values in enumerate(names):
        out[np.arange(len(size)), 3 + k * META_BUCKETS + np.array([zlib.crc32(v.encode()) % META_BUCKETS for v in values], dtype=int)] = 1
    return out


class Teacher:
    """A view that labels rows of the pool for the other one: calibrated, and only as sure as it beats the labels' prior."""

    def __init__(self, view: Logistic, calibration: Logistic, prior: float) -> None:
        self.view, self.calibration, self.prior = view, calibration, prior
        self.low, self.high = 0, BINS  # bins at or under low are labelled 0, those over high 1; nothing yet

    def _bins(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.calibration.predict(self.view.logit(x)[:, None])
        return p, np.minimum((p * BINS).astype(np.int64), BINS - 1)

    def histogram(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self._bins(x)[1], minlength=BINS).astype(float)

    def chosen(self, histogram: np.ndarray) -> None:
        """The surest rows of each class, by whole bins: as many as its prior's part of TAUGHT, or the few more of the last bin."""
        upward = np.cumsum(histogram)
        n = upward[-1]
        self.low = int(np.searchsorted(upward, TAUGHT * (1 - self.prior) * n))
        self.high = BINS - 2 - int(np.searchsorted(np.cumsum(histogram[::-1]), TAUGHT * self.prior * n))

    def says(self, x: np.ndarray) -> np.ndarray:
        """By row the weights, 0 to 1, of the labels 0 and 1: what its probability has over the prior, where the row is chosen."""
        p, at = self._bins(x)
        zero = np.where(at <= self.low, (self.prior - p) / max(self.prior, 1e-9), 0)
        one = np.where(at > self.high, (p - self.prior) / max(1 - self.prior, 1e-9), 0)
        return np.clip(np.stack([zero, one], 1), 0, 1)


class Sums:
    """What a Newton step needs of a view's rows in the pool: by pseudo-label their number, weight, gradient and bound of the Hessian."""

    def __init__(self, width: int) -> None:
        self.n, self.weight, self.g, self.h = np.zeros(2), np.zeros(2), np.zeros((2, width)), np.zeros((2, width, width))

    def add(self, student: Logistic, x: np.ndarray, said: np.ndarray) -> None:
        """Rows of the pool that the other view labels, with its weights."""
        for c in (0, 1):
            some = said[:, c] > 0
            z, w = student.design(x[some]), said[some, c]
            p = sigmoid(z @ student.w)
            self.n[c] += len(z)
            self.weight[c] += w.sum()
            self.g[c] += z.T @ (w * (p - c))
            self.h[c] += (z * (w * CURVATURE)[:, None]).T @ z

    def packed(self) -> np.ndarray:
        return np.concatenate([self.n, self.weight, self.g.ravel(), self.h.ravel()])

    @classmethod
    def unpacked(cls, flat: np.ndarray, width: int) -> Sums:
        s = cls(width)
        s.n, s.weight, s.g, s.h = flat[:2], flat[2:4], flat[4 : 4 + 2 * width].reshape(2, width), flat[4 + 2 * width :].reshape(2, width, width)
        return s


def pool_sums(students: list[Logistic], teachers: list[Teacher], views: tuple[np.ndarray, np.ndarray]) -> list[Sums]:
    """Each view's sums over some rows of the pool, labelled by the other view."""
    said = [t.says(x) for t, x in zip(teachers, views, strict=True)]
    out = []
    for k, (m, x) in enumerate(zip(students, views, strict=True)):
        out.append(Sums(len(m.w)))
        out[k].add(m, x, said[1 - k])
    return out


#: Sums an array that a function gives for some rows of the pool (text view, metadata view) over all of them; empty for an empty pool.
Pool = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray]


class CoTrained:
    """Two classifiers that teach each other, and how their calibrated logits are put together."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool: Pool | None, class_weight: tuple[float, float] = (1.0, 1.0)) -> None:
        """text, meta: the views of labelled rows, y their labels (0, 1). A fifth of the rows calibrates only.

        In each of ROUNDS rounds both views are calibrated, each labels its surest rows of either class in the pool for the
        other, and both take STEPS steps on the labelled rows and on what the other labelled. A pseudo-label weighs
        what its probability has over the prior, 1 at most, and those of a class no more together than its labelled rows.
        So a view that knows little teaches little, and a wrong label is never worth more than a right one; steps are bounded
        by the largest curvature, so no label moves a view that is sure of its rows by more than its share. taught: by
        round and view the numbers of rows that it was taught as 0 and as 1.
        class_weight: how many labels a labelled row of class 0 and of class 1 stands for, so that scores are
        probabilities under the labels' own proportions and not the sample's.
        """
        self.views: list[Logistic] | None = None
        self.taught: list[list[tuple[int, int]]] = []
        weight = np.where(y == 1, class_weight[1], class_weight[0]).astype(float)
        self.prior = float(np.average(y, weights=weight)) if len(y) else 0.5
        held = np.arange(len(y)) % 5 == 0
        if not len(y) or min((y[part] == c).sum() for part in (~held, held) for c in (0, 1)) == 0:
            return
        views = (text.astype(float), meta.astype(float))
        train, own = [x[~held] for x in views], y[~held].astype(float)
        self.views = [Logistic(x, own) for x in train]
        for _ in range(ROUNDS if pool else 0):
            teachers = [Teacher(m, c, self.prior) for m, c in zip(self.views, self._calibrated(views, y, held, weight), strict=True)]
            seen = pool(lambda t, m, ts=teachers: np.concatenate([ts[0].histogram(t), ts[1].histogram(m)]))
            if not len(seen):
                break
            for t, histogram in zip(teachers, seen.reshape(2, BINS), strict=True):
                t.chosen(histogram)
            for _ in range(STEPS):
                flat = pool(lambda t, m, st=self.views, ts=teachers: np.concatenate([s.packed() for s in pool_sums(st, ts, (t, m))]))
                cut = len(Sums(len(self.views[0].w)).packed())
                sums = [Sums.unpacked(x, len(m.w)) for x, m in zip((flat[:cut], flat[cut:]), self.views, strict=True)]
                taught = []
                for m, x, s in zip(self.views, train, sums, strict=True):
                    share = np.minimum(1, np.array([(own == c).sum() for c in (0, 1)]) / np.maximum(1, s.weight))
                    taught.append(m.stepped(x, own, np.tensordot(share, s.g, 1), np.tensordot(share, s.h, 1)))
                self.views = taught
            self.taught.append([tuple(int(v) for v in s.n) for s in sums])
        self.calibration = self._calibrated(views, y, held, weight)
        both = np.hstack([c.logit(m.logit(x[held])[:, None])[:, None] for c, m, x in zip(self.calibration, self.views, views, strict=True)])
        self.top = Logistic(both, y[held], weight[held])

    def _calibrated(self, views: tuple[np.ndarray, np.ndarray], y: np.ndarray, held: np.ndarray, weight: np.ndarray) -> list[Logistic]:
        return [Logistic(m.logit(x[held])[:, None], y[held], weight[held]) for m, x in zip(self.views, views, strict=True)]

    def predict(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, and the calibrated probabilities of the two views."""
        if self.views is None:
            p = np.full(len(text), self.prior)
            return p, p, p
        logits = [c.logit(m.logit(x.astype(float))[:, None]) for c, m, x in zip(self.calibration, self.views, (text, meta), strict=True)]
        p = [1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in logits]
        return self.top.predict(np.stack(logits, 1)), p[0], p[1]


def _views(batch: pa.RecordBatch, text: str, size: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    get = lambda c: batch.column(batch.schema.get_field_index(c))
    return text_view(get(text)), metadata_view(get(size).to_numpy(zero_copy_only=False).astype(float), *[get(c).to_pylist() for c in names])


def _inputs(docs: DataFrame, text_col: str, size_col: str, meta_cols: tuple[str, ...]) -> tuple[DataFrame, str, str, list[str]]:
    text, size = own_name(docs, "view_text"), own_name(docs, "view_size")
    names = [own_name(docs, f"view_{i}") for i in range(len(meta_cols))]
    new = {text: F.coalesce(F.col(text_col), F.lit("")), size: F.coalesce(F.col(size_col).cast("double"), F.length(F.col(text_col)).cast("double"), F.lit(0.0))}
    return docs.withColumns(new | {n: F.coalesce(F.col(c).cast("string"), F.lit("")) for n, c in zip(names, meta_cols, strict=True)}), text, size, names


def _unpack(column: pa.Array) -> np.ndarray:
    data, o = raw(column)
    return data.view(np.float32).reshape(len(column), -1).astype(float) if len(column) else np.zeros((0, 0))


def _summed(parts: DataFrame) -> np.ndarray:
    """The sum of the arrays in `sums`, in groups of tasks and then in one."""

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"part": pa.array([0], pa.int32()), "sums": pa.array([np.sum([np.frombuffer(x) for x in t.column("sums").to_pylist()], 0).tobytes()], pa.binary())})

    kind = "part int, sums binary"
    for groups in (1024, 32):
        parts = parts.withColumn("group", F.pmod("part", F.lit(groups))).groupBy("group").applyInArrow(lambda k, t: add(t).set_column(0, "part", pa.array([k[0].as_py()], pa.int32())), kind)
    rows = parts.orderBy("part").collect()
    return np.sum([np.frombuffer(r["sums"]) for r in rows], 0) if rows else np.zeros(0)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", meta_cols: tuple[str, ...] = ("lang", "source"), label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> CoTrained:
    """Co-train on at most `per_class` labelled rows a class, chosen by a hash of ids, and on all rows without a label.

    The views of all rows are written once. Every step of co-training is a pass over those of the whole pool, which
    gives sums of a fixed size; no row of the pool reaches the driver, and none is left out. Of labelled rows, only the
    sample's numbers reach it. Null ids and labels teach nothing as labelled rows; of an id with two labels the smaller
    counts, and of an id with several rows the one whose views are smallest, so that a repeated id adds no rows. Where a
    class is missing, as in empty tables, every document scores the share of good labels. Labels of each class are
    counted, and a sampled row weighs as many as it stands for, so that a score means the same at every size. Nulls,
    empty and very long texts are rows like any other.
    """
    y = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    counts = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    df, text, size, names = _inputs(docs.select(id_col, text_col, size_col, *meta_cols), text_col, size_col, meta_cols)
    rows = df.select(F.col(id_col).alias("id"), text, size, *names)

    def view(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            t, m = _views(batch, text, size, names)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in t], pa.binary()), pa.array([r.tobytes() for r in m], pa.binary())], names=["id", "t", "m"])

    kind = docs.schema[id_col].dataType.simpleString()
    views = stored(rows.mapInArrow(view, f"id {kind}, t binary, m binary"), "views")
    # one row an id, of ids with a label only; the sample is the first ones by hash
    known = stored(views.join(y, "id").groupBy("id", "y").agg(F.min(F.struct("t", "m")).alias("v")), "labelled")
    first = lambda c: known.filter(F.col("y") == c).orderBy(F.xxhash64("id"), "id").limit(per_class)
    found = first(1).unionByName(first(0)).orderBy(F.xxhash64("id"), "id").select("y", "v.t", "v.m").collect()
    if not found:
        return CoTrained(np.zeros((0, 1)), np.zeros((0, 1)), np.zeros(0, int), None)
    pool = stored(views.join(y, "id", "left_anti").select("t", "m"), "pool")

    def over(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for at in range(0, b.num_rows, VIEW_ROWS):
                    part = b.slice(at, VIEW_ROWS)
                    own = f(_unpack(part.column(0)), _unpack(part.column(1)))
                    total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

        return _summed(pool.mapInArrow(run, "part int, sums binary"))

    stack = lambda k: np.stack([np.frombuffer(r[k], np.float32) for r in found])
    model = CoTrained(stack("t"), stack("m"), np.array([r["y"] for r in found]), over, tuple(max(1.0, counts.get(c, 0) / per_class) for c in (0, 1)))
    forget(views, known, pool)
    return model


def score_quality(docs: DataFrame, model: CoTrained, text_col: str = "text", size_col: str = "n_chars", meta_cols: tuple[str, ...] = ("lang", "source"), out: str = "quality") -> DataFrame:
    """`docs` and a struct column: score (0 to 1, higher is better), and the calibrated text and metadata views.

    Whole texts are read. Null and empty texts, nulls in the other columns and repeated rows are scored like any other;
    a missing size is the text's; an empty table gives an empty table. Other columns stay; a clash puts underscores before `out`.
    """
    out = own_name(docs, out)
    df, text, size, names = _inputs(docs, text_col, size_col, meta_cols)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            parts = [pa.array(x, pa.float64()) for x in model.predict(*_views(batch, text, size, names))]
            yield with_columns(batch, drop=[text, size, *names], **{out: pa.StructArray.from_arrays(parts, names=["score", "text_view", "meta_view"])})

    return df.mapInArrow(run, passed_through(docs, **{out: "struct<score:double,text_view:double,meta_view:double>"}))
