"""MinHash near-duplicates of word shingles: banding, signature verification, exact sets, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackworks.llm.components import connected_components
from trackworks.llm.shared import Words, ascii_fold, forget, own_name, random_words, raw, slices, spaced_words, stored

#: 30 bands of 4 minima: a pair of similarity 0.85 shares none with probability 3e-10, one of 0.80 with 2e-7.
BANDS, ROWS = 30, 4
#: Signatures may agree in so much less than the threshold asks: of 120 minima a pair of similarity 0.85 has so few equal
#: with probability 1e-11 or less, one of 0.80 with 2e-10: little beside what banding may lose.
SLACK = 0.25
#: Members of a bucket, and about how many bytes of their sets, that one task compares with as many others at a time.
TILE, TILE_BYTES = 4096, 16 << 20
_CHUNK = 1 << 15


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text, one text's after the other's, and n+1 offsets."""
    w = Words(column, ascii_fold(), spaced_words())
    h, at = w.runs(k)
    first = np.searchsorted(at, w.first)
    sets = []
    for i in range(len(w.first) - 1):
        if first[i] < first[i + 1]:
            sets.append(np.unique(h[first[i] : first[i + 1]]))
        elif w.first[i] < w.first[i + 1]:  # fewer words than a shingle: all of them are one
            own = w.hash[w.first[i] : w.first[i + 1]]
            sets.append(np.array([np.bitwise_xor.reduce(own * random_words(13, len(own))) ^ np.uint64(len(own))], dtype=np.uint64))
        else:
            sets.append(np.empty(0, np.uint64))
    return np.concatenate([*sets, np.empty(0, np.uint64)]), np.cumsum([0, *map(len, sets)])


def minima(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Signatures [texts, BANDS * ROWS] of 32-bit minima; texts without shingles get the largest number."""
    n = BANDS * ROWS
    a, b = random_words(17, n), random_words(19, n)
    out = np.full((len(offsets) - 1, n), 0xFFFFFFFF, np.uint32)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _CHUNK, side="right")) - 1)
        x, o = flat[offsets[at] : offsets[to]], offsets[at:to] - offsets[at]
        full = np.flatnonzero(offsets[at + 1 : to + 1] > offsets[at:to])
        if len(full):
            for j in range(n):
                out[at + full, j] = np.minimum.reduceat((x * a[j] + b[j]) >> np.uint64(32), o[full])
        at = to
    return out


def _keys(flat: np.ndarray, o: np.ndarray) -> list[pa.Array]:
    """Two sums over each set of 64-bit hashes, which with its size stand for the set."""
    sums = (np.concatenate([[np.uint64(0)], np.cumsum(f)]) for f in (flat, flat * (flat | np.uint64(1))))
    return [pa.array((x[o[1:]] - x[o[:-1]]).view(np.int64)) for x in sums]


def _features(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            flat, o = shingle_sets(batch.column(1), k)
            sig = minima(flat, o)
            some = o[1:] > o[:-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(o)), *_keys(flat, o), *(pa.array([s.tobytes() if t else None for s, t in zip(x, some, strict=True)], pa.binary()) for x in (sig, sig.astype(np.uint8)))],
                names=["id", "n_shingles", "key_a", "key_b", "signature", "sketch"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            flat, o = shingle_sets(batch.column(1), k)
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(o)), *_keys(flat, o), pa.array([flat[a:b].tobytes() for a, b in zip(o[:-1], o[1:], strict=True)], pa.binary())], names=["n_shingles", "key_a", "key_b", "shingles"])

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct numbers."""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    if not len(few) or 100 * len(few) < percent * len(many):
        return False
    at = np.searchsorted(many, few)
    at[at == len(many)] = 0
    both = int((many[at] == few).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _least(percent: int) -> float:
    """Equal minima that two signatures need, so that their sets may be similar; last bytes are equal where they are."""
    return (percent / 100 - SLACK) * BANDS * ROWS


def _sketches(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The last byte of each minimum: equal minima have equal ones, others one time in 256, and a quarter is shuffled."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _maybe_similar(percent: int):
    """Of pairs with sketches, those that may be similar."""
    least = _least(percent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u, v, su, sv = (b.column(b.schema.get_field_index(n)) for n in ("u", "v", "su", "sv"))
                near = pa.array(np.flatnonzero((_sketches(su) == _sketches(sv)).sum(1) >= least))
                yield pa.RecordBatch.from_arrays([u.take(near), v.take(near)], names=["u", "v"])

    return run


def _verify(percent: int):
    """Of pairs with shingles, those that are similar."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u, v, xu, xv = (b.column(b.schema.get_field_index(n)) for n in ("u", "v", "xu", "xv"))
                (du, ou), (dv, ov) = raw(xu), raw(xv)
                good = pa.array([i for i in range(b.num_rows) if similar(du[ou[i] : ou[i + 1]].view(np.uint64), dv[ov[i] : ov[i + 1]].view(np.uint64), percent)], pa.int64())
                yield pa.RecordBatch.from_arrays([u.take(good), v.take(good)], names=["u", "v"])

    return run


def _candidates(t: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For members of a tile's one side, those of the other that are in another component so far and may be similar."""
    comp, side, sig = t.column("component").to_numpy(), t.column("side").to_numpy(), _sketches(t.column("sketch"))
    one, two = np.flatnonzero(side != 1), np.flatnonzero(side != 2)  # side: 0 both, 1 the column only, 2 the row only
    for i in one.tolist():
        js = two[comp[two] != comp[i]]
        if (side == 0).all():
            js = js[js > i]
        js = js[(sig[js] == sig[i]).sum(1) >= _least(percent)] if len(js) else js
        if len(js):
            yield i, js


def _involved(percent: int):
    """The members of a tile that have a candidate in it."""

    def run(t: pa.Table) -> pa.Table:
        found = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.append(js, i) for i, js in _candidates(t, percent))]))
        return t.take(pa.array(found)).select(["bucket", "i", "j", "side", "cid", "component"])

    return run


def _tile(percent: int):
    """Links between members of a bucket's tile that are in different components so far: a spanning forest of them."""

    def run(t: pa.Table) -> pa.Table:
        cid, comp = t.column("cid").to_numpy(), t.column("component").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        root = {c: c for c in comp.tolist()}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        links = []
        for i, js in _candidates(t, percent):
            for j in js.tolist():
                a, b = top(int(comp[i])), top(int(comp[j]))
                if a != b and similar(sets[i], sets[j], percent):
                    root[a] = b
                    links.append((int(cid[i]), int(cid[j])))
        return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([y for _, y in links], pa.int64())})

    return run


KEYS = ["n_shingles", "key_a", "key_b"]


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """One row per row of `docs`: id_col, n_shingles, component_id (the smallest id reachable by links), kept.

    Two rows are linked where 100 * intersection >= percent * union of their sets of `shingle` words (A-Z in lower
    case, split at ASCII white space); fewer words are one shingle. Empty and null texts have no shingles and link with
    nothing. Texts of any length are read whole. Equal sets are one class, linked without expanding pairs. Rows that
    repeat an id are one node, which joins the components of all their texts. A row without an id links with nothing:
    component_id null, kept true. Other columns play no part. Empty in, empty out.

    Classes are banded. Each member of a bucket is compared with its first; then every bucket that still holds several
    components has the rest of its pairs compared in tiles of `tile` members and about TILE_BYTES of their sets, so no link
    is lost to the first not being close and long texts share no task with many others. Signatures are compared before sets, and sets are fetched only for classes that may be similar to another.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    features = stored(texts.mapInArrow(_features(shingle), "id bigint, n_shingles bigint, key_a bigint, key_b bigint, signature binary, sketch binary"), "features")
    some = features.filter("n_shingles > 0 and id is not null")
    # numbers are given once, as the table is written
    classes = stored(some.groupBy(*KEYS).agg(F.min("id").alias("rep"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("signature", b * ROWS * 4 + 1, F.lit(ROWS * 4)))))
    members = classes.select("cid", "n_shingles", band.alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("cid").alias("center"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size")).filter("n > 1")
    shared = stored(members.drop("n_shingles").join(buckets, "bucket"), "buckets")
    side = lambda x, c, n: classes.select(F.col("cid").alias(x), F.col(c).alias(n))
    pairs = shared.filter("cid <> center").select(F.col("cid").alias("u"), F.col("center").alias("v")).distinct()
    maybe = pairs.join(side("u", "sketch", "su"), "u").join(side("v", "sketch", "sv"), "v").select("u", "v", "su", "sv")
    maybe = stored(maybe.mapInArrow(_maybe_similar(percent), "u bigint, v bigint"), "candidates")
    sets = _set_table(texts, classes, maybe.select(F.col("u").alias("cid")).unionByName(maybe.select(F.col("v").alias("cid"))), shingle)
    shingles = lambda x: sets.select(F.col("cid").alias(x), F.col("shingles").alias(f"x{x}"))
    close = maybe.join(shingles("u"), "u").join(shingles("v"), "v").select("u", "v", "xu", "xv").mapInArrow(_verify(percent), "u bigint, v bigint")
    links = stored(close.unionByName(_repeated_ids(some, classes)), "links")
    forget(maybe, sets)
    found = connected_components(links)
    more = _rest(texts, classes, shared, found, percent, shingle, tile)
    if more is not None:
        found = connected_components(links.unionByName(more))
        forget(more)
    labelled = stored(classes.select(*KEYS, "cid", "rep").join(found.withColumnRenamed("id", "cid"), "cid", "left").select(*KEYS, "rep", F.coalesce("component", "cid").alias("component")), "labelled")
    forget(classes, shared, links)
    smallest = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = labelled.join(smallest, "component").select(*KEYS, "component_id")
    return (
        features.select("id", "n_shingles", F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.col("key_a")).alias("key_a"), "key_b")
        .join(by_class, KEYS, "left")
        .select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"))
    )


def _repeated_ids(some: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of ids that come with several texts."""
    key = F.struct(*KEYS)
    twice = some.groupBy("id").agg(F.min(key).alias("a"), F.max(key).alias("b")).filter("a < b").select("id")
    rows = some.select("id", *KEYS).join(twice, "id").distinct().join(classes.select(*KEYS, "cid"), KEYS).select("id", "cid")
    first = rows.groupBy("id").agg(F.min("cid").alias("v"))
    return rows.join(first, "id").select(F.col("cid").alias("u"), "v").filter("u <> v").distinct()


def _set_table(texts: DataFrame, classes: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(cid, shingles) of the classes in `wanted` (cid): read from the texts of one id of each."""
    own = classes.join(wanted.distinct(), "cid").select("cid", "rep", *KEYS)
    read = texts.join(own.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("id", "text")
    # a repeated id may come with other texts too; those of no wanted class go
    sets = read.mapInArrow(_sets(shingle), "n_shingles bigint, key_a bigint, key_b bigint, shingles binary").groupBy(*KEYS).agg(F.first("shingles").alias("shingles"))
    return stored(sets.join(own, KEYS).select("cid", "shingles"), "sets")


def _rest(texts: DataFrame, classes: DataFrame, shared: DataFrame, found: DataFrame, percent: int, shingle: int, tile: int) -> DataFrame | None:
    """Links between members other than the first, of buckets whose members aren't all in one component yet."""
    comp = shared.filter("n > 2").join(found.withColumnRenamed("id", "cid"), "cid", "left").select("bucket", "n", "size", "cid", F.coalesce("component", "cid").alias("component"))
    open_ = comp.groupBy("bucket", "n", "size").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.sum(F.xxhash64("cid") % (1 << 40)).alias("s")).filter("a < b")
    # buckets of other bands with the same members hold the same pairs
    open_ = stored(open_.groupBy("n", "size", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "size"), "open")
    if open_.isEmpty():
        return None
    own = F.pmod(F.xxhash64("cid", F.lit(1)), F.col("tiles")).cast("int")
    tiles_ = F.ceil(F.greatest(F.col("n") / tile, 8 * F.col("size") / TILE_BYTES)).cast("int")
    rows = comp.drop("n", "size").join(open_, "bucket").withColumn("tiles", tiles_).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    rows = rows.select("bucket", "cid", "component", "own", other.alias("other")).select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"), "cid", "component",
    )
    tiles = ["bucket", "i", "j"]
    signed = lambda df: df.join(classes.select("cid", "sketch"), "cid")
    involved = stored(signed(rows).groupBy(*tiles).applyInArrow(_involved(percent), "bucket bigint, i int, j int, side int, cid bigint, component bigint"), "involved")
    sets = _set_table(texts, classes, involved.select("cid"), shingle)
    more = stored(signed(involved).join(sets, "cid").groupBy(*tiles).applyInArrow(_tile(percent), "u bigint, v bigint"), "more")
    forget(open_, involved, sets)
    return more


def deduplicated(docs: DataFrame, percent: int = 80, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each group of near-duplicates, the one with the smallest id; columns are kept.

    Rows that repeat the kept id stay, as do rows without an id and those with empty and null texts; an empty table stays
    empty, other columns of any name play no part. The ids that go are joined away, never collected.
    """
    gone = near_duplicates(docs, percent, shingle, id_col, text_col).filter(~F.col("kept")).select(F.col(id_col).alias(own_name(docs, "gone"))).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(gone.columns[0]), "left_anti")
