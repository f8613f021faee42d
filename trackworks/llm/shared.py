"""Helpers the operators share: tables in the shared folder, Arrow text as byte arrays, words and their hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a kernel works on at a time; a longer text is worked on alone and whole.
SLICE_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a temporary one only in a local session where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="trackworks-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def passed_through(df: DataFrame, **new: str) -> str:
    """A DDL schema: the columns of `df` and the `new` ones."""
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{k}` {v}" for k, v in new.items()])


def own_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, with underscores before it until no column of `df` has the name."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted = f"_{wanted}"
    return wanted


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string or binary array without nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    b = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None else np.empty(0, np.uint8)
    return b, o - o[0]


def release_memory() -> None:
    """Give freed memory back to the system: Python workers live on after a task, and what they keep adds up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in pieces of about `size` bytes of `text`, so that arrays stay small; never part of a row.

    When all is read, freed memory is given back.
    """
    try:
        yield from _slices(batches, text, size)
    finally:
        release_memory()


def _slices(batches: Iterable[pa.RecordBatch], text: str, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        _, o = raw(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(o, o[at] + size, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def with_columns(batch: pa.RecordBatch, drop: Iterable[str] = (), **new: pa.Array) -> pa.RecordBatch:
    """`batch` without `drop` and with `new`."""
    keep = [i for i, n in enumerate(batch.schema.names) if n not in set(drop)]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *new.values()], names=[*(batch.schema.names[i] for i in keep), *new])


def random_words(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers; the first ones stay the same for larger n."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, size=n, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads a 64-bit sum over all its bits (splitmix64's constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each string or binary value."""
    b, o = raw(column)
    n = np.diff(o)
    full = np.flatnonzero(n)
    place = np.arange(len(b)) - np.repeat(o[:-1], n)
    out = []
    for seed in (31, 37):
        table = random_words(seed, max(64, int(n.max(initial=0))))
        h = n.astype(np.uint64) * table[0]
        if len(full):
            h[full] += np.add.reduceat((b.astype(np.uint64) + np.uint64(1)) * table[place], o[:-1][full])
        out.append(mixed(h))
    return out[0], out[1]


class Words:
    """Words of many texts at once.

    `fold` maps a byte to the one that counts (A-Z to a-z), `inside` says which bytes belong to words; all bytes of
    non-ASCII characters must. start, end: byte offsets of each word in `data`; first: n+1 numbers, the words of text i
    are first[i]:first[i+1]; hash: 64 bits for each word.
    """

    _table = random_words(7, 64)

    def __init__(self, column: pa.Array, fold: np.ndarray, inside: np.ndarray) -> None:
        b, o = raw(column)
        self.data = fold[b]
        within = inside[b]
        left, right = np.zeros(len(b), bool), np.zeros(len(b), bool)
        left[1:], right[:-1] = within[:-1], within[1:]
        full = o[1:] > o[:-1]
        left[o[:-1][full]] = False
        right[o[1:][full] - 1] = False
        self.start, self.end = np.flatnonzero(within & ~left), np.flatnonzero(within & ~right) + 1
        self.first = np.searchsorted(self.start, o)
        self.offsets = o
        n = self.end - self.start
        if len(n):
            if n.max() > len(Words._table):
                Words._table = random_words(7, int(n.max()) * 2)
            begin = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(begin, n)
            h = (self.data[within].astype(np.uint64) + np.uint64(1)) * Words._table[place]
            self.hash = mixed(np.add.reduceat(h, begin) + n.astype(np.uint64))
        else:
            self.hash = np.empty(0, np.uint64)

    def text_of(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each k consecutive words of a text, and the number of the first word of each."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        t = self.text_of()
        at = np.flatnonzero(t[: n] == t[k - 1 :])
        c = random_words(11, k)
        h = np.full(n, np.uint64(k))
        for j in range(k):
            h = h + self.hash[j : j + n] * c[j]
        return mixed(h[at]), at


def ascii_fold() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def alnum_words() -> np.ndarray:
    """Bytes of words of ASCII letters, digits and all non-ASCII characters."""
    t = np.zeros(256, bool)
    t[48:58] = t[65:91] = t[97:123] = t[128:] = True
    return t


def spaced_words() -> np.ndarray:
    """Bytes of words between ASCII white space."""
    t = np.ones(256, bool)
    t[[32, 9, 10, 11, 12, 13]] = False
    return t
