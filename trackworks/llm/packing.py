"""Best-fit decreasing packing of tokenized documents into fixed-length sequences.

Where lengths are whole numbers up to the capacity, best-fit decreasing only needs to know how many pieces have each
length. So the plan is made on a histogram of at most `capacity` counts, with a segment tree over remaining capacities,
and is the plan best-fit decreasing makes over the whole corpus. Each piece then finds its bin from its length and its
rank among pieces of that length, which every task counts for itself and one small table of counts offsets.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackworks.llm.shared import release_memory, slices, stored, string_hashes

#: Places of the table of words that a task remembers (25 bytes and two a place and id), and the most ids of a word in it.
TABLE_PLACES, TABLE_IDS = 1 << 21, 10
#: Bytes of text encoded at a time: the more, the fewer look-ups, as each different word of them takes one.
ENCODE_BYTES = 2 << 20
_MARKS = "([A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])([.,;:!?]+)( |$)"
_CONTRACTIONS_AND_RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)


class _Made(dict):
    """Values by key; one that isn't there yet is made on its first use."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key):
        self[key] = found = self.make(key)
        return found


class WordTable:
    """Ids of words by two 64-bit hashes, in arrays of a fixed size.

    A word has two places; a new one that finds both taken takes over the first, so the table never grows.
    """

    def __init__(self, places: int, width: int, kind: type) -> None:
        self.mask = np.uint64(places - 1)
        self.a, self.b = np.zeros(places, np.uint64), np.zeros(places, np.uint64)
        self.n, self.ids = np.zeros(places, np.uint8), np.zeros((places, width), kind)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each word, -1 where it isn't known. Unused places hold no ids, so they never match."""
        one, two = (a & self.mask).astype(np.int64), (b & self.mask).astype(np.int64)
        at = np.where((self.a[two] == a) & (self.b[two] == b) & (self.n[two] > 0), two, -1)
        return np.where((self.a[one] == a) & (self.b[one] == b) & (self.n[one] > 0), one, at)

    def put(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, flat: np.ndarray, start: np.ndarray) -> None:
        own = np.flatnonzero((n > 0) & (n <= self.ids.shape[1]))
        one, two = (a[own] & self.mask).astype(np.int64), (b[own] & self.mask).astype(np.int64)
        at = np.where((self.n[one] > 0) & (self.n[two] == 0), two, one)
        at, last = np.unique(at[::-1], return_index=True)  # of words that want one place, one gets it
        own = own[len(own) - 1 - last]
        self.a[at], self.b[at], self.n[at] = a[own], b[own], n[own]
        for j in range(self.ids.shape[1]):
            has = n[own] > j
            self.ids[at[has], j] = flat[start[own[has]] + j]


def ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] numbers, then start[1], ...: where the parts of a flat array lie."""
    end = np.cumsum(n)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - n), n)


class Encoder:
    """Ids of a BPE tokenizer that drops white space, folds case, and splits letters, single digits and other marks.

    The different words of a stretch of text are found by Arrow, and each is encoded once and remembered in a table of
    bounded size. Words of the first 768 characters, where normalizing is folding case, are split here and go to the
    tokenizer's model at once; so do words that are letters alone once normalized. Any other word goes through the whole
    tokenizer. (Some letters normalize to a letter and a mark, where the tokenizer splits.)
    """

    def __init__(self, path: str, places: int = TABLE_PLACES) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.alphabet = _Made(lambda c: level.pre_tokenize_str(chr(c))[0][0])
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.table = WordTable(places, TABLE_IDS, self.kind)
        self.cores = _Made(self._core)

    def _word(self, word: str) -> list[int]:
        if word.isascii() and "<|" not in word:  # special tokens begin with it
            folded = word.lower()
            if folded.isalpha():
                return self.cores[folded]
            ids: list[int] = []
            for part in _CONTRACTIONS_AND_RUNS.findall(folded):
                ids += self.cores[part]
            return ids
        core = word.rstrip(".,;:!?")
        folded = core.lower() if core < "\u0300" and max(core, default="") < "\u0300" else self.normalizer.normalize_str(core)
        if core.isalpha() and folded.isalpha():
            tail = word[len(core) :]
            return self.cores[folded] + (self.cores[tail] if tail else [])
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _core(self, core: str) -> list[int]:
        return [t.id for t in self.model.tokenize(core if core.isascii() and core.isprintable() else core.translate(self.alphabet))]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text's after the other's, and n+1 offsets."""
        for space in "\n\t\r":
            texts = pc.replace_substring(texts, space, " ")
        special = pc.match_substring(texts, "<|")
        texts = pc.if_else(special, texts, pc.ascii_lower(texts)) if pc.any(special).as_py() else pc.ascii_lower(texts)
        # marks that end a word are words of their own, so that a word is encoded once whatever follows it
        texts = pc.replace_substring_regex(texts, _MARKS, r"\1 \2\3")
        split = pc.split_pattern(texts, " ")
        words = split.flatten().dictionary_encode()
        known = words.dictionary
        a, b = string_hashes(known)
        at = self.table.find(a, b)
        hit, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        made = [self._word(w) for w in known.take(pa.array(new)).to_pylist()]
        self.cores.clear()
        n = np.empty(len(known), np.int64)
        n[hit], n[new] = self.table.n[at[hit]], [len(x) for x in made]
        rows = self.table.ids[at[hit]]
        flat = np.concatenate([rows[np.arange(TABLE_IDS) < n[hit][:, None]], np.fromiter(itertools.chain.from_iterable(made), self.kind)])
        order = np.concatenate([hit, new])
        offsets = np.concatenate([[0], np.cumsum(n[order])])
        self.table.put(a[new], b[new], n[new], flat, offsets[len(hit) : -1])
        place = np.empty(len(known), np.int32)
        place[order] = np.arange(len(known), dtype=np.int32)
        lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat)).take(pa.array(place[words.indices.to_numpy()]))
        ends = split.offsets.to_numpy()
        return lists.flatten().to_numpy(), lists.offsets.to_numpy()[ends - ends[0]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, o = self.encode_column(pa.array(texts, pa.large_string()))
        return [ids[x:y] for x, y in zip(o[:-1], o[1:], strict=True)]


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Rows are (length, first rank, pieces, pieces a bin, first bin, offset): the piece of that length and rank r goes to
    bin `first bin + (r - first rank) // pieces a bin`, at `offset + (r - first rank) % pieces a bin * length`.
    """
    size = 1
    while size <= capacity:
        size *= 2
    tree = np.zeros(2 * size, bool)  # tree[size + c]: some open bin has c left
    open_bins: dict[int, list[list[int]]] = {}  # remaining capacity -> [first bin, bins]
    bins, plan = 0, []

    def mark(c: int, on: bool) -> None:
        i = size + c
        tree[i] = on
        while i > 1:
            i //= 2
            tree[i] = tree[2 * i] or tree[2 * i + 1]

    def tightest(least: int) -> int | None:
        """The smallest remaining capacity >= least of an open bin."""
        i = size + least
        if tree[i]:
            return least
        while i > 1:
            if i % 2 == 0 and tree[i + 1]:
                i += 1
                while i < size:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - size
            i //= 2
        return None

    def put(c: int, first: int, n: int) -> None:
        if c > 0 and n > 0:
            open_bins.setdefault(c, []).append([first, n])
            if len(open_bins[c]) == 1:
                mark(c, True)

    for length in sorted((k for k, n in histogram.items() if n > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            c = tightest(length)
            if c is None:
                c, n = capacity, -(-left // (capacity // length))
                first, bins = bins, bins + n
            else:
                first, n = open_bins[c].pop()
                if not open_bins[c]:
                    mark(c, False)
            each = c // length
            full, rest = divmod(left, each)
            if full >= n:
                plan.append((length, rank, n * each, each, first, capacity - c))
                put(c - each * length, first, n)
                left, rank = left - n * each, rank + n * each
            else:
                plan.append((length, rank, left, each, first, capacity - c))
                put(c - each * length, first, full)
                if rest:
                    put(c - rest * length, first + full, 1)
                put(c, first + full + bool(rest), n - full - bool(rest))
                left = 0
    return plan


def _pieces(path: str, capacity: int, end: int, payload: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, counts, task = Encoder(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in slices(batches, "text", ENCODE_BYTES):
            ids, o = encoder.encode_column(batch.column(1))
            each = np.diff(o)
            body = np.full(len(ids) + len(each), end, np.uint32)  # each document's ids and its end
            body[np.arange(len(ids)) + np.repeat(np.arange(len(each)), each)] = ids
            each, begin = each + 1, o[:-1] + np.arange(len(each))
            pieces = -(-each // capacity)
            row = np.repeat(np.arange(len(each)), pieces)
            piece = ragged(np.zeros(len(each), np.int64), pieces)
            start = piece * capacity
            length = np.minimum(capacity, each[row] - start)
            order = np.argsort(length, kind="stable")
            sizes, first = np.unique(length[order], return_index=True)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.repeat(first, np.diff(np.append(first, len(length)))) + counts[length[order]]
            counts[sizes] += np.diff(np.append(first, len(length)))
            if payload == "ids":
                out = pa.ListArray.from_arrays(pa.array(np.append(begin[row] + start, len(body)), pa.int32()), pa.array(body.astype(np.int32)))
            else:
                out = pa.array([zlib.crc32(body[x : x + y]) for x, y in zip((begin[row] + start).tolist(), length.tolist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), out, pa.array(np.full(len(rank), task), pa.int32()), pa.array(rank)],
                names=["doc_id", "piece", "start", "length", payload, "task", "rank"],
            )
        del encoder
        release_memory()

    return run


def _placed(plan: dict[int, np.ndarray]):
    """Adds sequence_id and offset; the plan's rows of a length are sorted by first rank."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
            bin_, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                p = plan[int(n)]
                p = p[np.searchsorted(p[:, 0], rank[own], side="right") - 1]
                by = rank[own] - p[:, 0]
                bin_[own], offset[own] = p[:, 2] + by // p[:, 1], p[:, 3] + by % p[:, 1] * n
            keep = [i for i, name in enumerate(b.schema.names) if name != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(bin_), pa.array(offset)], names=[*(b.schema.names[i] for i in keep), "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, payload: str = "ids", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack documents into sequences of at most `capacity` tokens.

    tokenizer: path of a tokenizers file that drops white space. A document is its ids and then `end_id`; only longer
    documents are cut, into pieces of `capacity`. One row per piece: doc_id, piece, start, length, `ids` (payload "ids")
    or `crc32` of the ids as little-endian 32-bit numbers (payload "crc32"), sequence_id, offset.

    Null and empty texts are one `end_id`; texts of any length are encoded whole. Rows that repeat an id, or have none, are documents of their own. Other
    columns are left out, whatever their names. An empty table gives an empty table. The driver sees one count per
    length, so at most `capacity`; plan rows are about as many.
    """
    if payload not in ("ids", "crc32"):
        raise ValueError(f"payload is ids or crc32, not {payload}")
    kind = docs.schema[id_col].dataType.simpleString()
    body = "ids array<int>" if payload == "ids" else "crc32 bigint"
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = stored(texts.mapInArrow(_pieces(tokenizer, capacity, end_id, payload), f"doc_id {kind}, piece int, start bigint, length bigint, {body}, task int, rank bigint"), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan: dict[int, list] = {}
    for n, first_rank, _, each, first, offset in best_fit_plan(histogram, capacity):
        plan.setdefault(n, []).append((first_rank, each, first, offset))
    plan = {n: np.array(sorted(p), dtype=np.int64) for n, p in plan.items()}
    ranked = pieces.join(base, ["task", "length"]).select("doc_id", "piece", "start", "length", payload, (F.col("rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(_placed(plan), f"doc_id {kind}, piece int, start bigint, length bigint, {body}, sequence_id bigint, offset bigint")
