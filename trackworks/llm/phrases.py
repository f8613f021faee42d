"""Phrases that occur more often than their parts suggest: candidates in double-array tries, walked over all texts at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackworks.llm.shared import ascii_fold, forget, raw, slices, stored
from trackworks.llm.tallies import Tally

#: A phrase is 2 to LONGEST words that occur together at least LEAST_COUNT times.
LONGEST, LEAST_COUNT = 4, 30
#: A phrase goes if a longer one that holds it has at least this percentage of its occurrences.
HELD_PERCENT = 80
#: Scores are whole numbers up to half of this.
SCALE = 2_000_000
#: Key bytes of a trie: the most that is broadcast at a time, but for the uneven deal of keys; more are further passes.
BLOCK_BYTES = 1 << 23
#: Words of more bytes are looked up by their SHA-256, so that a trie has few levels.
LONG_WORD = 64
#: Rows of a language that one task orders at a time.
ORDERED_ROWS = 50_000
_ROUND_BYTES = 1 << 21


#: A trie's state that nothing leads out of, and the one that all keys begin in.
DEAD, ROOT = 0, 1
_WIDE = 32


class DoubleArray:
    """A trie of byte strings in two arrays: the state after byte c of state s is base[s] + c, if check there is s.

    number: what each key was given (1 or more), by the state it ends in; 0 elsewhere. Many states find their place at a
    time: those of many children in a stretch of their own, others wherever a random base leaves no clash.
    """

    def __init__(self, flat: np.ndarray, offsets: np.ndarray, numbers: np.ndarray) -> None:
        """flat, offsets: the bytes of different keys, none of them empty."""
        self.top, self.used = 512, np.zeros(1 << 12, bool)
        self.used[[DEAD, ROOT]] = True
        self.base, self.check = np.zeros(1 << 12, np.int32), np.full(1 << 12, -1, np.int32)
        self.random = np.random.default_rng(41)
        size = np.diff(offsets)
        state = np.full(len(size), ROOT, np.int64)
        alive, level = np.arange(len(size)), 0
        while len(alive):
            edge, at = np.unique(state[alive] << 8 | flat[offsets[alive] + level], return_inverse=True)
            state[alive] = self._place(edge >> 8, edge & 255)[at]
            level += 1
            alive = alive[size[alive] > level]
        end = self.top + 256
        self.number = np.zeros(end, np.int32)
        self.number[state] = numbers
        self.arrays = self.base[:end].copy(), self.check[:end].copy(), self.number

    def _grow(self, more: int) -> None:
        self.top += more
        n = len(self.used)
        if self.top + 256 > n:
            more = max(n, self.top + 256 - n)
            self.used, self.base = np.append(self.used, np.zeros(more, bool)), np.append(self.base, np.zeros(more, np.int32))
            self.check = np.append(self.check, np.full(more, -1, np.int32))

    def _place(self, parent: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """New states for edges that are sorted by parent and byte."""
        first = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        size = np.diff(np.append(first, len(parent)))
        slot = np.zeros(len(parent), np.int64)

        def settle(who: np.ndarray, base: np.ndarray) -> None:
            edges = np.repeat(first[who] - np.cumsum(size[who]) + size[who], size[who]) + np.arange(int(size[who].sum()))
            slot[edges] = np.repeat(base, size[who]) + byte[edges]
            self.base[parent[first[who]]] = base
            self.check[slot[edges]] = parent[edges]
            self.used[slot[edges]] = True

        wide = np.flatnonzero(size > _WIDE)
        low = byte[first[wide]]
        span = byte[first[wide] + size[wide] - 1] - low + 1
        base = self.top + np.cumsum(span) - span - low
        self._grow(int(span.sum()))
        settle(wide, base)
        some = np.flatnonzero((size > 1) & (size <= _WIDE))
        some = some[np.argsort(-size[some], kind="stable")]
        while len(some):
            n = size[some]
            begin = np.cumsum(n) - n
            edges = np.repeat(first[some] - begin, n) + np.arange(int(n.sum()))
            base = self.random.integers(2, self.top - 255, len(some))
            wanted, mine = np.repeat(base, n) + byte[edges], np.repeat(np.arange(len(some)), n)
            claim = np.zeros(self.top + 256, np.int32)
            claim[wanted[::-1]] = mine[::-1]  # of several the first, which has most children
            good = np.logical_and.reduceat(~self.used[wanted] & (claim[wanted] == mine), begin)
            settle(some[good], base[good])
            if 4 * good.sum() < len(some):
                self._grow(256 + int(n[~good].sum()))
            some = some[~good]
        one = np.flatnonzero(size == 1)
        free = np.flatnonzero(~self.used[256 : self.top]) + 256
        if len(free) < len(one):
            free = np.append(free, np.arange(self.top, self.top + len(one)))
            self._grow(len(one))
        settle(one, free[: len(one)] - byte[first[one]])
        return slot


def step(trie: tuple[np.ndarray, np.ndarray, np.ndarray], state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """The states after one byte each: DEAD where there is none."""
    base, check, _ = trie
    at = base[state] + byte
    return np.where(check[at] == state, at, DEAD)


def words_of(column: pa.Array, end: str = ".,;:!?\n\x0b\x0c\r", space: str = " \t") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of many texts: folded bytes, start and end of each word in them, its text, and whether a new piece begins with it."""
    b, o = raw(column)
    kind = np.zeros(256, np.uint8)
    kind[list(space.encode())], kind[list(end.encode())] = 1, 2
    k = kind[b]
    inside = k == 0
    left = np.zeros(len(b), bool)
    left[1:] = inside[:-1]
    full = o[:-1][o[1:] > o[:-1]]
    left[full] = False
    start = np.flatnonzero(inside & ~left)
    right = np.zeros(len(b), bool)
    right[:-1] = inside[1:]
    right[o[1:][o[1:] > o[:-1]] - 1] = False
    stop = np.flatnonzero(inside & ~right) + 1
    cut = k == 2
    cut[full] |= ~inside[full]
    ends = np.cumsum(cut)
    text = np.searchsorted(o, start, side="right") - 1
    piece = ends[start] if len(start) else start
    fresh = np.ones(len(start), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (piece[1:] != piece[:-1])
    return ascii_fold()[b], start, stop, text, fresh


def _strings(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    n = stop - start
    at = np.append(0, np.cumsum(n))
    inside = np.arange(at[-1]) + np.repeat(start - at[:-1], n)
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[inside])))


def _lang_codes(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    lang = batch.column(batch.schema.get_field_index("lang")).dictionary_encode()
    return lang.dictionary, lang.indices.to_numpy(zero_copy_only=False)


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = Tally(["n"])
    for batch in slices(batches, "text", _ROUND_BYTES):
        langs, code = _lang_codes(batch)
        data, start, stop, text, _ = words_of(batch.column(batch.schema.get_field_index("text")))
        word = _strings(data, start, stop).dictionary_encode()
        n = pa.table({"lang": code[text], "word": word.indices}).group_by(["lang", "word"]).aggregate([([], "count_all")])
        yield from tally.add(pa.table({"lang": langs.take(n["lang"].combine_chunks()), "word": word.dictionary.take(n["word"].combine_chunks()).cast(pa.string()), "n": n["count_all"]}))
    yield from tally.rest()


def _word_key(lang: str, word: bytes) -> bytes:
    """What a word is looked up by; no word holds a tab, so languages stay apart. A digest's key has a tab more."""
    return lang.encode() + b"\t" + (word if len(word) <= LONG_WORD else b"\t" + hashlib.sha256(word).digest())


def _joined(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(keys), np.uint8), np.cumsum([0, *map(len, keys)])


def word_trie(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A trie of (lang, word, id)."""
    keys = [_word_key(a, b.encode()) for a, b in zip(rows["lang"].to_pylist(), rows["word"].to_pylist(), strict=True)]
    return DoubleArray(*_joined(keys), rows["id"].to_numpy()).arrays


def look_up(trie: tuple, langs: list[str], code: np.ndarray, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The number of each word, 0 where the trie has none: all words advance together, byte by byte, longest first."""

    def walk(key: bytes) -> int:
        state = np.array([ROOT])
        for c in key:
            state = step(trie, state, c)
        return int(state[0])

    at_lang = np.array([walk(x.encode() + b"\t") for x in langs], np.int32)
    found = np.zeros(len(start), np.int32)
    n = stop - start
    for i in np.flatnonzero(n > LONG_WORD):
        found[i] = trie[2][walk(_word_key(langs[code[i]], data[start[i] : stop[i]].tobytes()))]
    short = np.flatnonzero(n <= LONG_WORD)
    short = short[np.argsort((LONG_WORD - n[short]).astype(np.uint8), kind="stable")]
    n, at, state = n[short], start[short], at_lang[code[short]]
    for level, m in enumerate(np.searchsorted(-n, -np.arange(1, LONG_WORD + 1), side="right")):
        state[:m] = step(trie, state[:m], data[at[:m] + level])
    found[short] = trie[2][state]
    return found


def _encode(trie, last: bool):
    """Texts to numbers of words, 0 for words without one and before each piece; numbers of earlier blocks are added."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _ROUND_BYTES):
            langs, code = _lang_codes(batch)
            data, start, stop, text, fresh = words_of(batch.column(1))
            gaps = np.append(0, np.cumsum(fresh))
            ids = np.zeros(len(start) + gaps[-1], np.int32)
            ids[np.arange(len(start)) + gaps[1:]] = look_up(trie.value, langs.to_pylist(), code[text], data, start, stop)
            before = raw(batch.column(2))[0]
            if len(before):
                ids += np.frombuffer(before.tobytes(), np.int32)
            words = np.searchsorted(text, np.arange(batch.num_rows + 1))
            at = (words + gaps[words]).astype(np.int64) * 4
            column = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(at), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([column] if last else [batch.column(0), batch.column(1), column], names=["ids"] if last else ["lang", "text", "ids"])

    return run


def _crc32(ids: np.ndarray) -> np.ndarray:
    """CRC-32 of each row's ids as big-endian 32-bit numbers, as SQL's crc32 gives it."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    c = np.full(len(ids), 0xFFFFFFFF, np.uint32)
    for j in range(ids.shape[1]):
        for shift in (24, 16, 8, 0):
            c = table[(c ^ (ids[:, j] >> shift).astype(np.uint32)) & np.uint32(255)] ^ (c >> np.uint32(8))
    return c ^ np.uint32(0xFFFFFFFF)


def _walk(trie: tuple, ids: np.ndarray, at: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the places `at` those where a phrase of k words begins that the trie has, and its number."""
    state = np.full(len(at), ROOT, np.int32)
    for j in range(k):
        for shift in range(8 * width - 8, -1, -8):
            state = step(trie, state, (ids[at + j] >> shift) & 255)
        alive = state != DEAD
        at, state = at[alive], state[alive]
    return at, trie[2][state]


def _keys(ids: np.ndarray) -> pa.Array:
    """Rows of ids as big-endian bytes."""
    at = np.arange(len(ids) + 1, dtype=np.int32) * (4 * ids.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(at), pa.py_buffer(ids.astype(">i4").tobytes())])


def _advance(found, k: int, width: int, block: int, blocks: int, further: bool):
    """Partial counts by key: of the trie's phrases of k words, and of the phrases of one word more that may be frequent.

    Such a phrase begins with one of the trie's and, as the words after its first are a phrase of k words too, that one is
    in the trie as well, unless it belongs to another block.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, phrases = found.value if found else (None, None)
        counts = np.zeros(len(phrases) + 1 if found else 0, np.int64)
        tally = Tally(["n"], 1_500_000)
        for batch in slices(batches, "ids", _ROUND_BYTES):
            ids = np.frombuffer(raw(batch.column(0))[0].tobytes(), np.int32)
            if len(ids) < k:
                continue
            known = ids > 0
            full = known[: len(ids) - k + 1].copy()
            for j in range(1, k):
                full &= known[j : len(ids) - k + 1 + j]
            at, number = _walk(trie, ids, np.flatnonzero(full), k, width) if found else (np.flatnonzero(full), ids[full])
            if found:
                counts += np.bincount(number, minlength=len(counts))
            if not further:
                continue
            more = at + k < len(ids)
            more[more] = known[at[more] + k]
            at, number = at[more], number[more]
            if found:
                here = np.zeros(len(ids), bool)
                here[_walk(trie, ids, at + 1, k, width)[0]] = True
                good = here[at + 1]
                if blocks > 1:
                    good |= _crc32(np.stack([ids[at + 1 + j] for j in range(k)], 1)) % blocks != block
                at, number = at[good], number[good]
            yield from _handed(tally.add(pa.table(dict(zip(("code", "n"), np.unique(number.astype(np.int64) << 32 | ids[at + k], return_counts=True), strict=True)))), phrases)
        yield from _handed(tally.rest(), phrases)
        some = np.flatnonzero(counts)
        if len(some):
            yield pa.RecordBatch.from_arrays([_keys(phrases[some - 1]), pa.array(counts[some])], names=["key", "n"])

    return run


def _handed(batches: Iterator[pa.RecordBatch], phrases: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        code = b.column(0).to_numpy()
        head = (code >> 32).astype(np.int32)
        ids = np.column_stack([head if phrases is None else phrases[head - 1], (code & 0xFFFFFFFF).astype(np.int32)])
        yield pa.RecordBatch.from_arrays([_keys(ids), b.column(1)], names=["key", "n"])


def _numbered(df: DataFrame) -> DataFrame:
    """`df` with ids from 1 without gaps, given once as it is written; offsets are one row a partition."""
    part, at = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    x = stored(df.withColumn("_m", F.monotonically_increasing_id()), "numbered")
    sizes = x.groupBy(part.alias("_p")).agg((F.max(at) + 1).alias("_n"))
    base = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    found = stored(x.withColumn("_p", part).join(F.broadcast(base), "_p").select(*df.columns, (F.col("_base") + at + 1).cast("int").alias("id")), "vocabulary")
    forget(x)
    return found


def _blocks(size: int, block_bytes: int) -> int:
    return max(1, -(-size // block_bytes))


def _counted(rows: DataFrame, words: DataFrame, least: int, longest: int, block_bytes: int) -> tuple[DataFrame, list[DataFrame]]:
    """(vocabulary, tables of (key, n) by phrase): exact counts of all phrases of up to `longest` words that are frequent."""
    spark = rows.sparkSession
    vocabulary = _numbered(words.filter(F.col("n") >= least))
    n, size = vocabulary.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.least(F.octet_length("word"), F.lit(LONG_WORD)) + F.octet_length("lang")), F.lit(0))).first()
    blocks = _blocks(size, block_bytes)
    texts = rows.withColumn("ids", F.lit(b""))
    for b in range(blocks):
        part = vocabulary.filter(F.pmod(F.xxhash64("lang", "word"), F.lit(blocks)) == b).select("lang", "word", "id").toArrow()
        trie = spark.sparkContext.broadcast(word_trie(part))
        before = texts
        texts = stored(texts.mapInArrow(_encode(trie, b == blocks - 1), "ids binary" if b == blocks - 1 else "lang string, text string, ids binary").filter(F.lit(b < blocks - 1) | (F.octet_length("ids") > 0)), "word-numbers")
        trie.destroy()
        if b:
            forget(before)
    width = 1 + max(1, (int(n).bit_length() - 1) // 8)
    tables, candidates = [], None
    for k in range(1, longest + 1):
        parts = []
        blocks = _blocks(4 * k * candidates.count(), block_bytes) if candidates is not None else 1
        for b in range(blocks):
            trie = None
            if candidates is not None:
                part = candidates if blocks == 1 else candidates.filter(F.crc32("key") % blocks == b)
                keys = part.toArrow()["key"].combine_chunks()
                phrases = np.frombuffer(raw(keys)[0].tobytes(), ">i4").reshape(-1, k)
                flat = np.ascontiguousarray(phrases.astype(">i4")).view(np.uint8).reshape(len(phrases), k, 4)[:, :, 4 - width :].reshape(-1)
                trie = spark.sparkContext.broadcast((DoubleArray(flat, np.arange(len(phrases) + 1) * k * width, np.arange(1, len(phrases) + 1)).arrays, phrases.astype(np.int32)))
            found = texts.mapInArrow(_advance(trie, k, width, b, blocks, k < longest), "key binary, n bigint").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
            parts.append(stored(found, f"phrases-{k}"))
            if trie:
                trie.destroy()
        both = parts[0]
        for more in parts[1:]:
            both = both.unionByName(more)
        if k > 1:
            tables.append(both.filter(F.octet_length("key") == 4 * k))
        candidates = both.filter(F.octet_length("key") == 4 * (k + 1)).select("key")
        if candidates.isEmpty():
            break
    forget(texts)
    return vocabulary, tables


def _first_of_each(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first n rows of each key, with their rank: rows are ordered in parts of about ORDERED_ROWS first, whose first n go on."""
    while (rows := df.groupBy(key).count().agg(F.max("count")).first()[0] or 0) > max(ORDERED_ROWS, 2 * n):
        part = F.pmod(F.xxhash64("phrase"), F.lit(-(-rows // max(ORDERED_ROWS, 2 * n))))
        df = stored(df.withColumn("rank", F.row_number().over(Window.partitionBy(key, part).orderBy(*order))).filter(F.col("rank") <= n).drop("rank"), "first")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= n)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST_COUNT, longest: int = LONGEST, held_percent: int = HELD_PERCENT, first: int = 2000, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The `first` best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Words are what lies between spaces and tabs of a piece, A-Z in lower case; pieces end at any of .,;:!? and line ends. A
    phrase is 2 to `longest` words of a piece that occur at least `least` times (a, overlaps included) in a language of n
    words. Cut in two parts that occur l and r times, it scores floor(SCALE * a / (l + r)); the cut of the lowest score
    counts, the shortest first part of equals. A phrase goes if a longer one that holds it has held_percent of its
    occurrences. Rank is by score, then a (largest first), then the phrase's bytes. All counts and scores are exact.

    Null texts are empty ones, rows without a language are of `und`. Rows that repeat count again. Texts and words of any
    length are read whole. Empty tables and texts without frequent words give no rows. Other columns play no part.

    Frequent words get numbers, texts become numbers, and then there is a pass for each phrase length: a double-array trie
    of the candidates is broadcast, all places of the texts advance through it, the states they end in are counted, and
    what follows gives the next candidates, whose shorter parts are all candidates. Tries take block_bytes of keys at most;
    further ones are further passes. A cut is by a hash of the key, so a block may pass the bound by the hash's unevenness.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = stored(rows.mapInArrow(_count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    vocabulary, tables = _counted(rows, words, least, longest, block_bytes)
    phrases = docs.sparkSession.createDataFrame([], "key binary, n bigint")
    for t in tables:
        phrases = phrases.unionByName(t)
    one = vocabulary.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("key"), "n")
    parts = one.unionByName(phrases.filter(F.octet_length("key") < 4 * longest))
    size = F.octet_length("key")
    cuts = phrases.select("key", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), (size / 4).cast("int") - 1)).alias("k"))
    cuts = cuts.select("key", "a", "k", F.expr("substring(key, 1, 4 * k)").alias("head"), F.expr("substring(key, 4 * k + 1)").alias("tail"))
    cuts = cuts.join(parts.select(F.col("key").alias("head"), F.col("n").alias("l")), "head").join(parts.select(F.col("key").alias("tail"), F.col("n").alias("r")), "tail")
    score = F.call_function("div", F.lit(SCALE).cast("decimal(8,0)") * F.col("a").cast("decimal(19,0)"), F.col("l") + F.col("r"))  # may pass 64 bits before the division
    best = cuts.groupBy("key", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x")).select("key", "a", "x.score", "x.l", "x.r")
    # of longer phrases that hold one, one by a word has most occurrences
    longer = phrases.filter(size >= 12).select("n", F.explode(F.array(F.expr("substring(key, 1, octet_length(key) - 4)"), F.expr("substring(key, 5)"))).alias("key")).groupBy("key").agg(F.max("n").alias("most"))
    decimal = lambda c: F.col(c).cast("decimal(19,0)")
    kept = best.join(longer, "key", "left").filter(F.col("most").isNull() | (100 * decimal("most") < held_percent * decimal("a"))).drop("most")
    word = F.posexplode(F.expr("transform(sequence(0, octet_length(key) div 4 - 1), i -> cast(conv(hex(substring(key, 4 * i + 1, 4)), 16, 10) as int))")).alias("at", "id")
    named = kept.select("key", word).join(vocabulary.select("id", "lang", "word"), "id").groupBy("key").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    scored = stored(kept.join(named, "key").select("lang", "phrase", "a", "l", "r", "score"), "scored")
    ranked = _first_of_each(scored, "lang", [F.col("score").desc(), F.col("a").desc(), "phrase"], first)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
