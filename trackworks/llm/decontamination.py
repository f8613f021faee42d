"""Benchmark decontamination: windows of benchmark words looked up in every document."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackworks.llm.shared import Words, alnum_words, ascii_fold, own_name, passed_through, slices, stored, with_columns

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of benchmark text that one pass over the documents looks for; a larger benchmark takes more passes. A task's table
#: has about eight times as many.
BLOCK_BYTES = 16 << 20
#: Items of more bytes are cut in pieces of so many words.
PIECE_BYTES, PIECE_WORDS = 1 << 20, 1 << 16
_FILTER_BITS = 22


def words(text: str | None) -> list[str]:
    """Words of a text, A-Z in lower case and nothing else changed."""
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


class WindowSet:
    """The windows of benchmark items in arrays: sorted hashes to look up, and the words and items to verify hits with."""

    def __init__(self, items: list[tuple[object, str]], size: int) -> None:
        w = Words(pa.array([text or "" for _, text in items], pa.large_string()), ascii_fold(), alnum_words())
        self.names, self.first = [None if i is None else str(i) for i, _ in items], w.first
        self.data, self.start, self.end = w.data.tobytes(), w.start, w.end
        n = np.diff(w.first)
        #: by length in words: hashes, the number of each window's first word, and bits of the hashes
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in np.unique(np.minimum(n[n > 0], size)).tolist():
            h, at = w.runs(k)
            own = n[np.searchsorted(w.first, at, side="right") - 1]
            use = own >= k if k == size else own == k  # an item of fewer words is one window
            h, at = h[use], at[use]
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[h >> np.uint64(64 - _FILTER_BITS)] = True
            self.by_length[k] = h[order], at[order], bits
        self.met: dict[tuple[int, int], dict[bytes, list[str]]] = {}

    def said(self, first: int, k: int) -> bytes:
        return b" ".join(self.data[self.start[j] : self.end[j]] for j in range(first, first + k))

    def items(self, k: int, h: int, said: bytes) -> list[str | None]:
        """The ids of items that hold a window, given its hash and words, None among them for items without one; none if only the hash is the same."""
        if (k, h) not in self.met:
            known, at, _ = self.by_length[k]
            found: dict[bytes, set] = defaultdict(set)
            for first in at[np.searchsorted(known, np.uint64(h)) : np.searchsorted(known, np.uint64(h), side="right")].tolist():
                found[self.said(first, k)].add(self.names[int(np.searchsorted(self.first, first, side="right")) - 1])
            self.met[k, h] = {x: sorted(own, key=lambda i: (i is None, i)) for x, own in found.items()}
        return self.met[k, h].get(said, [])


def _scan(windows: WindowSet, text: str, hits: str):
    fold, inside = ascii_fold(), alnum_words()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            w = Words(batch.column(batch.schema.get_field_index(text)), fold, inside)
            hit = np.zeros(len(w.hash) + 1, np.int64)  # +1 where a window begins, -1 after it
            items: dict[int, set] = defaultdict(set)
            body = w.data.tobytes()
            for k, (known, _, bits) in windows.by_length.items():
                h, at = w.runs(k)
                maybe = np.flatnonzero(bits[h >> np.uint64(64 - _FILTER_BITS)])
                place = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
                maybe = maybe[known[place] == h[maybe]]
                doc = np.searchsorted(w.first, at[maybe], side="right") - 1
                for i, d in zip(maybe, doc, strict=True):
                    first = int(at[i])
                    own = windows.items(k, int(h[i]), b" ".join(body[w.start[j] : w.end[j]] for j in range(first, first + k)))
                    if own:
                        hit[first] += 1
                        hit[first + k] -= 1
                        items[int(d)].update(x for x in own if x is not None)
            # a window never leaves its text, so the running sum is 0 at each text's first word
            inside_hit = np.cumsum(hit[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], inside_hit.view(np.int8), [0]])))
            cut = np.setdiff1d(w.first, edge)  # hit words at both sides of a text's end are two spans
            cut = cut[(cut > 0) & (cut < len(inside_hit))]
            cut = cut[inside_hit[cut - 1] & inside_hit[cut]] if len(cut) else cut
            spans = np.sort(np.concatenate([edge, cut, cut])).reshape(-1, 2)
            own = np.searchsorted(w.first, spans[:, 0], side="right") - 1 if len(spans) else np.empty(0, np.int64)
            by_doc = defaultdict(list)
            for d, (a, b) in zip(own.tolist(), spans.tolist(), strict=True):
                z = w.offsets[d]
                by_doc[d].append({"first_word": a - int(w.first[d]), "words": b - a, "start": int(w.start[a] - z), "end": int(w.end[b - 1] - z)})
            n = batch.num_rows
            kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
            rows = [{"n_words": int(c), "spans": by_doc.get(d, []), "items": sorted(items.get(d, ()))} for d, c in zip(range(n), np.diff(w.first), strict=True)]
            yield with_columns(batch, **{hits: pa.array(rows, kind)})

    return run


_HITS = "struct<n_words:bigint,spans:array<struct<first_word:bigint,words:bigint,start:bigint,end:bigint>>,items:array<string>>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", out: str = "contamination", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` and a struct column: n_words, spans of hit words (word and byte offsets, end exclusive) and item ids.

    Windows are `window` consecutive words of an item; an item of fewer words, but not none, is one window. They are
    broadcast as a hash set in blocks of about `block_bytes` of benchmark text, which a pass and the driver hold: the sizes
    are summed first, and a larger benchmark is looked for block by block, each pass writing what it finds before the next
    begins; a document's spans are then merged. A long item is cut in ranges of words that overlap by a window less a word,
    so a block holds no more of it than others, and pieces are dealt by a hash. Hits are verified word by word, so a hash
    collision never counts.

    Null and empty texts have no words and no hits; texts of any length are read whole. Words inside the windows of an item
    without an id are hit like others, only there is no id to list; repeated items and empty tables are harmless; rows that repeat are judged alike. Extra columns stay; where one is called `out`, the
    new one gets underscores before its name.
    """
    out = own_name(docs, out)
    text = own_name(docs, "scanned_text")
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    items = _pieces(items, window)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    found = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    block = lambda b: WindowSet([(r["item"], r["text"]) for r in (items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)).toLocalIterator()], window)
    if blocks == 1:
        return found.mapInArrow(_scan(block(0), text, out), passed_through(found, **{out: _HITS})).drop(text)
    # rows are numbered once, as they are written, so that what each pass finds can be put together
    row = own_name(found, "row_number")
    found = stored(found.withColumn(row, F.monotonically_increasing_id()), "numbered")
    hits = None
    for b in range(blocks):
        own = found.select(F.col(row).alias("row"), F.col(text).alias("text"))
        passed = own.mapInArrow(_scan(block(b), "text", "c"), passed_through(own, c=_HITS))
        # every row once, for its number of words; later passes only write rows with hits
        passed = stored((passed if b == 0 else passed.filter("size(c.spans) > 0")).select("row", "c"), "hits")
        hits = passed if hits is None else hits.unionByName(passed)
    spans = F.array_sort(F.flatten(F.collect_list("c.spans")))
    by_row = hits.groupBy("row").agg(F.max("c.n_words").alias("n_words"), spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("c.items")))).alias("items"))
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<first_word:bigint,words:bigint,start:bigint,end:bigint>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["first_word"] + F.get(done, F.size(done) - 1)["words"] >= s["first_word"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(_joined(F.get(done, F.size(done) - 1), s))),
        ).otherwise(F.concat(done, F.array(s))),
    )
    by_row = by_row.select(F.col("row").alias(row), F.struct("n_words", merged.alias("spans"), "items").alias(out))
    return found.join(by_row, row).drop(text, row)


def _pieces(items: DataFrame, window: int) -> DataFrame:
    """Items, long ones as ranges of words that share window - 1 words with the next, so that each window is in one of them."""
    long = F.octet_length("text") > PIECE_BYTES
    words_ = F.regexp_extract_all("text", F.lit(WORD.pattern), F.lit(0))
    cut = items.filter(long).select("item", words_.alias("w")).filter(F.size("w") > 0).select("item", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(PIECE_WORDS))).alias("at"))
    cut = cut.filter((F.col("at") == 0) | (F.size("w") - F.col("at") >= window))  # a shorter end is in the piece before
    return items.filter(~long).unionByName(cut.select("item", F.array_join(F.slice("w", F.col("at") + 1, F.lit(PIECE_WORDS + window - 1)), " ").alias("text")))


def _joined(a, b):
    end = F.greatest(a["first_word"] + a["words"], b["first_word"] + b["words"])
    return F.struct(a["first_word"].alias("first_word"), (end - a["first_word"]).alias("words"), a["start"].alias("start"), F.greatest(a["end"], b["end"]).alias("end"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, action: str = "spans", max_hit_share: float = 0.5, text_col: str = "text", **names: str) -> DataFrame:
    """Remove benchmark passages from `docs`: action "spans" cuts them out, "documents" drops documents with any.

    With "spans" a document is dropped all the same where more than `max_hit_share` of its words are hit. Documents
    without hits are kept as they are, null texts too. Columns are those of `docs`.
    """
    if action not in ("spans", "documents"):
        raise ValueError(f"action is spans or documents, not {action}")
    c = own_name(docs, "contamination")
    found = find_contamination(docs, benchmark, window, text_col, out=c, **names)
    hit = F.aggregate(F.col(f"`{c}`.spans"), F.lit(0).cast("long"), lambda n, s: n + s["words"])
    if action == "documents":
        return found.filter(hit == 0).drop(c)
    b = F.encode(F.col(text_col), "utf-8")
    spans = F.col(f"`{c}`.spans")
    # what lies before the first span, between two, and after the last; offsets are of bytes
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(F.col(text_col)).cast("long")))
    kept = F.array_join(F.zip_with(starts, ends, lambda s, e: F.decode(F.substring(b, (s + 1).cast("int"), (e - s).cast("int")), "utf-8")), "")
    return (
        found.filter(hit <= max_hit_share * F.greatest(F.col(f"`{c}`.n_words"), F.lit(1)))
        .withColumn(text_col, F.when(F.size(spans) > 0, kept).otherwise(F.col(text_col)))
        .drop(c)
    )
