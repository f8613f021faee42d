"""Secret scan: known shapes, and random strings that a tokenizer cannot shorten."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackworks.llm.shared import own_name, passed_through, slices, with_columns

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
# longer runs of the same class are the same match, so the least lengths can be part of the patterns
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
# an equals sign may stand before a string, as in name=value, and belongs to it only as padding at the end
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
#: Hex digits of common digests: md5, sha1, sha224, sha256, sha384, sha512.
DIGEST_LENGTHS = frozenset({32, 40, 56, 64, 96, 128})
#: Characters a token at or below which a string counts as random; words and paths have more.
MAX_CHARS_PER_TOKEN = 2.2


def is_known(s: str) -> bool:
    """Digests, UUIDs, plain numbers and runs of one character, which are no secrets however random they look."""
    return bool(UUID.fullmatch(s)) or bool(DIGEST.fullmatch(s)) and len(s) in DIGEST_LENGTHS or s.isdigit() or len(set(s)) <= 3


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known shapes, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, n_tokens, most: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidate strings with few characters a token. Mixed classes are asked for, so that long words of any tongue stay out."""
    found = []
    for m in CANDIDATE.finditer(text):
        s = m.group()
        if not is_known(s) and any(c.isdigit() for c in s) + any(c.islower() for c in s) + any(c.isupper() for c in s) >= 2 and len(s) <= most * n_tokens(s):
            found.append((m.start(), 3, m.end()))
    return found


def within(span: tuple[int, int, int], base: list[tuple[int, int, int]]) -> bool:
    """Whether the sorted `base` spans together cover all of `span`."""
    at = span[0]
    for a, _, b in base:
        if a <= at < b:
            at = b
    return at >= span[2]


def load_counter(path: str, pattern: str):
    """Counts tokens of a string under a tiktoken vocabulary file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda s: len(enc.encode_ordinary(s))


def _scan(path: str, pattern: str, most: float, text: str, out: str):
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load_counter(path, pattern)
        for batch in slices(batches, text):
            rows = []
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                base = base_spans(t)
                own = [x for x in random_spans(t, count, most) if not within(x, base)]
                rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(base + own)])
            yield with_columns(batch, drop=[text], **{out: pa.array(rows, span)})

    return run


def find_secrets(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", out: str = "secrets", max_chars_per_token: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """`docs` and an array of (kind, start, end), by start and then kind; offsets are code points, ends exclusive.

    kinds: assign (name, sign, value of 8+ characters), access (key ids), hex (32+ digits) and random: strings of 20+
    characters of at most `max_chars_per_token` characters a token under the tiktoken `vocabulary` (split by `pattern`),
    that aren't known digests, UUIDs or numbers and aren't all within spans of other kinds. Null and empty texts have none;
    texts of any length are read whole; an empty table gives an empty table. Each row is judged alone, so repeated rows and ids don't matter; other columns stay, and a clash puts underscores
    before `out`.
    """
    out, text = own_name(docs, out), own_name(docs, "scanned_text")
    df = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    return df.mapInArrow(_scan(vocabulary, pattern, max_chars_per_token, text, out), passed_through(docs, **{out: "array<struct<kind:string,start:bigint,end:bigint>>"}))


def redacted(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """`docs` with every span replaced by `mask`; overlapping spans give one.

    Null texts stay null, texts without spans as they are, whole texts of any length are read, repeated rows are judged
    alike, an empty table stays empty. Columns and their names stay.
    """
    out = own_name(docs, "secrets")
    found = find_secrets(docs, vocabulary, pattern, text_col, out)
    merged = F.aggregate(
        F.col(out), F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(
            F.when(s["start"] >= a["at"], F.concat(a["done"], F.substring(F.col(text_col), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mask))).otherwise(a["done"]).alias("done"),
            F.greatest(a["at"], s["end"]).alias("at")),
        lambda a: F.concat(a["done"], F.substring(F.col(text_col), (a["at"] + 1).cast("int"), F.length(F.col(text_col)))),
    )
    return found.withColumn(text_col, F.when(F.size(out) > 0, merged).otherwise(F.col(text_col))).drop(out)
