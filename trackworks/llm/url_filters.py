"""URL filtering with a Bloom filter cascade, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackworks.llm.shared import stored

#: Bits a key and hash functions of each level: about 9 % false positives, which the next level puts right at a smaller cost
#: than longer filters; levels shrink about elevenfold.
BITS_PER_KEY, HASHES = 5, 3
#: Words of 64 bits of the longest filter (1 MB); beyond it keys are dealt into parts.
MAX_WORDS = 1 << 17


def url_host(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z in lower case; empty for null or without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def addresses(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Keys (host and path) of `pages`, once each. Null URLs and ones without :// have none; repeated rows give one."""
    key = F.concat(url_host(F.col(url_col)), url_path(F.col(url_col)))
    return pages.select(key.alias("key")).filter("key <> ''").distinct()


def _bits(key: str, level: int, words: Column) -> list[Column]:
    """The bits of a key in a filter of `words` words."""
    return [F.pmod(F.xxhash64(F.lit(level * 100 + i), F.col(key)), words * 64) for i in range(HASHES)]


class Cascade:
    """Exact membership of listed keys within a universe of keys, as filters only.

    Level 0 holds the listed keys, level 1 the other keys of the universe that level 0 takes for listed, level 2 the
    listed keys that level 1 takes for others, and so on until nothing is taken wrongly. A key of the universe is listed
    if the first level that doesn't hold it is an odd one; none can fail at the last.

    Keys are dealt into parts by hash, so that no filter is longer than about `max_words`. Each level is built for all
    parts at once. One part is a row that every task gets, of at most a few MB by max_words; with more, keys meet their
    part's filters by the part's number, in one pass.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame, key: str = "key", max_words: int = MAX_WORDS, max_levels: int = 40) -> None:
        listed = listed.select(F.col(key).alias("key")).filter("key is not null").distinct()
        n = listed.count()
        self.parts = max(1, -(-n * BITS_PER_KEY // (64 * max_words)))
        ours = stored(listed.select("key", self.part("key").alias("part")), "listed")
        others = universe.select(F.col(key).alias("key")).filter("key is not null").distinct().join(ours.select("key"), "key", "left_anti")
        others = stored(others.select("key", self.part("key").alias("part")), "others")
        #: by level: (part, words), an array of bits for each part that has keys at that level
        self.levels: list[DataFrame] = []
        now, then = ours, others
        while n:
            if len(self.levels) == max_levels:
                raise RuntimeError("the cascade does not end: a key is listed and not")
            self.levels.append(stored(self._filters(now, len(self.levels)), "filters"))
            k = len(self.levels) - 1
            met, words = self._with_filters(then, [k])
            held = met.filter(self._test("key", k, words[0]))
            now, then = stored(held.select("key", "part"), "false_positives"), now
            n = now.count()

    def part(self, key: str) -> Column:
        return F.coalesce(F.pmod(F.xxhash64(F.lit(-1), F.col(key)), F.lit(self.parts)), F.lit(0)).cast("int")

    @staticmethod
    def _filters(keys: DataFrame, level: int) -> DataFrame:
        """(part, words). Bits are set by word before words are put together; words without a bit come from a range."""
        sizes = keys.groupBy("part").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * BITS_PER_KEY / 64)).cast("int").alias("n"))
        sized = keys.join(F.broadcast(sizes), "part")  # a row a part
        bit = F.explode(F.array(*_bits("key", level, F.col("n")))).alias("bit")
        by_word = sized.select("part", bit).select("part", F.shiftright("bit", 6).cast("int").alias("i"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("w"))
        none = sizes.select("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), F.lit(0).cast("long").alias("w"))
        words = by_word.unionByName(none).groupBy("part", "i").agg(F.bit_or("w").alias("w"))
        return words.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("words"))

    def _with_filters(self, df: DataFrame, levels: list[int]) -> tuple[DataFrame, list[Column]]:
        """df and the words of a row's part at each of `levels` (null where the part has no keys there)."""
        if self.parts == 1:
            return df, [self.levels[k].select("words").scalar() for k in levels]
        found = None
        for k in levels:
            level = self.levels[k].select("part", F.lit(k).alias("k"), "words")
            found = level if found is None else found.unionByName(level)
        own = [F.max(F.when(F.col("k") == k, F.col("words"))).alias(f"filter{k}") for k in levels]
        return df.join(found.groupBy("part").agg(*own), "part", "left"), [F.col(f"filter{k}") for k in levels]

    @staticmethod
    def _test(key: str, level: int, words: Column) -> Column:
        """Whether a filter has all bits of the key; no filter has none."""
        hit = words.isNotNull()
        for b in _bits(key, level, F.size(words)):
            hit = hit & (F.getbit(F.get(words, F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return F.coalesce(hit, F.lit(False))

    def listed(self, df: DataFrame, key: str, out: str) -> DataFrame:
        """df and boolean `out`: whether its key, one of the universe, is listed; null keys are not. Keys aren't joined with keys."""
        if not self.levels:
            return df.withColumn(out, F.lit(False))
        names = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]  # no clash with part and filters
        at = f"c{df.columns.index(key)}"
        x, words = self._with_filters(df.select(*names).withColumn("part", self.part(at)), list(range(len(self.levels))))
        verdict = F.lit(len(self.levels) % 2 == 1)  # every level holds it: the last one decides
        for i in reversed(range(len(self.levels))):
            verdict = F.when(self._test(at, i, words[i]), verdict).otherwise(F.lit(i % 2 == 1))
        return x.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)], (F.col(at).isNotNull() & verdict).alias(out))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame, listed_key: str = "key", url_col: str = "url", max_words: int = MAX_WORDS) -> DataFrame:
    """`pages` with host, path, rule (null where none fits) and verdict (allow or block).

    rules: (verdict, "host/path"); a rule fits its host and all subdomains if the path starts with the rule's. The
    longest host wins, then the longest path. Other URLs are blocked if host and path together are a key of `listed`,
    else allowed; the cascade is built over all such keys of `pages`, so its answers are exact.

    Null and empty URLs, and ones without ://, have empty host and path and fit no rule; an empty key is listed only if
    the list has it. A URL of any length is read whole. Repeated rows are judged alike. Columns of `pages` with one of the
    new names, in any case, are replaced; others stay. An empty table gives an empty table, an empty list lists nothing.
    """
    new = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c.lower() not in new]
    df = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    order = sorted(rules, key=lambda r: (-len(r[1].split("/", 1)[0]), -len(r[1]), r[1]))
    fits = F.lit(None).cast("string")
    says = F.lit(None).cast("string")
    for verdict, rule in reversed(order):
        host, path = rule.split("/", 1)
        fit = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        fits, says = F.when(fit, F.lit(rule)).otherwise(fits), F.when(fit, F.lit(verdict)).otherwise(says)
    df = df.withColumn("url_key", F.concat("host", "path"))
    cascade = Cascade(listed.select(F.col(listed_key).alias("key")), df.select(F.col("url_key").alias("key")), max_words=max_words)
    judged = cascade.listed(df, "url_key", "url_listed").withColumns({"rule": fits, "verdict": F.coalesce(says, F.when(F.col("url_listed"), "block").otherwise("allow"))})
    return judged.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *new)
