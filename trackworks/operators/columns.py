"""Column expressions: names, levels, times and decisions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lowest level that amplitudes are given, in dB.
FLOOR_DB = -120.0


def nfc(text: Column) -> Column:
    """Unicode NFC; Spark has no function of its own for it."""

    def normalized(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))

    return F.pandas_udf(normalized, "string")(text)


def song_token(name: Column) -> Column:
    """What follows the last underscore or # sign of a file name."""
    return F.regexp_extract(name, r"[_#]([^_#]*)$", 1)


def without_digits(token: Column) -> Column:
    return F.regexp_replace(token, r"\d+$", "")


def path_after(path: Column, parts: int, sep: str = "/") -> Column:
    """A path without its first `parts` parts."""
    p = F.split(path, sep)
    return F.array_join(F.slice(p, parts + 1, F.greatest(F.size(p) - parts, F.lit(0))), sep)


def channel_action(corr: Column, identical: Column, mono_at: float = 0.999, pick_below: float = -0.9) -> Column:
    """mono, pick or stereo from the correlation of two channels; an unknown one is stereo."""
    c = F.coalesce(F.nanvl(corr.cast("double"), F.lit(None).cast("double")), F.lit(0.0))
    return F.when(identical | (c >= mono_at), "mono").when(c <= pick_below, "pick").otherwise("stereo")


def level_db(amplitude: Column, floor: float = FLOOR_DB) -> Column:
    """20 log10, with the floor for silence; null stays null."""
    return F.when(amplitude.isNull(), None).when(amplitude <= 0, F.lit(floor)).otherwise(F.greatest(F.lit(floor), 20 * F.log10(amplitude)))


def gain_of(db: Column, least: float, most: float) -> tuple[Column, Column, Column]:
    """The clamped gain in dB, its factor, and whether it was clamped."""
    clamped = F.least(F.greatest(db, F.lit(least)), F.lit(most))
    return clamped, F.pow(F.lit(10.0), clamped / 20), clamped != db


def flags(**conditions: Column) -> Column:
    """Names of the conditions that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))


def audit(**conditions: Column) -> Column:
    """The same as text, joined by semicolons."""
    return F.concat_ws(";", *[F.when(c, F.lit(n)) for n, c in conditions.items()])


def elapsed_seconds(text: Column) -> Column:
    """H:MM:SS or M:SS to seconds; anything else is null."""
    p = F.transform(F.split(text, ":"), lambda x: x.cast("int"))
    ok = F.regexp_like(text, F.lit(r"^\d+(:\d\d){1,2}$"))
    return F.when(ok, F.aggregate(p, F.lit(0), lambda a, x: a * 60 + x))


def clock(seconds: Column) -> Column:
    """Seconds as m:ss."""
    s = seconds.cast("long")
    return F.concat((s / 60).cast("long").cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def age_text(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat((s / 60).cast("long").cast("string"), F.lit("m"))).otherwise(F.concat((s / 3600).cast("long").cast("string"), F.lit("h")))


def blocks_of(seconds: Column, block_s: float) -> Column:
    """A length in blocks, rounded half to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(seconds / block_s).cast("int"))


def mentions(text: Column, keywords: list[str]) -> Column:
    """The keywords that a text holds, in the order given."""
    return F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(text, k))


def draw(seed: int, key: Column, stage: str) -> Column:
    """A number in [0, 1) from md5 of seed, key and stage: the same for any partitioning."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), F.lit(stage)))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(1 << 52)


def draw_sql(seed: int, key: str, stage: str) -> str:
    """draw() in DuckDB."""
    return f"(('0x' || substr(md5('{seed}|' || ({key})::VARCHAR || '|{stage}'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)"
