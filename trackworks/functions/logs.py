"""Training-log lines and programme texts as typed columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How runs end, as a log says it, and what begins or ends the other events of a log (fixed values).
ENDINGS = ("finished clean", "ended after resume", "stopped by SIGINT", "CRASHED TWICE", "CRASHED")
EPOCH, CLASS_VALUE, AVERAGE, SKIPPED, NO_TIME_LEFT, LOSS, END = "Train epoch: ", "Instr ", "Metric avg ", " non-finite skipped", "<00:00", "loss=", "=== "

_EVENT = "struct<place: int, kind: string, name: string, value: double, elapsed: string>"


def _events(line: Column, marker: str, kind: str, read: Callable[[Column, Column], tuple[Column, Column, Column, Column]]) -> Column:
    """Events at each place of a marker: read gets what is before it and what is after it, and says (is one, name, value, elapsed)."""
    parts = F.split(line, re.escape(marker))

    def event(i: Column) -> Column:
        before, after = F.array_join(F.slice(parts, 1, i), marker), F.get(parts, i)
        is_one, name, value, elapsed = read(before, after)
        found = F.struct(F.length(before).alias("place"), F.lit(kind).alias("kind"), name.cast("string").alias("name"), value.cast("double").alias("value"), elapsed.cast("string").alias("elapsed"))
        return F.when(is_one, found.cast(_EVENT))

    return F.when(F.size(parts) > 1, F.filter(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), event), lambda e: e.isNotNull())).otherwise(F.array().cast(f"array<{_EVENT}>"))


def _token(text: Column, i: int) -> Column:
    """A text's token between spaces, counted from its start, or from its end if i is negative."""
    t = F.filter(F.split(text, " "), lambda x: x != "")
    return F.get(t, F.lit(i) if i >= 0 else F.size(t) + i)


def line_events(df: DataFrame, line: str = "line") -> DataFrame:
    """A row for each event of a line, with its place in the line, kind, name, value and elapsed text; lines without any go.

    epoch: value is its number. class_value: name is the class, value its score. average: name is the metric. non_finite:
    value is how many steps were skipped. bar: a progress bar that is full, value is its total. nan_loss: a loss that is no
    finite number, name is its text. trailer: name is how the run ended, one of ENDINGS. A log is one stream of redrawn
    bars, so an event may stand anywhere in a line, and a line may hold several.
    """
    c = F.coalesce(F.col(line), F.lit(""))
    null = F.lit(None)
    number = lambda x: x.try_cast("double")
    whole = lambda x: x.try_cast("long")

    def class_value(_: Column, after: Column) -> tuple[Column, ...]:
        value = number(_token(after, 2))
        return F.endswith(_token(after, 1), F.lit(":")) & value.isNotNull(), _token(after, 0), value, null

    def average(_: Column, after: Column) -> tuple[Column, ...]:
        name, value = F.trim(F.substring_index(after, ":", 1)), number(_token(F.substring(after, F.instr(after, ":") + 1, F.length(after)), 0))
        return value.isNotNull() & ~name.contains(" "), name, value, null

    def bar(before: Column, _: Column) -> tuple[Column, ...]:
        elapsed, counts = F.substring_index(before, "[", -1), F.split(_token(F.substring(before, 1, F.length(before) - F.length(F.substring_index(before, "[", -1)) - 1), -1), "/")
        # what stands before the count, such as a bar drawn without a space, isn't part of it
        done, total = whole(F.regexp_extract(F.get(counts, F.size(counts) - 2), r"\d+$", 0)), whole(F.get(counts, F.size(counts) - 1))
        times = F.transform(F.split(elapsed, ":"), whole)
        is_time = F.size(times).between(2, 3) & F.forall(times, lambda t: t.isNotNull())
        return is_time & (done == total), null, total, elapsed

    def loss(_: Column, after: Column) -> tuple[Column, ...]:
        text = F.get(F.split(after, r"[^-+.\w]"), F.lit(0))
        value = number(text)
        return F.isnan(value) | (F.abs(value) == float("inf")), text, null, null

    def end(_: Column, after: Column) -> tuple[Column, ...]:
        said = F.ltrim(F.substring(after, F.instr(after, " "), F.length(after)))
        ways = F.filter(F.array(*map(F.lit, ENDINGS)), lambda w: F.startswith(said, w))  # a longer one comes before its beginning
        return (F.instr(after, " ") > 1) & (F.size(ways) > 0), F.get(ways, F.lit(0)), null, null

    def epoch(_: Column, after: Column) -> tuple[Column, ...]:
        return whole(_token(after, 0)).isNotNull(), null, whole(_token(after, 0)), null

    def skipped(before: Column, _: Column) -> tuple[Column, ...]:
        return whole(_token(before, -1)).isNotNull() & (_token(before, -2) == "steps;"), null, whole(_token(before, -1)), null

    found = [
        _events(c, EPOCH, "epoch", epoch), _events(c, CLASS_VALUE, "class_value", class_value), _events(c, AVERAGE, "average", average), _events(c, SKIPPED, "non_finite", skipped),
        _events(c, NO_TIME_LEFT, "bar", bar), _events(c, LOSS, "nan_loss", loss), _events(c, END, "trailer", end),
    ]
    return df.select("*", F.inline(F.array_sort(F.concat(*found))))


def programme(df: DataFrame, key: str, text: str) -> DataFrame:
    """Timestamped programme lines: key, pos, start_s and title; lines without a time go."""
    p = r"^\s*\[?((?:\d+:)?\d{1,2}:\d{2})\]?\s*[-–]?\s*(.*\S)\s*$"
    x = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "_l")).filter(F.regexp_like("_l", F.lit(p)))
    parts = F.transform(F.split(F.regexp_extract("_l", p, 1), ":"), lambda y: y.cast("int"))
    return x.select(key, "pos", F.aggregate(parts, F.lit(0), lambda a, y: a * 60 + y).alias("start_s"), F.regexp_extract("_l", p, 2).alias("title"))


def numbered_blocks(df: DataFrame, key: str, text: str, header: str = r"^(\d+)\.\s*(.*)$") -> DataFrame:
    """Lines with the number and title of the last numbered header at or above them; lines before any go."""
    x = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_header = F.regexp_like("line", F.lit(header))
    x = x.withColumn("number", F.last(F.when(is_header, F.regexp_extract("line", header, 1).cast("int")), True).over(w)).withColumn("title", F.last(F.when(is_header, F.regexp_extract("line", header, 2)), True).over(w))
    return x.filter(F.col("number").isNotNull() & ~is_header)


def credits(line: Column, allowed: list[str], others: list[str]) -> Column:
    """Credits `instrument/name·name` as (instrument, count, players): only allowed instruments, names of `others` dropped."""
    pairs = F.regexp_extract_all(line, F.lit(r"([^\s/]+/[^\s/]+)"), 1)
    made = F.transform(pairs, lambda p: F.struct(F.get(F.split(p, "/"), F.lit(0)).alias("instrument"), F.filter(F.split(F.get(F.split(p, "/"), F.lit(1)), "[·,]"), lambda n: (n != "") & ~n.isin(others)).alias("players")))
    kept = F.filter(made, lambda m: m["instrument"].isin(allowed) & (F.size(m["players"]) > 0))
    return F.transform(kept, lambda m: F.struct(m["instrument"].alias("instrument"), F.size(m["players"]).alias("n"), m["players"].alias("players")))
