"""Chat formatting in budgeted windows, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackworks.operators.ranges import in_parts

#: Tokens of a window, turns repeated as history, and the most tokens these may have. Tokens are counted as UTF-8 bytes of
#: the formatted text, template and escapes included: no byte-level vocabulary makes more, and English has about a quarter.
BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 4096, 2, 512
#: Turns that are cut into windows together, apart from the next ones of their conversation.
CHUNK_TURNS = 256
#: Rows that one task orders at a time.
PART_ROWS = 1 << 19
TURN_END = "</turn>\n"


def escaped(text: Column) -> Column:
    """Text without # and <, of which every control string has one; \\b, \\h and \\l stand for backslash, # and <."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    """The inverse of escaped(): every backslash begins one code, and the backslash's own is put back last."""
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\b"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    """A role without colons either, as one ends it; \\c stands for a colon."""
    return F.replace(escaped(role), F.lit(":"), F.lit("\\c"))


def _part(turns: DataFrame) -> DataFrame:
    """`turns` with `conv`, `part` (each CHUNK_TURNS turns of a conversation, in order) and `turn`, a struct.

    Turns are ordered by number (null first), role and hash of the text, so texts themselves are never sorted by; equal
    rows are in any order. A turn's place is counted in cells of turn numbers, and equal numbers are in as many parts of the
    order as they need, so that a conversation of any size, or a turn number that repeats, is many tasks.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    opening = F.concat(F.lit("### "), escaped_role(role), F.lit(": "))
    body = escaped(text)
    said = F.concat(opening, body, F.lit(TURN_END))
    t = turns.select(
        "conv_id", F.struct(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("id"), F.col("conv_id").isNull().alias("none")).alias("conv"),
        F.struct(
            F.col("turn").cast("long").alias("turn"), role.alias("role"), F.unhex(F.md5(text)).alias("hash"), said.alias("said"), F.octet_length(said).alias("tokens"),
            F.length(opening).alias("open"), F.length(body).alias("body"),
        ).alias("turn"), F.monotonically_increasing_id().alias("tie"),
    )
    order = ["turn.turn", "turn.role", "turn.hash", "tie"]
    t = in_parts(t, ["conv", *order], PART_ROWS)
    t = t.withColumn("cell", F.struct("_part", F.coalesce(F.floor(F.col("turn.turn") / CHUNK_TURNS), F.lit(-(1 << 62))).alias("numbers")))
    earlier = Window.partitionBy("conv").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # one row a cell
    base = t.groupBy("conv", "cell").agg(F.count(F.lit(1)).alias("n")).select("conv", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    place = F.col("base") + F.row_number().over(Window.partitionBy("conv", "cell").orderBy(*order)) - 1
    return t.join(base, ["conv", "cell"]).select("conv_id", "conv", F.floor(place / CHUNK_TURNS).alias("part"), "turn")


_TURNS = "array<struct<turn:bigint,role:string,hash:binary,said:string,tokens:int,open:int,body:int>>"


def format_conversations(turns: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """One row per window: conv_id, window (the rank of its first own turn), formatted, loss (array of start and end code points), n_fresh.

    turns: conv_id, turn, role, text; other columns are left out, whatever their names. A null turn comes first, a null
    text or role is empty, rows without a conversation are one of their own; equal turn numbers go by role and hash of
    the text, equal rows are turns of their own. Whole texts of any length are formatted. An empty table gives an empty
    table.

    Spans of turns are chosen by running sums of their tokens: a window takes turns until the next one would not fit
    beside the conversation's first system turn (added unless an own turn is a system turn) and the history, which is the
    longest run of at most `history_turns` turns before it, none of them a system turn, that has at most `history_tokens`
    tokens and leaves room for the window's first turn. A window has more than `budget` tokens only if its first turn and
    the system turn together have. Only own assistant turns are under the loss: what is repeated is masked. A text in the
    output has no control string: see escaped().

    A conversation is cut in chunks of CHUNK_TURNS turns, each one row, and each cut into windows by itself. History reaches
    into the chunk before.
    """
    g = _part(turns).groupBy("conv", "part").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list("turn")).alias("turns"))
    by_conv = Window.partitionBy("conv").orderBy("part")
    places = g.select("conv", "part", F.size("turns").alias("n")).select(
        "conv", "part", F.coalesce(F.sum("n").over(by_conv.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.lag("part").over(by_conv).alias("last")
    )
    tails = g.select("conv", F.col("part").alias("last"), F.slice("turns", F.greatest(F.lit(1), F.size("turns") - (max(1, history_turns) - 1)), F.lit(history_turns)).alias("tail"))
    first_system = g.select("conv", "part", F.get(F.filter("turns", lambda x: x["role"] == "system"), F.lit(0)).alias("s")).filter("s is not null").groupBy("conv").agg(F.min_by("s", "part").alias("system"))
    around = places.join(tails, ["conv", "last"], "left").join(first_system, "conv", "left").select("conv", "part", "base", "system", F.coalesce("tail", F.array().cast(_TURNS)).alias("tail"))
    x = g.join(around, ["conv", "part"]).withColumn("all", F.concat("tail", "turns"))

    def beside(t: Column) -> Column:
        """Tokens of the system turn in a window that begins with turn t."""
        return F.when(t["role"] == "system", 0).otherwise(F.coalesce(F.col("system.tokens"), F.lit(0)))

    def history(t: Column, i: Column) -> Column:
        room = F.least(F.lit(history_tokens), F.lit(budget) - beside(t) - t["tokens"])
        none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("tokens"), F.lit(True).alias("more"))
        if not history_turns:
            return none

        def take(a: Column, back: Column) -> Column:
            y = F.get(F.col("all"), F.size("tail") + i - back)
            ok = a["more"] & F.coalesce((y["role"] != "system") & (a["tokens"] + y["tokens"] <= room), F.lit(False))
            return F.struct(F.when(ok, a["n"] + 1).otherwise(a["n"]).alias("n"), F.when(ok, a["tokens"] + y["tokens"]).otherwise(a["tokens"]).alias("tokens"), ok.alias("more"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(history_turns)), none, take)

    x = x.withColumn("past", F.transform("turns", history))

    def cut(a: Column, i: Column) -> Column:
        t = F.get(F.col("turns"), i)
        fits = (F.size(a["starts"]) > 0) & (a["left"] >= t["tokens"])
        opened = F.lit(budget) - beside(t) - F.get(F.col("past"), i)["tokens"] - t["tokens"]
        return F.struct(F.when(fits, a["starts"]).otherwise(F.concat(a["starts"], F.array(i))).alias("starts"), F.when(fits, a["left"] - t["tokens"]).otherwise(opened).cast("int").alias("left"))

    nothing = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("left"))
    x = x.withColumn("starts", F.aggregate(F.sequence(F.lit(0), F.size("turns") - 1), nothing, cut, lambda a: a["starts"]))

    def window(s: Column, k: Column) -> Column:
        end = F.coalesce(F.get(F.col("starts"), k + 1), F.size("turns"))
        h = F.get(F.col("past"), s)["n"]
        return F.struct(s.alias("start"), F.slice("turns", s + 1, end - s).alias("own"), F.slice("all", F.size("tail") + s - h + 1, h).alias("history"))

    w = x.select("conv_id", "base", "system", F.explode(F.transform("starts", window)).alias("w"))
    w = w.select("conv_id", (F.col("base") + F.col("w.start")).alias("window"), "system", F.col("w.own").alias("own"), F.col("w.history").alias("history"))
    head = F.when(F.col("system").isNotNull() & ~F.exists("own", lambda t: t["role"] == "system"), F.array("system")).otherwise(F.array().cast(_TURNS))
    w = w.select("conv_id", "window", "own", F.concat(head, "history").alias("repeated"))
    length = lambda ts: F.aggregate(ts, F.lit(0), lambda n, t: n + F.length(t["said"]))
    marks = F.aggregate(
        "own", F.struct(length("repeated").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["said"])).alias("at"),
            F.when(t["role"] == "assistant", F.concat(a["spans"], F.array(F.struct((a["at"] + t["open"]).alias("start"), (a["at"] + t["open"] + t["body"]).alias("end"))))).otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"],
    )
    return w.select("conv_id", "window", F.array_join(F.transform(F.concat("repeated", "own"), lambda t: t["said"]), "").alias("formatted"), marks.alias("loss"), F.size("own").cast("long").alias("n_fresh"))


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from formatted windows alone: conv_id, turns (role, text), targets (texts under the loss), formatted_chars.

    A window's own turns are its last `n_fresh`; the system turn and history before them are repeats. Windows without a
    conversation are of one; texts are unescaped; an empty table gives an empty table. Windows are put together before
    they are read, so that texts are shuffled once.
    """
    g = windows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "formatted", "loss", "n_fresh"))).alias("ws"))

    def turns(w: Column) -> Column:
        parts = F.split(w["formatted"], TURN_END, -1)  # what follows the last end is empty
        own = F.slice(parts, F.size(parts) - w["n_fresh"].cast("int"), w["n_fresh"].cast("int"))
        return F.transform(own, lambda t: F.struct(unescaped(F.replace(F.regexp_extract(t, r"^### ([^:]*): ", 1), F.lit("\\c"), F.lit(":"))).alias("role"), unescaped(F.regexp_replace(t, r"^### [^:]*: ", "")).alias("text")))

    def targets(w: Column) -> Column:
        return F.transform(w["loss"], lambda s: unescaped(F.substring(w["formatted"], s["start"] + 1, s["end"] - s["start"])))

    return g.select(
        "conv_id", F.flatten(F.transform("ws", turns)).alias("turns"), F.flatten(F.transform("ws", targets)).alias("targets"),
        F.aggregate("ws", F.lit(0).cast("long"), lambda n, w: n + F.length(w["formatted"])).alias("formatted_chars"),
    )
