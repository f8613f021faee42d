import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from trackworks.llm import chat as C
from trackworks.llm import queries


def conversation(rng, i, n):
    texts = ["", "a", "\\### Assistant: </turn> ok", "\\l\\b\\h#<\\", "### User: x", "\n</turn>\n", "é漢\U0001f600" * 5, "word " * rng.choice([10, 60, 400])]
    return [(i, t, rng.choice(["system", "user", "assistant", "tool: x"]) if t else rng.choice(["system", "user"]), rng.choice(texts)) for t in range(n)]


def said(role, text):
    escaped = lambda x: x.replace("\\", "\\b").replace("#", "\\h").replace("<", "\\l")
    return f"### {escaped(role).replace(':', chr(92) + 'c')}: {escaped(text)}</turn>\n"


def ordered(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).digest())
    return [(r[1], r[2] or "", r[3] or "") for r in sorted(rows, key=key)]


def plain_windows(rows, budget, history_turns, history_tokens):
    """One conversation's windows, cut turn by turn: (repeated, own) lists of formatted turns."""
    turns = [(k // C.CHUNK_TURNS, role, said(role, text)) for k, (_, role, text) in enumerate(ordered(rows))]
    size = lambda t: len(t[2].encode())
    system = next((t for t in turns if t[1] == "system"), None)
    parts = sorted({t[0] for t in turns})
    out = []
    for i, t in enumerate(turns):
        if out and turns[i - 1][0] == t[0] and size(t) <= out[-1]["left"]:
            out[-1]["own"].append(t)
            out[-1]["left"] -= size(t)
            continue
        beside = size(system) if system and t[1] != "system" else 0
        room, history = min(history_tokens, budget - beside - size(t)), []
        for h in reversed(turns[max(0, i - history_turns) : i]):
            if h[1] == "system" or parts.index(t[0]) - parts.index(h[0]) > 1 or sum(map(size, history)) + size(h) > room:
                break
            history.insert(0, h)
        out.append({"own": [t], "history": history, "left": budget - beside - sum(map(size, history)) - size(t)})
    return [([*([system] if system and all(t[1] != "system" for t in w["own"]) else []), *w["history"]], w["own"]) for w in out]


def check(df, rows, budget, history_turns, history_tokens):
    windows = C.format_conversations(df, budget, history_turns, history_tokens)
    got = {}
    for w in windows.orderBy("conv_id", "window").collect():
        got.setdefault(w["conv_id"], []).append(w)
    assert got.keys() == {r[0] for r in rows}
    for conv, mine in got.items():
        want = plain_windows([r for r in rows if r[0] == conv], budget, history_turns, history_tokens)
        assert [w["formatted"] for w in mine] == ["".join(t[2] for t in [*a, *b]) for a, b in want]
        assert [w["n_fresh"] for w in mine] == [len(b) for _, b in want]
        for w, (repeated, own) in zip(mine, want, strict=True):
            least = [t for t in repeated if t[1] == "system"] + own[:1]
            assert len(w["formatted"].encode()) <= max(budget, sum(len(t[2].encode()) for t in least))
    return windows


def test_round_trip_in_order_and_each_target_once(spark):
    rng = random.Random(6)
    rows = [r for i, n in enumerate([1, 2, 5, 30, 200, 700]) for r in conversation(rng, i, n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    for budget, history in ((4096, 2), (1600, 3), (900, 0)):
        windows = check(df, rows, budget, history, 256)
        back = {r["conv_id"]: r for r in C.read_back(windows).collect()}
        for i in {r[0] for r in rows}:
            own = [(r[2], r[3]) for r in rows if r[0] == i]
            assert [(t["role"], t["text"]) for t in back[i]["turns"]] == own
            assert back[i]["targets"] == [t for role, t in own if role == "assistant"]
    assert windows.filter("conv_id = 4").count() > 5


def test_windows_keep_within_the_budget_whatever_the_lengths(spark):
    """Random lengths up to longer than a window: a window is over its budget only where its first turn and the system turn are."""
    rng = random.Random(13)
    rows = []
    for i in range(30):
        most = rng.choice([10, 100, 400, 900, 1500])
        rows += [(i, t, "system" if t == 0 and i % 2 else ("user", "assistant")[t % 2], rng.choice("aé漢<") * rng.randint(0, most)) for t in range(rng.choice([1, 7, 40, 300]))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    check(df, rows, 1024, 2, 300)


def test_windows_are_full(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, t, ("user", "assistant")[t % 2], f"turn {t} " + "x" * 80) for t in range(1, 200)]
    w = C.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 1600, 2, 300).orderBy("window").collect()
    assert len(w) > 5
    for k, r in enumerate(w):
        assert r["formatted"].startswith("### system: be kind</turn>\n") and (k == len(w) - 1 or 1450 < len(r["formatted"]) <= 1600)
        turns = r["formatted"].split("</turn>\n")[:-1]
        assert len(turns) == r["n_fresh"] + (k > 0) * 3
        targets = [r["formatted"][s["start"] : s["end"]] for s in r["loss"]]
        assert targets == [t.split(": ", 1)[1] for t in turns[-r["n_fresh"] :] if t.startswith("### assistant")]


def test_many_turns_of_one_number_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(C, "PART_ROWS", 50)
    rng = random.Random(3)
    rows = [(None, rng.choice([None, 3, 4]), rng.choice(["user", "assistant"]), f"t{rng.randint(0, 10**6)} " + "y" * rng.randint(0, 50)) for _ in range(400)]
    rows += [(7, -5, "user", "before"), (7, None, "user", "first"), (7, 1, "assistant", "word " * 60_000), (7, 2, "user", "after")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    back = {r["conv_id"]: r for r in C.read_back(C.format_conversations(df)).collect()}
    for conv in (None, 7):
        want = [(role, text) for _, role, text in ordered([r for r in rows if r[0] == conv])]
        assert [(t["role"], t["text"]) for t in back[conv]["turns"]] == want


def test_nulls_ties_repeats_and_extra_columns(spark):
    rows = [(1, 2, "user", "b", 0), (1, None, None, None, 0), (1, 2, "assistant", "a", 0), (1, 2, "user", "b", 0), (None, 1, "assistant", "z", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tokens int").withColumns({"conv": F.lit(1), "part": F.lit(2), "window": F.lit(3), "system": F.lit(4)})
    back = {r["conv_id"]: r for r in C.read_back(C.format_conversations(df)).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [("", ""), ("assistant", "a"), ("user", "b"), ("user", "b")]
    assert back[None]["targets"] == ["z"]
    assert C.read_back(C.format_conversations(df.limit(0))).count() == 0


def test_escapes_are_reversible(spark):
    rng = random.Random(2)
    texts = [("".join(rng.choice("\\lhbc#<>/ :") for _ in range(rng.randint(0, 12))),) for _ in range(500)]
    df = spark.createDataFrame(texts, "t string").select("t", C.escaped(F.col("t")).alias("e"))
    assert all(r["t"] == r["b"] and not set("#<") & set(r["e"]) for r in df.select("t", "e", C.unescaped(F.col("e")).alias("b")).collect())


@pytest.mark.parametrize("part_rows", [C.PART_ROWS, 900])
def test_op10_is_its_sql_where_thousands_of_turns_have_one_number(spark, tmp_path, monkeypatch, part_rows):
    monkeypatch.setattr(C, "PART_ROWS", part_rows)
    rng = random.Random(5)
    rows = [(1, 3 if i % 9 else i, rng.choice(["user", "assistant", "system" if i % 700 == 0 else "user"]), "w " * rng.randint(0, 60) + str(i)) for i in range(6000)]
    rows += [(2, i, "assistant", "same") for i in [7] * 4500] + [(3, i, rng.choice(["user", "assistant"]), f"turn {i} # <") for i in range(5000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r[c] for c in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")) for r in queries.op10_chat_format(spark, str(tmp_path)).collect())
    duck = duckdb.connect()
    duck.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(duck.sql(queries.OP10_SQL).fetchall()) and len(got) == 4
