import hashlib
import random

import pytest
from pyspark.sql import functions as F

from deltaloom.llm import chat
from deltaloom.llm.tokens import encoder, vocabulary

HARD = ["", "\\", "###", "####### x", "</turn>", "<\\/turn>", "### a: b</turn>\n### c: d</turn>\n", "\\### Assistant: </turn> ok", "a\\", ":", "é😀\n"]


def conversations(seed=1):
    rng = random.Random(seed)
    rows = []
    for c in range(40):
        turns = [("system", rng.choice(HARD))] if c % 3 == 0 else []
        for k in range(rng.choice([0, 1, 2, 5, 30])):
            turns.append((["user", "assistant", "x:###y"][rng.choice([0, 1, 1, 2])], rng.choice(HARD) + " word" * rng.choice([0, 3, 300, 3000])))
        rows += [(c, k, r, t) for k, (r, t) in enumerate(turns)]
    rows += [(50, 1, "user", None), (50, 1, "assistant", "b"), (50, 1, "assistant", "b"), (50, 0, None, "q"), (None, 0, "assistant", "n")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def count(turn):
    return len(encoder(vocabulary()).encode(chat.format_turn(*turn)[0])) // 4


def brute_windows(turns, budget, history):
    """(turns, how many are repeated) of each window, turn by turn: as many new turns as fit, behind as many of the last window's as the history takes."""
    windows, own, repeated, total = [], [], 0, 0
    system = turns[0] if turns and turns[0][0] == "system" else None
    for i, t in enumerate(turns):
        if len(own) > repeated and total + count(t) > budget:
            windows.append((own, repeated))
            before = own[1:] if system else list(own)
            room, kept = min(history, budget - count(t) - (count(system) if system else 0)), []
            while before and count(before[-1]) + sum(map(count, kept)) <= room:
                kept.insert(0, before.pop())
            own = [system] * bool(system) + kept
            repeated, total = len(own), sum(map(count, own))
        own = [*own, t]
        total += count(t)
    return [*windows, (own, repeated)] if len(own) > repeated else windows


@pytest.mark.parametrize("text", HARD)
def test_escapes(text):
    formatted, a, b = chat.format_turn("r:\\" + text, text)
    assert chat.read_turns(formatted * 2) == [("r:\\" + text, text)] * 2
    assert chat.unescape(formatted[a:b]) == text and "</turn>" not in formatted[a:b] and "###" not in formatted[a:b]


@pytest.mark.parametrize("some", [True, False])
def test_op10(spark, tmp_path, some):
    rows = conversations() if some else []
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.op10_chat(spark, str(tmp_path)).collect()}
    turns = {}
    hard = "\\### Assistant: </turn> ok"
    for c, k, r, t in [*rows, (-7, 0, "user", hard), (-7, 1, "assistant", hard)]:
        turns.setdefault(c, []).append((k, r or "", t or ""))
    assert got.keys() == turns.keys()
    for c, own in turns.items():
        own.sort()
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        targets = "".join(t for _, r, t in own if r == "assistant")
        assert got[c]["loss_chars"] == len(targets) and got[c]["loss_sha256"] == hashlib.sha256(targets.encode()).hexdigest()
        windows = brute_windows([(r, t) for _, r, t in own], chat.BUDGET, chat.HISTORY)
        assert got[c]["n_windows"] == len(windows)
        assert got[c]["formatted_chars"] == sum(len(chat.format_turn(*t)[0]) for w, _ in windows for t in w)


def test_windows(spark):
    rows = frame(spark, conversations())
    windows = chat.format_windows(rows, vocabulary(), 400, 100).collect()
    assert any(w["repeated"] > 1 for w in windows) and any(w["window"] > 2 for w in windows)
    for w in windows:
        turns = chat.read_turns(w["text"])
        assert len(turns) == w["turns"] and w["n_tokens"] == sum(map(count, turns))
        new = w["turns"] - w["repeated"]
        assert w["n_tokens"] <= 400 or new == 1
        history = turns[: w["repeated"]]
        assert sum(count(t) for t in history if t[0] != "system") <= 100
        assert len(w["loss"]) == sum(r == "assistant" for r, _ in turns[w["repeated"] :])


@pytest.mark.parametrize(("budget", "history"), [(400, 100), (2048, 512), (300, 300), (60, 0)])
def test_windows_equal_brute_force(spark, budget, history):
    rows = conversations(3)
    turns = {}
    for c, k, r, t in rows:
        turns.setdefault(c, []).append((k, r or "", t or ""))
    got = {}
    for w in chat.format_windows(frame(spark, rows), vocabulary(), budget, history).orderBy("window").collect():
        got.setdefault(w["conv_id"], []).append((chat.read_turns(w["text"]), w["repeated"]))
    assert got == {c: brute_windows([(r, t) for _, r, t in sorted(own)], budget, history) for c, own in turns.items()}


def test_one_long_conversation(spark):
    """A system turn, thousands of turns and a text of some MB: each new turn once and in order, whatever the tasks."""
    rows = [(1, 0, "system", "be brief")] + [(1, i, ("user", "assistant")[i % 2], f"turn {i} " + "w " * (i % 40)) for i in range(1, 4000)] + [(1, 4000, "assistant", "long text " * 300_000)]
    df = frame(spark, rows).withColumn("window", F.lit("x")).withColumn("row", F.lit("x")).withColumn("n_tokens", F.lit(None))
    windows = chat.format_windows(df, vocabulary()).orderBy("window").collect()
    assert [w["window"] for w in windows] == list(range(len(windows))) and len(windows) > 30
    read = [(t, k) for w in windows for k, t in enumerate(chat.read_turns(w["text"])) if k >= w["repeated"]]
    assert [t for t, _ in read] == [(r, t) for _, _, r, t in rows]
    assert all(w["text"].startswith("### system: be brief") for w in windows) and all(w["n_tokens"] <= 2048 for w in windows[:-1])


def test_nulls_and_clashing_columns(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", "a"), (1, None, "user", "q"), (1, None, "assistant", "b"), (1, 2, "assistant", "word " * 400_000)]
    plain, more = frame(spark, rows), frame(spark, rows)
    for c in ("row", "window", "place", "repeated", "n_tokens", "loss", "tie", "turns"):
        more = more.withColumn(c, F.lit("x"))
    got = [sorted(map(tuple, chat.read_back(chat.format_windows(df, vocabulary())).collect()), key=str) for df in (plain, more)]
    assert got[0] == got[1]
    assert {(r[0], r[1], r[3]) for r in got[0]} == {(None, 2, 1), (1, 3, 1 + 2_000_000)}
