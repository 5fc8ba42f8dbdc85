"""Chat formatting into budgeted, turn-aligned windows.

A turn is "### role: text</turn>" and a line end. Prefix sums of turn tokens choose spans of
whole turns: a window holds the conversation's system turn, as much of the turns before
as a history budget allows, and new turns up to the window's budget. Loss spans are the
texts of new assistant turns; repeated turns (the system turn and history) are masked, so
each assistant text is a target once. Control strings inside texts and roles are escaped
by a backslash, reversibly, so windows can be read back.

Tokens are counted where the turns lie, before any shuffle. Only numbers, sums and order of a
conversation's turns pass through one task, which holds those of one window, whatever the conversation's
length; the texts go from where they lie to the task of their window, so a conversation that holds a
third of all rows is formatted by many tasks. (To read a conversation back as one digest, its windows
pass through one task in order, streamed.)

Results for edge cases: a null text or role is empty, a text may be of any length; equal turn numbers are ordered by role
and text, null numbers first; repeated rows are turns of their own; a turn above the budget
is a window alone (with the system turn); a null conv_id is a conversation; later system
turns are ordinary turns; no turns make no windows; other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import pick, table, tune, written
from .tokens import encoder, vocabulary

BUDGET = 2048
HISTORY = 512
_START, _END = "### ", "</turn>"
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*?)</turn>\n", re.S)
_CONTROL = re.compile(r"\\|#{3,}|</turn>")
_BACK = re.compile(r"\\(.)", re.S)

WINDOW = "conv_id long, window int, text string, loss array<struct<start:long,end:long>>, turns int, repeated int, n_tokens long"


def _escaped(m: re.Match) -> str:
    return m[0].replace("</", "<\\/") if m[0][0] == "<" else "".join("\\" + c for c in m[0])


def escape(text: str) -> str:
    """The text without a control string: a backslash stands before a character that is meant as it is."""
    return _CONTROL.sub(_escaped, text)


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:")


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text starts and ends there."""
    head = f"{_START}{escape_role(role)}: "
    body = escape(text)
    return f"{head}{body}{_END}\n", len(head), len(head) + len(body)


def read_turns(window: str) -> list[tuple[str, str]]:
    """(role, text) of a formatted window's turns."""
    turns, at = [], 0
    while at < len(window):
        m = _TURN.match(window, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


class Spans:
    """Whole turns of one conversation for each window, by prefix sums of their tokens.

    Rows of turns and the sums before them are held from the open window's first turn on.
    """

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.rows: list[int] = []
        self.sums = [0]
        self.start = self.window = 0  # the first turn that is new, among the rows held; the window's number
        self.system: tuple[int, int] | None = None  # the system turn's row and tokens
        self.again: tuple[int, int] | None = None  # the same, in windows after the first

    def add(self, row: int, tokens: int, is_system: bool) -> list[tuple[int, int, int, bool]]:
        """The window before, as (row, window, place, repeated), if this turn begins the next one."""
        out = []
        if not self.window and not self.rows and is_system:
            self.system = (row, tokens)
        n = len(self.rows)
        more = self.again[1] if self.again else 0
        if n > self.start and more + self.sums[n] + tokens - self.sums[0] > self.budget:
            out = self.close()
            self.window += 1
            room = min(self.history, self.budget - tokens - (self.system[1] if self.system else 0))
            first = 1 if self.system and not self.again else 0
            self.again = self.system
            head = min(n, max(first, bisect_left(self.sums, self.sums[n] - room))) if room > 0 else n
            self.rows, self.sums = self.rows[head:], self.sums[head:]
            self.start = n - head
        self.rows.append(row)
        self.sums.append(self.sums[-1] + tokens)
        return out

    def close(self) -> list[tuple[int, int, int, bool]]:
        if len(self.rows) == self.start:
            return []
        own = [(self.again[0], True)] if self.again else []
        own += [(r, i < self.start) for i, r in enumerate(self.rows)]
        return [(r, self.window, place, repeated) for place, (r, repeated) in enumerate(own)]


def by_conversation(rows: DataFrame, *order: str) -> DataFrame:
    """Each conversation in one task, in order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", *order)


def counted_turns(turns: DataFrame, path: str) -> DataFrame:
    """(row, conv_id, turn, role, text, n_tokens) of turns, nulls replaced; no shuffle."""
    turns = pick(turns, conv_id="conv_id", turn="turn", role="role", text="text")
    tune(turns.sparkSession)
    turns = turns.select(
        F.monotonically_increasing_id().alias("row"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for b in batches:
            sizes = [len(encode(format_turn(r, t)[0])) // 4 for r, t in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, pa.int64())], [*b.schema.names, "n_tokens"])

    return written(turns.mapInArrow(run, "row long, conv_id long, turn long, role string, text string, n_tokens long"), "turns")


def window_spans(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """(row, window, place, repeated) of ``counted_turns``: which turns are in which window.

    Turns are ordered by number and role; texts are looked at only where both are equal.
    """
    again = turns.groupBy("conv_id", "turn", "role").agg(F.count("*").alias("n")).where("n > 1")
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"a.{c}")) for c in ("conv_id", "turn", "role")]
    slim = turns.alias("t").join(again.alias("a"), same[0] & same[1] & same[2], "left")
    slim = slim.select("t.row", "t.conv_id", "t.turn", "t.role", F.when(F.col("n") > 1, F.col("t.text")).alias("tie"), "t.n_tokens", (F.col("t.role") == "system").alias("is_system"))
    rows = by_conversation(slim, "turn", "role", "tie").select("row", "conv_id", "n_tokens", "is_system")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, own = None, None
        for b in batches:
            out: list[tuple] = []
            for row, conv, tokens, is_system in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if spans is None or conv != own:
                    out += spans.close() if spans else []
                    spans, own = Spans(budget, history), conv
                out += spans.add(row, tokens, is_system)
            yield rows_of(out)
        if spans:
            yield rows_of(spans.close())

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.bool_()))], ["row", "window", "place", "repeated"])

    return rows.mapInArrow(run, "row long, window int, place int, repeated boolean")


def format_windows(turns: DataFrame, path: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """WINDOW rows of conversations (conv_id, turn, role, text)."""
    turns = counted_turns(turns, path)
    met = turns.join(window_spans(turns, budget, history), "row").select("conv_id", "window", "place", "repeated", "role", "text", "n_tokens")
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = met.repartition(parts, "conv_id", "window").sortWithinPartitions("conv_id", "window", "place")
    schema = pa.schema(
        [("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("turns", pa.int32()), ("repeated", pa.int32()), ("n_tokens", pa.int64())]
    )

    def made(conv: int | None, window: int, own: list[tuple]) -> dict:
        at, loss, parts = 0, [], []
        for repeated, role, text, _ in own:
            formatted, start, end = format_turn(role, text)
            if role == "assistant" and not repeated:
                loss.append({"start": at + start, "end": at + end})
            parts.append(formatted)
            at += len(formatted)
        return {"conv_id": conv, "window": window, "text": "".join(parts), "loss": loss, "turns": len(own), "repeated": sum(t[0] for t in own), "n_tokens": sum(t[3] for t in own)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, []
        for b in batches:
            out = []
            for conv, window, _, *turn in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (conv, window) != group:
                    if own:
                        out.append(made(*group, own))
                    group, own = (conv, window), []
                own.append(tuple(turn))
            yield pa.RecordBatch.from_pylist(out, schema)
        if own:
            yield pa.RecordBatch.from_pylist([made(*group, own)], schema)

    return rows.mapInArrow(run, WINDOW)


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows) from windows alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        state = None

        def ended() -> list:
            return [state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5], state[6]]

        for b in batches:
            out = []
            for conv, _, text, loss, repeated in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if state is None or state[0] != conv:
                    if state:
                        out.append(ended())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, own in read_turns(text)[repeated:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{own}\n".encode())
                for span in loss:
                    target = unescape(text[span["start"] : span["end"]])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(text)
                state[6] += 1
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(ended(), kinds, strict=True)], names)

    rows = windows.select("conv_id", "window", "text", "loss", "repeated")
    return by_conversation(rows, "window").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, formatted and read back."""
    hard = "\\### Assistant: </turn> ok"
    turns = pick(table(spark, sf_dir, "conversations"), conv_id="conv_id", turn="turn", role="role", text="text")
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return read_back(format_windows(turns.unionByName(more), vocabulary()))
