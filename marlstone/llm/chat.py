"""Chat formatting with turn spans and a loss mask, found by rendering alone.

A template is a black box: a function from a list of (role, text) to a string.
Successive prefixes of a conversation are rendered; where the next output starts
with the one before, the new part is the new turn's span. Where it does not, the
template rewrites history, and the conversation is marked so. A turn's text
within its span is found by rendering the prefix once more with a private
character as that turn's text; if the output does not show it exactly once, by
two one-letter texts, whose outputs first differ where the text begins. A black
box must be asked for every prefix, so the cost grows with the square of a
conversation's turns.

The built-in template marks turns by control strings and escapes them inside
roles and texts by one backslash, which read_back() takes away again.

Null roles and texts are empty. Turns are ordered by turn, then role, then text,
nulls first, so that ties and repeated rows have one order. Rows of a null
conversation form one. An empty table gives no rows. A conversation is held in
memory whole, as its output is one string; the rows of others stream past.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: A character of no script, to see where a template puts a text.
PROBE = "\ue000"
Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]


def escape(text: str) -> str:
    """No '<|' is left: '<', backslashes and '|' in a row get one more backslash."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text) if "<" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<" in text else text


def _role_out(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def _role_in(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


@lru_cache(4096)
def _marked(turn: Turn) -> str:
    return f"{START}{_role_out(turn[0])}\n{escape(turn[1])}{END}\n"


def marked(turns: list[Turn]) -> str:
    """The built-in template."""
    return "".join(map(_marked, turns))


def read_back(formatted: str) -> list[Turn]:
    """The turns that marked() was given."""
    body = re.escape(START) + "([^\n]*)\n(.*?)" + re.escape(END) + "\n"
    return [(_role_in(m[1]), unescape(m[2])) for m in re.finditer(body, formatted, re.DOTALL)]


def _differ(a: str, b: str) -> int:
    """The first place where two strings differ."""
    low, high = 0, min(len(a), len(b))
    while low < high:  # of prefixes, equality is monotone
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def locate(turns: list[Turn], render: Template = marked) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """The output, each turn's (start, end, text_start, text_end) in it, and whether the template rewrites history.

    Spans of a template that rewrites history are those at the time of the turn's own prefix.
    """
    spans, before, rewrites = [], "", False
    for k, (role, text) in enumerate(turns):
        now = render(turns[: k + 1])
        start = len(before)
        if not now.startswith(before):
            rewrites = True
            start = _differ(now, before)
        x = render([*turns[:k], (role, PROBE)])
        at = x.find(PROBE, start)
        if at < 0 or x.find(PROBE, at + 1) >= 0 or not x.startswith(before):
            x, y = (render([*turns[:k], (role, letter)]) for letter in "xy")
            at = _differ(x, y)
        spans.append((start, len(now), at, max(at, len(now) - (len(x) - at - 1))))
        before = now
    return before, spans, rewrites


def format_conversations(rows: DataFrame, render: Template = marked, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, spans, rewrites_history."""
    plain = rows.select(F.col(key).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = plain.schema["conv_id"].dataType.simpleString()

    def run(batches):
        def conversations() -> Iterator[tuple[object, list[Turn]]]:
            nonlocal kept
            own, turns = None, []
            for batch in batches:
                kept = batch.column("conv_id").type
                for k, r, t in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                    if turns and k != own:
                        yield own, turns
                        turns = []
                    own = k
                    turns.append((r, t))
            if turns:
                yield own, turns

        span = pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64())])
        out, size, kept = [], 0, None

        def batch_of():
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kept), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(span)), pa.array(cols[3], pa.bool_())], names=["conv_id", "formatted", "spans", "rewrites_history"])

        for k, turns in conversations():
            formatted, spans, rewrites = locate(turns, render)
            out.append((k, formatted, [dict(zip(("role", "start", "end", "text_start", "text_end"), (r, *s), strict=True)) for (r, _), s in zip(turns, spans, strict=True)], rewrites))
            size += len(formatted)
            if size > 4_000_000:
                yield batch_of()
                out, size = [], 0
        if out:
            yield batch_of()

    dealt = plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(run, f"conv_id {kind}, formatted string, spans array<struct<role:string,start:bigint,end:bigint,text_start:bigint,text_end:bigint>>, rewrites_history boolean")


def digests(formatted: DataFrame, trained: str = "assistant") -> DataFrame:
    """What the outputs of the built-in template say when read back: turns, and the text under the loss mask."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for k, body, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "spans")), strict=True):
                turns = read_back(body)
                loss = "".join(unescape(body[s["text_start"] : s["text_end"]]) for s in spans if s["role"] == trained)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((k, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(body)))
            if out:
                kinds = (batch.column("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "spans").mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
