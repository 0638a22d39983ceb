"""Chat formatting with a grammar round trip.

A turn is rendered as its role's opening mark, its text and its closing mark; a deterministic parser
reads rendered turns back. Each turn is rendered plainly first and reparsed; where the recovered turn
differs from the source, its text is escaped (a backslash before every backslash and before every
control string) and reparsed again, until identical. A rendered turn always parses on its own and ends
where its closing mark ends, so the concatenation of a conversation's turns parses to exactly its turns.

Conversations are dealt out by id and sorted by turn; a task streams through its rows and holds one
Arrow batch, so a conversation of any length needs no more memory (its hash is a sequential function of
its turns, so its turns do go to one task). Text under the loss mask is that of assistant turns.

Defined cases: null texts and roles are empty strings; turns with the same number are ordered by role
and then text; repeated rows are turns of their own; null conversation ids form one conversation; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: The template's control strings (fixed values); another role is named between the last three.
MARKS = {
    "system": ("<<SYS>>", "<</SYS>>"),
    "user": ("<s>[INST]", "[/INST]"),
    "assistant": ("<out>", "</s>"),
}
ROLE, BODY, END = "<|role|>", "<|body|>", "<|end|>"
CONTROL = sorted({m for pair in MARKS.values() for m in pair} | {ROLE, BODY, END, "[INST]", "<s>"}, key=lambda m: (-len(m), m))
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TOKEN = re.compile(r"\\(?s:.)|" + "|".join(map(re.escape, CONTROL)))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text.replace("\\", "\\\\"))


def _read_text(s: str, at: int, close: str) -> tuple[str, int] | None:
    """Unescaped text up to the closing mark, and the place after it; None if the grammar is broken."""
    parts = []
    for m in _TOKEN.finditer(s, at):
        parts.append(s[at : m.start()])
        at = m.end()
        if m[0] == close:
            return "".join(parts), at
        if m[0][0] != "\\":
            return None
        parts.append(m[0][1])
    return None


def parse(s: str) -> list[tuple[str, str]] | None:
    """Turns (role, text) of a rendered conversation, or None if it isn't one."""
    at, turns = 0, []
    while at < len(s):
        role = next((r for r, (opening, _) in MARKS.items() if s.startswith(opening, at)), None)
        if role is not None:
            at += len(MARKS[role][0])
            close = MARKS[role][1]
        elif s.startswith(ROLE, at):
            named = _read_text(s, at + len(ROLE), BODY)
            if named is None:
                return None
            role, at = named
            close = END
        else:
            return None
        body = _read_text(s, at, close)
        if body is None:
            return None
        turns.append((role, body[0]))
        at = body[1]
    return turns


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn and the span of its (possibly escaped) text in it."""
    for make in (lambda x: x, escape):
        if role in MARKS:
            opening, closing = MARKS[role]
        else:
            opening, closing = ROLE + make(role) + BODY, END
        body = make(text)
        out = opening + body + closing
        if parse(out) == [(role, text)]:
            return out, len(opening), len(opening) + len(body)
    raise ValueError("a turn has no faithful rendering")


def format_turns(conversations: DataFrame) -> DataFrame:
    """Per turn, in order within its conversation: conv_id, role, rendered, loss_start, loss_end.

    The loss span (in code points of rendered) is null for turns outside the loss mask.
    """
    small_batches(conversations.sparkSession, 2048)
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles, rendered, lo, hi = b.column(2).to_pylist(), [], [], []
            for role, text in zip(roles, b.column(3).to_pylist(), strict=True):
                out, start, end = render_turn(role, text)
                rendered.append(out)
                lo.append(start if role == "assistant" else None)
                hi.append(end if role == "assistant" else None)
            arrays = [b.column(0), b.column(2), pa.array(rendered, pa.string()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "role", "rendered", "loss_start", "loss_end"])

    return ordered.mapInArrow(run, "conv_id bigint, role string, rendered string, loss_start bigint, loss_end bigint")


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the rendered turns and loss spans alone (rows as format_turns orders them)."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def finished() -> tuple:
            conv_id, n, turns, chars, loss, size = state
            return conv_id, n, turns.hexdigest(), chars, loss.hexdigest(), size

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            rows = []
            columns = (b.column(k).to_pylist() for k in (0, 2, 3, 4))
            for conv_id, rendered, lo, hi in zip(*columns, strict=True):
                if state is None or state[0] != conv_id:
                    if state is not None:
                        rows.append(finished())
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(rendered):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if lo is not None:
                    # Exact for plain renderings too: with a backslash they would not have parsed to themselves.
                    masked = _ESCAPED.sub(r"\1", rendered[lo:hi])
                    state[3] += len(masked)
                    state[4].update(masked.encode("utf-8", "surrogatepass"))
                state[5] += len(rendered)
            if rows:
                yield batch(rows)
        if state is not None:
            yield batch([finished()])

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return formatted.mapInArrow(run, schema)
