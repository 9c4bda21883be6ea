"""Chat formatting: a finite-state machine over roles, and a declarative template.

Turns are sorted by conversation inside Spark's partitions and streamed, so a conversation of any
length takes the memory of one turn.  The result is a table of text segments with a loss flag each;
the segments of a conversation, joined in order, are its formatted text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = "conv_id long, turn_no long, segment_no int, text string, loss boolean, valid boolean"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, first_invalid_turn long"


@dataclass(frozen=True)
class Template:
    """before and after stand around each turn's text; {role} is the turn's role.  follows: the roles that may come next, by role; None is the start."""

    before: str = "<|im_start|>{role}\n"
    after: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: dict = field(default_factory=lambda: {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})


#: Control strings begin so; any run of backslashes between gets one more, which makes the change reversible.
_OPEN, _SHUT = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def segments(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Three segments a turn: the mark before it, its escaped text, the mark after it; only texts of loss roles carry loss.

    turns: conv_id, turn, role, text; other columns are ignored.  Null texts and roles are empty, null turns
    come first, rows of one turn number are in the order of role and text, rows without conv_id make one
    conversation.  valid: the machine allows this role after the one before.  Turns out of order are
    formatted all the same.  An empty table gives no rows.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: tuple = (object(), None, 0)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                role, text = role or "", text or ""
                last, no = (state[1], state[2]) if conv == state[0] else (None, 0)
                valid = role in template.follows.get(last, ())
                parts = (template.before.replace("{role}", escape_role(role)), False), (escape(text), role in template.loss_roles), (template.after, False)
                for k, (part, loss) in enumerate(parts):
                    for column, value in zip(out, (conv, no, k, part, loss, valid), strict=True):
                        column.append(value)
                state = (conv, role, no + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], names=[f.split()[0] for f in SEGMENTS.split(", ")])

    plain = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(emit, SEGMENTS)


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation of segments(), read back from the formatted text: roles and texts are parsed from it and unescaped.

    formatted must keep the order and partitions of segments().
    """
    head, tail = template.before.split("{role}")

    def parsed(turn: str) -> tuple[str, str]:
        role, body = turn[len(head) :].split(tail, 1)
        if not turn.startswith(head) or not turn.endswith(template.after):
            raise ValueError("not a formatted turn")
        return unescape_role(role), unescape(body[: len(body) - len(template.after)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64())
        now, turn, out = None, "", [[] for _ in kinds]

        def close() -> None:
            conv, turns, both, chars, loss, formatted, wrong = now
            for column, value in zip(out, (conv, turns, both.hexdigest(), chars, loss.hexdigest(), formatted, wrong is None, wrong), strict=True):
                column.append(value)

        for batch in batches:
            for conv, no, k, text, loss, valid in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now[0]:
                    if now is not None:
                        close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, None]
                now[5] += len(text)
                turn = turn + text if k else text
                if loss:
                    plain = unescape(text)
                    now[3] += len(plain)
                    now[4].update(plain.encode())
                if k == 2:
                    role, body = parsed(turn)
                    now[1] += 1
                    now[2].update(f"{role}\n{body}\n".encode())
                    if not valid and now[6] is None:
                        now[6] = no
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=[f.split()[0] for f in DIGESTS.split(", ")])
            out = [[] for _ in kinds]
        if now is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=[f.split()[0] for f in DIGESTS.split(", ")])

    return formatted.mapInArrow(read, DIGESTS)
