"""Conversations as training text by a grammar that is parsed back.

    conversation := turn*
    turn         := "<|im_start|>" role "\\n" text "<|im_end|>" "\\n"

A turn is rendered as it is and parsed again; what does not come back as it was
is escaped, and only that, until the recovered turn equals its source.  The
escape puts one more backslash into a control string (``<|im_end|>`` becomes
``<\\|im_end|>``), and the parser always takes one away, so it needs no record
of what was escaped.  Roles may also hold line feeds, written as ``\\n``.

The formatted text of a conversation lies in one or more parts of about
``PART_CHARS`` characters, each with the spans of it that a loss is taken over.
Turns are range-partitioned by (conversation, turn), so a conversation of any
length is spread over tasks, and parts are written as they fill.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import staged

START, END = "<|im_start|>", "<|im_end|>"
#: Characters after which a part of a conversation is full; a turn is never cut.
PART_CHARS = 1 << 20

_CONTROL = re.compile(r"<\|im_(?:start|end)\|>")
_LIKE_CONTROL = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
_ESCAPED_CONTROL = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")


class Turn(NamedTuple):
    role: str
    text: str
    start: int  # of the text as it stands in the formatted form
    end: int


def escape(text: str) -> str:
    return _LIKE_CONTROL.sub(r"<\1\\|\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED_CONTROL.sub(r"<\1|\2|>", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", role))


def parse(formatted: str) -> Iterator[Turn]:
    """The turns of a formatted text; ``ValueError`` where it leaves the grammar."""
    at = 0
    while at < len(formatted):
        line = formatted.find("\n", at)
        if not formatted.startswith(START, at) or line < 0:
            raise ValueError(f"no turn at {at}")
        role = formatted[at + len(START) : line]
        end = _CONTROL.search(formatted, line + 1)
        if _CONTROL.search(role) or not end or end[0] != END or not formatted.startswith("\n", end.end()):
            raise ValueError(f"turn at {at} does not end")
        yield Turn(unescape_role(role), unescape(formatted[line + 1 : end.start()]), line + 1, end.start())
        at = end.end() + 1


def _recovered(formatted: str) -> list[tuple[str, str]] | None:
    try:
        return [(t.role, t.text) for t in parse(formatted)]
    except ValueError:
        return None


def render(role: str, text: str) -> str:
    """One turn, with as little escaped as gives back the same role and text."""
    for shown_role in (role, escape_role(role)):
        for shown in (text, escape(text)):
            formatted = f"{START}{shown_role}\n{shown}{END}\n"
            if _recovered(formatted) == [(role, text)]:
                return formatted
    raise ValueError("turn cannot be formatted")


_PARTS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("part", pa.int64()),
        ("edge", pa.bool_()),
        ("n_turns", pa.int64()),
        ("formatted", pa.string()),
        ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)
_PARTS_SQL = "conv_id bigint, part bigint, edge boolean, n_turns bigint, formatted string, loss array<struct<start: bigint, end: bigint>>"


def _batch(rows: Sequence[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _grouped(rows: Iterator[tuple], trained: Sequence[str], part_chars: int, first_part: int) -> Iterator[tuple]:
    """Parts of sorted (conv, role, text) rows; the first and last conversation of a task may go on elsewhere."""
    part, conv, turns, size = first_part, None, [], 0
    first, split = True, False

    def full(edge: bool) -> tuple:
        formatted = "".join(render(role, text) for role, text in turns)
        found = list(parse(formatted))
        if [(t.role, t.text) for t in found] != turns:
            raise ValueError(f"conversation {conv} does not come back from its formatted form")
        return conv, part, edge, len(turns), formatted, [{"start": t.start, "end": t.end} for t in found if t.role in trained]

    started = False
    for row_conv, role, text in rows:
        if started and row_conv != conv:
            if turns:
                yield full(first or split)
                part, turns, size = part + 1, [], 0
            first = split = False
        started, conv = True, row_conv
        turns.append((role, text))
        size += len(text)
        if size >= part_chars:
            yield full(True)
            part, turns, size, split = part + 1, [], 0, True
    if turns:
        yield full(True)


def format_chats(
    turns: DataFrame,
    trained: Sequence[str] = ("assistant",),
    part_chars: int = PART_CHARS,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Written parts: conv_id, part, edge, n_turns, formatted and loss spans (code points of ``formatted``).

    Parts of a conversation are in order of ``part``; ``edge`` marks those that
    may have others.  Rows are ordered by turn (null first), then role, then
    the MD5 of the text; repeated rows are turns of their own.  Null role and
    text are empty; rows with a null id are one conversation.  An empty table
    gives no parts; other columns are not read.
    """
    rows = turns.select(
        F.col(conv_col).cast("bigint").alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("key", F.md5("text"))
    order = ("conv", "turn", "role", "key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        sorted_rows = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(3))))
        held, size = [], 0
        for part in _grouped(sorted_rows, trained, part_chars, task << 32):
            held.append(part)
            size += len(part[4])
            if size >= 1 << 22 or len(held) >= 1 << 12:
                yield _batch(held, _PARTS)
                held, size = [], 0
        if held:
            yield _batch(held, _PARTS)

    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "role", "text")
    return staged(ordered.mapInArrow(run, _PARTS_SQL), "chats")


_READ = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)
_READ_SQL = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation of parts in order; a conversation's text passes through piece by piece."""
    rows, open_id, state = [], None, None
    for batch in batches:
        for conv, formatted, loss in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            if state is None or conv != open_id:
                if state is not None:
                    rows.append((open_id, state[0], state[3].hexdigest(), state[1], state[4].hexdigest(), state[2]))
                open_id, state = conv, [0, 0, 0, hashlib.sha256(), hashlib.sha256()]
            shown = formatted.as_py()
            for turn in parse(shown):
                state[0] += 1
                state[3].update(f"{turn.role}\n{turn.text}\n".encode())
            for span in loss:
                text = unescape(shown[span["start"] : span["end"]])
                state[1] += len(text)
                state[4].update(text.encode())
            state[2] += len(shown)
        if len(rows) >= 1 << 12:
            yield _batch(rows, _READ)
            rows = []
    if state is not None:
        rows.append((open_id, state[0], state[3].hexdigest(), state[1], state[4].hexdigest(), state[2]))
        yield _batch(rows, _READ)


def read_back(parts: DataFrame) -> DataFrame:
    """One row per conversation of what its parts say when parsed: turns, text under the loss mask, length.

    A conversation in one part is read where it lies.  Those that may have more
    meet by id; a digest needs their text in order, which streams through one task.
    """
    columns = parts.select("conv_id", "formatted", "loss", "part", "edge")
    whole = columns.where("NOT edge").drop("part", "edge").mapInArrow(_digests, _READ_SQL)
    spread = columns.where("edge").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return whole.unionByName(spread.drop("part", "edge").mapInArrow(_digests, _READ_SQL))
