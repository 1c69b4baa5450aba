"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one training example: all preceding turns as
context and that reply as the only trainable text.  Turns after the last reply
(or a conversation without any reply) make one more example that trains nothing,
so the output holds every turn.

A turn is written ``<|turn|>role<|text|>text<|end|>``.  Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|``, so no control string can appear
there and reading back is exact.

Rows of one conversation are sorted inside a hash partition and streamed: a task
holds the running context of one conversation (as long as its longest example),
never a group of rows.

Edge cases: null role or text is the empty string; rows that share conv_id and
turn, repeated rows included, all count, ordered by role and text; a null turn
comes first; rows with a null conv_id form one conversation of that id; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
REPLY_ROLE = "assistant"
_BLOCK = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)
_MARK = re.compile(r"\\(.)", re.S)
#: characters of finished examples sent on at once
FLUSH_CHARS = 4 << 20

EXAMPLES = "conv_id long, example int, formatted string, loss_start int, loss_end int"


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(s: str) -> str:
    return _MARK.sub(r"\1", s)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted example."""
    return [(unescape(r), unescape(t)) for r, t in _BLOCK.findall(formatted)]


def _rows(batches: Iterator[pa.RecordBatch], *names: str):
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names))


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    conv, context, example, open_turns = None, None, 0, False
    chars = 0

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out)) or [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32())
        names = ("conv_id", "example", "formatted", "loss_start", "loss_end")
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], list(names))
        out.clear()
        return made

    for cid, role, text in _rows(batches, "conv_id", "role", "text"):
        if context is None or cid != conv:
            if open_turns:
                out.append((conv, example, context, None, None))
            conv, context, example, open_turns = cid, "", 0, False
        head = f"{TURN}{escape(role or '')}{TEXT}"
        body = escape(text or "")
        start = len(context) + len(head)
        context += head + body + END
        open_turns = role != REPLY_ROLE
        if not open_turns:
            out.append((conv, example, context, start, start + len(body)))
            example += 1
            chars += len(context)
            if chars >= FLUSH_CHARS:
                yield flush()
                chars = 0
    if open_turns:
        out.append((conv, example, context, None, None))
    yield flush()


def examples(conversations: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (from 0), formatted, and the code
    point range [loss_start, loss_end) of ``formatted`` under the loss mask (null:
    nothing is trainable).  Examples of a conversation stay together, in order."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(_expand, EXAMPLES))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    conv, last, loss, loss_chars, chars = None, None, hashlib.sha256(), 0, 0

    def close():
        turns = parse(last)
        told = "".join(f"{r}\n{t}\n" for r, t in turns)
        out.append((conv, len(turns), hashlib.sha256(told.encode()).hexdigest(), loss_chars, loss.hexdigest(), chars))

    for cid, formatted, start, end in _rows(batches, "conv_id", "formatted", "loss_start", "loss_end"):
        if last is None or cid != conv:
            if last is not None:
                close()
            conv, loss, loss_chars, chars = cid, hashlib.sha256(), 0, 0
        last = formatted  # the longest: it holds the turns of all before it
        chars += len(formatted)
        if start is not None:
            reply = unescape(formatted[start:end])
            loss.update(reply.encode())
            loss_chars += len(reply)
    if last is not None:
        close()
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    cols = list(zip(*out)) or [[]] * 6
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], list(names))


def read_back(made: DataFrame, in_order: bool = False) -> DataFrame:
    """Digests per conversation, read from the formatted examples alone.
    ``in_order`` is for the direct result of :func:`examples`; examples read from
    a table are brought together first."""
    if not in_order:
        made = made.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return made.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
