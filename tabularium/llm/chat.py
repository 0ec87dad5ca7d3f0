"""Conversations as training text with a loss mask: columnar byte assembly.

Template: a user turn is ``[INST] text [/INST]``, a system turn ``[SYS] text [/SYS]``, an
assistant turn `` text</s>``, any other role ``[ROLE] role[/ROLE] text[/TURN]``; a
conversation is its turns, end to end.  Loss falls on assistant texts, without what
marks them.  A control string inside a text or a role gets a backslash behind its first
character (one more, if it has some already), so what is written holds control strings
only where the template put them, and ``turns_of`` takes back exactly what was written.

Assembly: rows are dealt and sorted by (conversation, turn) ranges, so that a long
conversation is many tasks' work.  In a task, each slice of rows is five segments a row
(header, role, divider, text, end): numpy computes their lengths, adds them up to
offsets, and scatters headers and contents into one preallocated Arrow buffer, which is
the output column as it stands.

Output rows: ``conv_id, part, chunk, text, loss, n_turns``.  A conversation is one row,
or consecutive ones by (part, chunk) where it is longer than ``CHUNK_BYTES`` or where a
range of rows ends; a turn is never cut.  ``loss`` has code-point spans of ``text``.

Defined results: null texts and null roles are empty ones; rows of one conversation go by
turn (null first), then role (null first), then md5 of the text; equal rows are turns of
their own; a null conv_id is one conversation; a very long text is a chunk by itself; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, ship_package
from .textcore import slices, tidy

CHUNK_BYTES = 1 << 16

_CONTROL = r"(?:<\\*/?s>|\[\\*/?(?:INST|SYS|ROLE)\]|\[\\*/TURN\])"
_WRITTEN = re.compile(_CONTROL.encode())
_UNESCAPE = re.compile(r"(<)\\(\\*/?s>)|(\[)\\(\\*/?(?:INST|SYS|ROLE)\]|\\*/TURN\])")
_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|\[SYS\] (?P<system>.*?) \[/SYS\]| (?P<assistant>.*?)</s>|\[ROLE\] (?P<role>.*?)\[/ROLE\] (?P<other>.*?)\[/TURN\]", re.S)

#: header, divider and end of a turn; the last one is for roles without a name here
_KINDS = {"user": ("[INST] ", "", " [/INST]"), "system": ("[SYS] ", "", " [/SYS]"), "assistant": (" ", "", "</s>"), None: ("[ROLE] ", "[/ROLE] ", "[/TURN]")}
_MARKS = [[np.frombuffer(x.encode(), np.uint8) for x in marks] for marks in _KINDS.values()]
_LENGTHS = np.array([[len(x) for x in marks] for marks in _MARKS], np.int64)
_NAMES = list(_KINDS)
_ASSISTANT, _OTHER = _NAMES.index("assistant"), _NAMES.index(None)

SCHEMA = "conv_id long, part int, chunk long, text string, loss array<struct<start:int,end:int>>, n_turns long"


def _insertions(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the first bytes of control strings, their rows): a backslash goes behind each; what lies across two rows is none."""
    found = np.array([m.span() for m in _WRITTEN.finditer(data)], np.int64).reshape(-1, 2)
    row = np.searchsorted(offsets, found[:, 0], "right") - 1
    whole = found[:, 1] <= offsets[row + 1]
    return found[whole, 0], row[whole]


def _scattered(out: np.ndarray, starts: np.ndarray, data: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> None:
    """Copies row r's bytes of ``data`` to ``starts[r]`` on, with a backslash behind each byte of ``at``."""
    sizes = np.diff(offsets)
    place = np.arange(len(data)) + np.repeat(starts - offsets[:-1], sizes)
    if len(at):
        passed = np.zeros(len(data) + 1, np.int64)
        passed[at + 1] = 1
        np.cumsum(passed, out=passed)
        place += passed[:-1] - np.repeat(passed[offsets[:-1]], sizes)
        out[place[at] + 1] = ord("\\")
    out[place] = data


def assembled(kinds: np.ndarray, roles: tuple[np.ndarray, np.ndarray], texts: tuple[np.ndarray, np.ndarray]) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """The formatted rows in one buffer; (rows + 1) offsets of rows; (rows, 2) start and end of each row's text in the buffer.

    kinds: places in the template's list; roles, texts: bytes and row offsets.
    """
    n = len(kinds)
    at, row = _insertions(*texts)
    role_at, role_row = _insertions(*roles)
    lengths = np.empty((n, 5), np.int64)
    lengths[:, [0, 2, 4]] = _LENGTHS[kinds]
    lengths[:, 1] = np.diff(roles[1]) + np.bincount(role_row, minlength=n)
    lengths[:, 3] = np.diff(texts[1]) + np.bincount(row, minlength=n)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    starts = ends - lengths
    buffer = pa.allocate_buffer(int(ends[-1, -1]) if n else 0)
    out = np.frombuffer(buffer, np.uint8)
    for kind, marks in enumerate(_MARKS):
        rows = np.flatnonzero(kinds == kind)
        for segment, mark in zip((0, 2, 4), marks, strict=True):
            out[starts[rows, segment][:, None] + np.arange(len(mark))] = mark
    _scattered(out, starts[:, 1], *roles, role_at)
    _scattered(out, starts[:, 3], *texts, at)
    return buffer, np.append(0, ends[:, -1]), np.stack([starts[:, 3], ends[:, 3]], axis=1)


def _chunks(ids: list[int | None], offsets: np.ndarray) -> np.ndarray:
    """First rows of the chunks (and the number of rows): one where the conversation changes or ``CHUNK_BYTES`` are full."""
    firsts, began = [0], 0
    for i in range(1, len(ids)):
        if ids[i] != ids[i - 1] or offsets[i + 1] - offsets[began] > CHUNK_BYTES:
            firsts.append(began := i)
    return np.array([*firsts, len(ids)])


def _formatted(table: pa.Table, part: int, number: int) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, role, text) in order -> chunks."""
    names = table.column("role").fill_null("").combine_chunks()
    for a, b, data, offsets in slices(table.column("text")):
        own = names.slice(a, b - a).to_pylist()
        kinds = np.array([_NAMES.index(r) if r in _KINDS else _OTHER for r in own], np.int64)
        said = [b"" if k != _OTHER else r.encode() for r, k in zip(own, kinds.tolist(), strict=True)]
        roles = np.frombuffer(b"".join(said), np.uint8), np.append(0, np.cumsum([len(x) for x in said]))
        buffer, ends, spans = assembled(kinds, roles, (data, offsets))
        ids = table.column("conv_id").slice(a, b - a).to_pylist()
        first = _chunks(ids, ends)
        text = pa.Array.from_buffers(pa.string(), len(first) - 1, [None, pa.array(ends[first].astype(np.int32)).buffers()[1], buffer])
        # places of the mask: code points are the bytes that continue none
        points = np.zeros(ends[-1] + 1, np.int64)
        np.cumsum((np.frombuffer(buffer, np.uint8) & 0xC0) != 0x80, out=points[1:])
        marked = np.flatnonzero(kinds == _ASSISTANT)
        chunk = np.searchsorted(first, marked, "right") - 1
        inside = points[spans[marked]] - points[ends[first[chunk]]][:, None]
        loss = pa.StructArray.from_arrays([pa.array(inside[:, k].astype(np.int32)) for k in (0, 1)], ["start", "end"])
        counts = np.append(0, np.cumsum(np.bincount(chunk, minlength=len(first) - 1)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([ids[i] for i in first[:-1].tolist()], pa.int64()),
                pa.array(np.full(len(first) - 1, part, np.int32)),
                pa.array(number + np.arange(len(first) - 1)),
                text,
                pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), loss),
                pa.array(np.diff(first)),
            ],
            ["conv_id", "part", "chunk", "text", "loss", "n_turns"],
        )
        number += len(first) - 1


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number, waiting = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if waiting is None else pa.concat_tables([waiting, table])
        # a batch's last conversation waits for the next batch, up to a chunk's size
        ids = table.column("conv_id").to_pylist()
        keep = next((i + 1 for i in range(len(ids) - 2, -1, -1) if ids[i] != ids[-1]), 0)
        if table.slice(keep).nbytes > CHUNK_BYTES:
            keep = len(ids)
        for out in _formatted(table.slice(0, keep), part, number) if keep else ():
            number += out.num_rows
            yield out
        waiting = table.slice(keep) if keep < len(ids) else None
    if waiting is not None:
        yield from _formatted(waiting, part, number)


def formatted(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> conv_id, part, chunk, text, loss, n_turns."""
    ship_package(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    # equal rows may be many: the row's number lets ranges end between them
    order = ["conv_id", "turn", "role", "tie", "number"]
    rows = rows.withColumns({"tie": F.md5("text"), "number": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(ordered.select("conv_id", "role", "text").mapInArrow(tidy(_format), SCHEMA), "chat")


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(lambda m: (m[1] or m[3]) + (m[2] or m[4]), text) if "\\" in text else text


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    at = 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        if m["role"] is not None:
            yield unescaped(m["role"]), unescaped(m["other"])
        else:
            yield m.lastgroup, unescaped(m[m.lastgroup])
        at = m.end()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order -> one row for each conversation; nothing but running digests is held."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now, done = None, []
    row = lambda: (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])
    for batch in batches:
        for conv, text, loss in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            conv, text = conv.as_py(), text.as_py()
            if now is None or now[0] != conv:
                if now is not None:
                    done.append(row())
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in turns_of(text):
                now[1] += 1
                now[2].update(f"{role}\n{said}\n".encode())
            for span in loss.as_py():
                masked = unescaped(text[span["start"] : span["end"]])
                now[3] += len(masked)
                now[4].update(masked.encode())
            now[5] += len(text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
            done = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(), types, strict=True)], names)


def digests(chunks: DataFrame) -> DataFrame:
    """Read back from what ``formatted`` returns: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest of a whole conversation is computed in order, by definition; its chunks
    stream through a task, which keeps the running digest alone.
    """
    ordered = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    return ordered.select("conv_id", "text", "loss").mapInArrow(tidy(_digest), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
