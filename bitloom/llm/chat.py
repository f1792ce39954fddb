"""Chat formatting by columnar byte assembly.

Template of a turn::

    ### role:\n
    text\n
    </turn>\n

Control strings inside a text (``### `` and ``</turn>``, after any number of backslashes) get one
backslash more; reading takes one away. A control string without a backslash before it is
therefore always the template's, and as the terminator starts with a newline no text can run into
it. Backslashes elsewhere stay as they are. In roles backslash and newline are escaped.

A batch of turns is assembled without a Python loop over its bytes: the lengths of all segments
(header, escaped text, terminator) give their offsets by a prefix sum; one scatter moves every text
byte to its place (its own index, plus what headers and escapes before it add) in one preallocated
buffer, which becomes the Arrow column of results; conversations are slices of it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bitloom.llm.common import arrow_map

HEAD, END = "### ", "\n</turn>\n"
CONTROLS = (b"### ", b"</turn>")
LOSS_ROLE = "assistant"
#: A conversation beyond so many bytes comes in several pieces, so that no task holds a whole one.
PIECE_BYTES = 4 << 20

_ESCAPED = re.compile(r"\\(\\*(?:### |</turn>))")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape(text: str) -> str:
    """One text, plainly: what ``assemble`` does for whole columns."""
    return re.sub(r"### |</turn>", lambda m: "\\" + m[0], text)


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and offsets (rows + 1); null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _controls_at(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted positions of control strings that lie within one row."""
    found = []
    for control in CONTROLS:
        n = len(control)
        if len(data) < n:
            continue
        at = np.flatnonzero(data[: len(data) - n + 1] == control[0])
        for k in range(1, n):
            at = at[data[at + k] == control[k]]
        row = np.searchsorted(offsets, at, "right")
        found.append(at[at + n <= offsets[row]])
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns in one buffer: its bytes, the turns' offsets (rows + 1), starts and ends of the texts in it."""
    rows = len(texts)
    text, at = _bytes_of(texts)
    coded = roles.cast(pa.string()).fill_null("").dictionary_encode()
    heads = [np.frombuffer(f"{HEAD}{escape_role(x)}:\n".encode(), np.uint8) for x in coded.dictionary.to_pylist()]
    kind = coded.indices.to_numpy(zero_copy_only=False)
    head_len = np.array([len(h) for h in heads], np.int64)[kind] if rows else np.zeros(0, np.int64)
    end = np.frombuffer(END.encode(), np.uint8)
    marks = _controls_at(text, at)
    extra = np.searchsorted(marks, at, "left")  # escapes before each row's start
    text_len = np.diff(at) + np.diff(extra)
    offsets = np.zeros(rows + 1, np.int64)
    np.cumsum(head_len + text_len + len(end), out=offsets[1:])
    starts = offsets[:-1] + head_len
    out = np.empty(offsets[-1], np.uint8)
    # a text byte goes to its own index + what its row starts later + the escapes up to it in its row
    shift = np.repeat(starts - at[:-1] - extra[:-1], np.diff(at))
    to = np.arange(len(text), dtype=np.int64) + shift
    if len(marks):
        steps = np.zeros(len(text) + 1, np.int64)
        np.add.at(steps, marks, 1)
        to += np.cumsum(steps)[:-1]
        out[to[marks] - 1] = ord("\\")
    out[to] = text
    for k, head in enumerate(heads):
        out[offsets[:-1][kind == k][:, None] + np.arange(len(head))] = head
    out[(offsets[1:] - len(end))[:, None] + np.arange(len(end))] = end
    return out, offsets, starts, starts + text_len


FORMATTED = "conv_id long, piece int, n_turns long, formatted string, loss_spans array<struct<start:int,end:int>>"


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by conversation and turn to one row per conversation, or per piece of a long one."""
    held: pa.Table | None = None
    piece, pieced = 0, None  # number of the next piece, and the conversation that it goes on

    def rows(part: pa.Table, ends: list[int], first: int) -> pa.RecordBatch:
        part = part.combine_chunks()
        roles, texts = part["role"].combine_chunks(), part["text"].combine_chunks()
        out, offsets, starts, stops = assemble(roles, texts)
        chars = np.zeros(len(out) + 1, np.int64)
        np.cumsum((out & 0xC0) != 0x80, out=chars[1:])
        bounds = np.array([0, *ends])
        pieces = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets[bounds].astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
        base = np.repeat(chars[offsets[bounds[:-1]]], np.diff(bounds))
        masked = np.flatnonzero(np.array([x == LOSS_ROLE for x in roles.to_pylist()], bool))
        spans = pa.StructArray.from_arrays(
            [pa.array((chars[x[masked]] - base[masked]).astype(np.int32)) for x in (starts, stops)], ["start", "end"]
        )
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(masked, bounds).astype(np.int32)), spans)
        number = np.zeros(len(ends), np.int32)
        number[:1] = first
        return pa.RecordBatch.from_arrays(
            [part["conv_id"].combine_chunks().take(pa.array(bounds[:-1])), pa.array(number), pa.array(np.diff(bounds).astype(np.int64)), pieces, lists],
            ["conv_id", "piece", "n_turns", "formatted", "loss_spans"],
        )

    for batch in batches:
        part = pa.Table.from_batches([batch])
        part = pa.concat_tables([held, part]) if held is not None else part
        ids = part["conv_id"].to_pylist()
        if piece and ids and ids[0] != pieced:
            piece = 0
        ends = [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]]
        if ends:
            yield rows(part.slice(0, ends[-1]), ends, piece)
            piece = 0
        held = part.slice(ends[-1] if ends else 0)
        if held.nbytes > PIECE_BYTES:
            yield rows(held, [len(held)], piece)
            piece, pieced, held = piece + 1, ids[-1], held.slice(len(held))
    if held is not None and len(held):
        yield rows(held, [len(held)], piece)


def format_chats(turns: DataFrame) -> DataFrame:
    """Formatted conversations of rows (conv_id, turn, role, text); further columns are left out.

    One row per conversation: conv_id, piece, n_turns, formatted, loss_spans (code points of the
    assistant texts in ``formatted``). Only a conversation beyond PIECE_BYTES has pieces 1, 2 ...,
    to be joined in order. Null text or role is empty, null conv_id is one conversation, a null
    turn comes first; equal turns are ordered by role and text, repeated rows are repeated turns.
    """
    sorted_turns = (
        turns.select("conv_id", "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )
    return arrow_map(sorted_turns, _format, FORMATTED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    turns = []
    for segment in formatted.split(END)[:-1]:
        head, _, text = segment.partition("\n")
        turns.append((unescape_role(head[len(HEAD) : -1]), unescape(text)))
    return turns


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state: list | None = None  # conv_id, turns, hash, loss chars, loss hash, chars

    def done(found: list[list]) -> pa.RecordBatch:
        cols = list(zip(*[[a, b, c.hexdigest(), d, e.hexdigest(), f] for a, b, c, d, e, f in found], strict=True))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    for batch in batches:
        found = []
        for conv, piece, text, spans in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "piece", "formatted", "loss_spans")), strict=True):
            if piece == 0:
                if state:
                    found.append(state)
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in parse(text):
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
            for span in spans:
                said = unescape(text[span["start"] : span["end"]])
                state[3] += len(said)
                state[4].update(said.encode())
            state[5] += len(text)
        if found:
            yield done(found)
    if state:
        yield done([state])


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, read from the output of ``format_chats``: turns, digests of all and of masked text."""
    return arrow_map(formatted, _read_back, DIGEST)


#: A conversation that speaks in the template's own control strings.
TRAP_ID, TRAP_TEXT = -7, "\\### Assistant: </turn> ok"


def query(conversations: DataFrame) -> DataFrame:
    """One row for each conversation, and for the trap: what is read back from its formatted text (see ``read_back``).

    Null roles and texts are empty, null turns come first, an empty table leaves the trap alone;
    columns besides the four are left out.
    """
    spark = conversations.sparkSession
    trap = spark.createDataFrame(
        [(TRAP_ID, 0, "user", TRAP_TEXT), (TRAP_ID, 1, "assistant", TRAP_TEXT)], "conv_id long, turn long, role string, text string"
    )
    return read_back(format_chats(conversations.select("conv_id", "turn", "role", "text").unionByName(trap)))


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(role) + 2 + length(text) + len(regexp_extract_all(text, '### |</turn>')) + 9)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""
