"""Operator 11: chat formatting by columnar byte assembly.

A conversation's turns become one text, ``<turn>role\\ntext</turn>\\n`` each.  The template's control strings
(``<turn>`` and ``</turn>``) and backslashes inside roles and texts get a backslash before them, as do line ends inside
roles, so that the text can be read back exactly.  Rows are sorted by conversation; for a slice of them the lengths of
all segments (headers, contents, endings) are computed at once, their cumulative sums give where each segment stands,
and headers and content bytes are scattered into one preallocated buffer, which is the Arrow column that goes out.

A loss mask goes with each text: start and length, in code points, of what assistants say.

Bounded memory: rows stream through a task in order.  Of a conversation with more than ``PIECE`` bytes each such part,
cut between turns, is a row of its own (``piece`` from 0); its texts joined in order are the conversation's text.  So
a task never holds more of a conversation than that and one turn.

Edge cases: null texts and roles are empty; turns with equal numbers are ordered by role and text, missing numbers come
first; repeated rows are turns each; rows without a conv_id are one conversation without an id; an empty table gives
no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb

#: The template, and the role whose texts are learnt from.
OPEN, HEADER_END, CLOSE, ENDING, LEARNT = b"<turn>", b"\n", b"</turn>", b"\n", "assistant"
ESCAPE = ord("\\")
#: Bytes of contents assembled at once, and of one conversation that make a piece.
SLICE, PIECE = 1 << 20, 1 << 22
LOSS = "array<struct<start: long, length: long>>"


def marks(data: np.ndarray, offsets: np.ndarray, word: bytes) -> np.ndarray:
    """Where a word starts in rows of bytes; it never crosses rows."""
    at = np.flatnonzero(data[: max(0, len(data) - len(word) + 1)] == word[0])
    for k in range(1, len(word)):
        at = at[data[at + k] == word[k]]
    return at[at + len(word) <= offsets[np.searchsorted(offsets, at, "right")]] if len(at) else at


def needs_escape(data: np.ndarray, offsets: np.ndarray, also: bytes = b"") -> np.ndarray:
    """Which bytes get a backslash before them: backslashes, starts of control strings, and single bytes given."""
    out = data == ESCAPE
    for byte in also:
        out |= data == byte
    for word in (OPEN, CLOSE):
        out[marks(data, offsets, word)] = True
    return out


def assemble(roles: tuple[np.ndarray, np.ndarray], texts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The turns' bytes in one buffer, where each turn starts (one more), and each text's span (rows by 2).

    Roles and texts are bytes and row offsets.
    """
    parts = [(*roles, needs_escape(*roles, HEADER_END)), (*texts, needs_escape(*texts))]
    before = [np.concatenate(([0], np.cumsum(mask))) for _, _, mask in parts]
    sizes = [np.diff(offsets) + np.diff(done[offsets]) for (_, offsets, _), done in zip(parts, before)]
    fixed = [np.frombuffer(x, np.uint8) for x in (OPEN, HEADER_END, CLOSE + ENDING)]
    rows = len(sizes[0])
    lengths = np.empty((rows, 5), np.int64)
    for k, size in enumerate((len(fixed[0]), sizes[0], len(fixed[1]), sizes[1], len(fixed[2]))):
        lengths[:, k] = size
    ends = np.cumsum(lengths.reshape(-1))
    starts = (ends - lengths.reshape(-1)).reshape(rows, 5)
    out = np.empty(int(ends[-1]) if rows else 0, np.uint8)
    for k, word in zip((0, 2, 4), fixed):
        out[starts[:, k, None] + np.arange(len(word))] = word
    for k, (data, offsets, mask), done in zip((1, 3), parts, before):
        base = starts[:, k] - offsets[:-1] - done[offsets[:-1]]
        to = np.repeat(base, np.diff(offsets)) + np.arange(len(data)) + done[1:]
        out[to] = data
        out[to[mask] - 1] = ESCAPE
    return out, np.append(starts[:, 0], len(out)), np.stack([starts[:, 3], starts[:, 4]], 1)


def _heads(ids: pa.Array) -> np.ndarray:
    """Rows at which another id begins; the first row is one."""
    codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.flatnonzero(np.diff(codes, prepend=-1))


def _characters(data: np.ndarray) -> np.ndarray:
    """How many code points start before each byte, and in all."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))


def _formatted(rows: pa.RecordBatch, first_piece: int, schema: pa.Schema) -> pa.RecordBatch:
    """One row per conversation of whole, ordered rows; ``first_piece`` is the number of the first one's piece."""
    ids, roles, texts = (rows.column(n) for n in ("conv_id", "role", "text"))
    data, starts, spans = assemble(tb.text_bytes(roles), tb.text_bytes(texts))
    heads = _heads(ids)
    bounds = np.append(starts[heads], len(data))
    text = pa.StringArray.from_buffers(len(heads), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data))
    said = np.flatnonzero(pc.fill_null(pc.equal(roles, LEARNT), False).to_numpy(zero_copy_only=False))
    turns = np.diff(np.append(heads, rows.num_rows))
    owner = np.repeat(np.arange(len(heads)), turns)[said]
    chars = _characters(data)
    begin, end = chars[spans[said, 0]], chars[spans[said, 1]]
    loss = pa.StructArray.from_arrays([pa.array(begin - chars[bounds[owner]]), pa.array(end - begin)], fields=list(schema.field("loss").type.value_type))
    loss = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(heads) + 1)).astype(np.int32)), loss, type=schema.field("loss").type)
    pieces = np.zeros(len(heads), np.int32)
    pieces[:1] = first_piece
    return pa.RecordBatch.from_arrays([ids.take(pa.array(heads)), pa.array(pieces), pa.array(turns), text, loss], schema=schema)


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, piece, n_turns, text, loss) of rows (conv_id, turn, role, text); pieces of a conversation in order."""
    kind = turns.schema["conv_id"].dataType
    columns = [F.col("conv_id"), F.col("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")]
    rows = turns.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    out = T.StructType([T.StructField("conv_id", kind), *T._parse_datatype_string(f"piece int, n_turns long, text string, loss {LOSS}").fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, piece, going_on = None, 0, None  # rows of a conversation that may go on, and the one that a piece went of
        for batch in batches:
            offsets = tb.text_bytes(batch.column(3))[1]
            for low, high in tb.slices(offsets, SLICE):
                rows = batch.slice(low, high - low)
                if waiting is not None:
                    rows = pa.Table.from_batches([waiting, rows]).combine_chunks().to_batches()[0]
                elif going_on is not None and rows.column(0)[0] != going_on:
                    piece, going_on = 0, None
                last = int(_heads(rows.column(0))[-1])
                if last:
                    yield _formatted(rows.slice(0, last), piece, schema)
                    piece, going_on = 0, None
                waiting = rows.slice(last)
                if waiting.get_total_buffer_size() > PIECE and int(pc.sum(pc.binary_length(waiting.column(3))).as_py() or 0) > PIECE:
                    yield _formatted(waiting, piece, schema)
                    piece, going_on, waiting = piece + 1, waiting.column(0)[0], None
        if waiting is not None:
            yield _formatted(waiting, piece, schema)

    return rows.mapInArrow(work, out)


def _escapers(data: np.ndarray) -> np.ndarray:
    """Backslashes that stand for the byte after them: the first, third and so on of those in a row."""
    at = np.flatnonzero(data == ESCAPE)
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return at[place % 2 == 0]


def contents(data: np.ndarray, offsets: np.ndarray, begin: np.ndarray, length: np.ndarray, owner: np.ndarray) -> tuple:
    """What formatted rows say: (turns a row; bytes and offsets of role, line end, text, line end of all turns; the same of what the loss mask covers).

    ``begin`` and ``length`` are the mask's spans, in code points, of the rows ``owner``.
    """
    escapers = _escapers(data)
    opens, closes = (np.setdiff1d(marks(data, offsets, word), escapers + 1, assume_unique=True) for word in (OPEN, CLOSE))
    plain = np.ones(len(data), bool)
    plain[escapers] = False
    masked = np.zeros(len(data) + 1, np.int8)
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    base = np.searchsorted(chars, offsets[owner])
    ends = np.append(chars, len(data))
    np.add.at(masked, ends[base + begin], 1)
    np.add.at(masked, ends[base + begin + length], -1)
    learnt = plain & (np.cumsum(masked[:-1]) > 0)
    for at, word in ((opens, OPEN), (closes, CLOSE)):
        plain[at[:, None] + np.arange(len(word))] = False
    kept = lambda mask: (data[mask], np.concatenate(([0], np.cumsum(mask)))[offsets])
    return np.diff(np.searchsorted(opens, offsets)), *kept(plain), *kept(learnt)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of conversations, from the formatted texts and masks alone; pieces must come in order, as formatted.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)
    """
    out = T.StructType([formatted.schema["conv_id"], *T._parse_datatype_string("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None  # of the last conversation: it may have more pieces
        done: list[tuple] = []
        finish = lambda s: (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])
        for batch in batches:
            lengths = tb.text_bytes(batch.column(1))[1]
            for low, high in tb.slices(lengths, SLICE):
                rows = batch.slice(low, high - low)
                data, offsets = tb.text_bytes(rows.column(1))
                loss = rows.column(2)
                spans, owner = loss.flatten(), np.repeat(np.arange(rows.num_rows), pc.list_value_length(loss).to_numpy())
                turns, said, said_at, learnt, learnt_at = contents(data, offsets, spans.field(0).to_numpy(), spans.field(1).to_numpy(), owner)
                chars, learnt_chars = _characters(data)[offsets], _characters(learnt)[learnt_at]
                for k, (conv_id, piece) in enumerate(zip(rows.column(0).to_pylist(), rows.column(3).to_pylist())):
                    if piece == 0:
                        done += [finish(state)] if state else []
                        state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    state[1] += int(turns[k])
                    state[2].update(said[said_at[k] : said_at[k + 1]])
                    state[3] += int(learnt_chars[k + 1] - learnt_chars[k])
                    state[4].update(learnt[learnt_at[k] : learnt_at[k + 1]])
                    state[5] += int(chars[k + 1] - chars[k])
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d)) for d in done], schema=schema)
                done = []
        if state:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, finish(state)))], schema=schema)

    return formatted.select("conv_id", "text", "loss", "piece").mapInArrow(work, out)


def op11_query(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one (-7) that says the template's own control strings."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(turns.unionByName(more)))


_ESCAPED = r"replace(replace(replace({x}, '\', '\\'), '<turn>', '\<turn>'), '</turn>', '\</turn>')"
ORACLE_SQL = rf"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(15 + length(replace({_ESCAPED.format(x="role")}, chr(10), '\' || chr(10))) + length({_ESCAPED.format(x="text")})) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
