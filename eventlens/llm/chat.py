r"""Chat formatting by columnar byte assembly.

Turns are range partitioned and sorted by (conversation, turn). Within a task
each Arrow batch is laid out as a whole: the lengths of all segments (mark,
role, line end, text, end mark) give their offsets by one cumulative sum, and
marks and contents are scattered into one preallocated byte buffer, which is
the data buffer of the output column. No string is built per turn.

Template of a turn: ``<|im_start|>`` role ``\n`` text ``<|im_end|>\n``.
Control strings (of this template and others in wide use) inside a text or role
get a backslash after their first character, and those that have backslashes
there already one more, so the marks are unambiguous and escaping is undone
exactly. In roles, backslashes and line ends are written ``\\`` and ``\n``.

Output rows are *pieces*: consecutive turns of one conversation from one Arrow
batch. A conversation is usually one piece; one that is longer than a batch, or
that holds a third of all rows, is several, in order of (``part``, ``seq``), so
no task holds a whole one. The loss mask of a piece is a list of byte spans in it: the
contents of the assistant's turns.

Defined results: null text or role: empty; a null conversation id is a
conversation of its own; turns that tie stand in order of role and text;
repeated rows are repeated turns; an empty table gives an empty result; other
columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.common import read_table

START, BREAK, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
# Control strings of templates in wide use (fixed values).
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
ESCAPE = rf"([<\[])(\\*)({_TAILS})"
UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_TAILS})")

#: Bytes of text laid out at a time, and mean length from which contents are copied one by one.
CHUNK_BYTES = 4 << 20
LONG_TEXT = 4096

PIECES = ("conv_id long, part int, seq long, n_turns long, formatted string, "
          "loss_spans array<struct<start:int,stop:int>>")


def escaped(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.fill_null(column, ""), ESCAPE, r"\1\\\2\3")


def escaped_roles(column: pa.Array) -> pa.Array:
    plain = pc.fill_null(column, "")
    return escaped(pc.replace_substring(pc.replace_substring(plain, "\\", "\\\\"), "\n", "\\n"))


def unescaped(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Content bytes of a string column without gaps, and the lengths."""
    column = pa.concat_arrays([column.cast(pa.large_string())])
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, np.diff(off)


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buffer of all turns, and offsets (turns x 5 + 1) of their segments. Inputs are escaped."""
    role_raw, role_len = _bytes(role)
    text_raw, text_len = _bytes(text)
    n = len(role_len)
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 1], lengths[:, 2], lengths[:, 3], lengths[:, 4] = \
        len(START), role_len, len(BREAK), text_len, len(END)
    offsets = np.concatenate([[0], np.cumsum(lengths.ravel())])
    at = offsets[:-1].reshape(n, 5)
    out = np.empty(int(offsets[-1]), np.uint8)
    for k, mark in ((0, START), (2, BREAK), (4, END)):
        out[at[:, k][:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    for k, raw, length in ((1, role_raw, role_len), (3, text_raw, text_len)):
        source = np.cumsum(length) - length
        if n and len(raw) > LONG_TEXT * n:  # few long contents: copy each
            for a, s, m in zip(at[:, k], source, length):
                out[a:a + m] = raw[s:s + m]
        else:  # scatter all contents in one step
            out[np.repeat(at[:, k] - source, length) + np.arange(len(raw))] = raw
    return out, offsets


def _pieces(batch: pa.RecordBatch, part: int, seq: int) -> pa.RecordBatch:
    conv, roles, texts = batch.column("conv_id"), batch.column("role"), batch.column("text")
    n = batch.num_rows
    out, offsets = assemble(escaped_roles(roles), escaped(texts))
    same = pc.fill_null(pc.equal(conv.slice(1), conv.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
    null = conv.is_null().to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.concatenate([[True], ~(same | (null[1:] & null[:-1]))]))
    last = np.concatenate([first[1:], [n]])
    begin = offsets[first * 5]
    formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(begin, offsets[-1]).astype(np.int32)),
                                            pa.py_buffer(out))
    loss = np.flatnonzero(pc.fill_null(pc.equal(roles, "assistant"), False).to_numpy(zero_copy_only=False))
    piece = np.searchsorted(first, loss, "right") - 1
    spans = pa.StructArray.from_arrays(
        [pa.array((offsets[loss * 5 + k] - begin[piece]).astype(np.int32)) for k in (3, 4)], names=["start", "stop"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(loss, np.append(first, n)).astype(np.int32)), spans)
    return pa.RecordBatch.from_arrays(
        [conv.take(pa.array(first)), pa.array(np.full(len(first), part, np.int32)),
         pa.array(seq + np.arange(len(first))), pa.array(last - first), formatted, lists],
        names=["conv_id", "part", "seq", "n_turns", "formatted", "loss_spans"])


def format_chats(turns: DataFrame) -> DataFrame:
    """Pieces (see the module's text) of ``turns`` (conv_id, turn, role, text)."""
    order = ["conv_id", "turn", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy().astype(np.int64)) // CHUNK_BYTES
            edges = [0, *(np.flatnonzero(np.diff(size)) + 1), b.num_rows]
            for a, z in zip(edges, edges[1:]):
                if z > a:
                    out = _pieces(b.slice(a, z - a), part, seq)
                    seq += out.num_rows
                    yield out

    return turns.select(F.col("conv_id").cast("long"), "turn", F.col("role").cast("string"), F.col("text").cast("string")) \
        .repartitionByRange("conv_id", "turn").sortWithinPartitions(*order).mapInArrow(run, PIECES)


def parse_piece(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted piece."""
    out, end = [], END.decode()
    for turn in formatted.split(START.decode())[1:]:
        if not turn.endswith(end):
            raise ValueError("a turn without its end mark")
        role, _, text = turn[: -len(end)].partition("\n")
        out.append((unescaped_role(role), unescaped(text)))
    return out


def read_chats(pieces: DataFrame) -> DataFrame:
    """Digests per conversation, read back from the pieces one after the other."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []

        def done() -> pa.RecordBatch:
            conv, n, sha, chars, loss, size = state
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([n], pa.int64()), pa.array([sha.hexdigest()]),
                 pa.array([chars], pa.int64()), pa.array([loss.hexdigest()]), pa.array([size], pa.int64())], names=names)

        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")))
            for conv, formatted, spans in rows:
                if not state or state[0] != conv:
                    if state:
                        yield done()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse_piece(formatted):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                raw = formatted.encode()
                for s in spans:
                    text = unescaped(raw[s["start"]:s["stop"]].decode())
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(formatted)
        if state:
            yield done()

    return pieces.select("conv_id", "part", "seq", "formatted", "loss_spans").repartition("conv_id") \
        .sortWithinPartitions("conv_id", "part", "seq").mapInArrow(
            run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                "conv_id long, turn long, role string, text string")
    return read_chats(format_chats(turns.unionByName(own)))


#: DuckDB twin: escaping adds a character per control string, a turn's marks are 24.
OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(role) + length(text) + len(regexp_extract_all(text,
  '[<\[]\\*(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)')) + 24 AS n FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
