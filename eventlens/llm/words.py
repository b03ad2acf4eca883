"""Words of a batch of texts as byte ranges of one buffer, found by numpy.

Words are runs of digits, letters a-z (A-Z are lower-cased) and whatever is not
ASCII: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. All bytes of a character beyond
ASCII are 0x80 or more, so the rule may be applied to bytes, and no text
becomes a Python string."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TEXT_BYTES = 4 << 20  # of texts looked at together; a longer text is one alone
TABLE_WORD = 48  # bytes; crc32 of longer words is asked from zlib

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, np.int8)
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _IN_WORD[_first:_last + 1] = 1


class Words(NamedTuple):
    """Words of texts in order: ``data[start:stop]`` is one; ``first[k]:first[k + 1]`` are those of text k."""

    data: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def split_words(texts: pa.Array) -> Words:
    """Words of string values; a null has none."""
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, np.int64)
    size = int(ends[-1] - ends[0])
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0]:ends[-1]] if size else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    inside = np.zeros(size + 2, np.int8)
    inside[1:-1] = _IN_WORD[raw]
    edge = inside[1:] - inside[:-1]
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # a word that goes on into the next text is two
    cut = np.unique(ends[1:-1])
    cut = cut[(cut > 0) & (cut < size)]
    cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
    if len(cut):
        start, stop = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([stop, cut]))
    return Words(_LOWER[raw], start, stop, np.searchsorted(start, ends))


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def word_crc32(words: Words) -> np.ndarray:
    """Unsigned crc32 of each word's bytes: all words take a byte per step."""
    data, start, size = words.data, words.start, words.stop - words.start
    out = np.zeros(len(start), np.uint32)
    long = np.flatnonzero(size > TABLE_WORD)
    for k in long.tolist():
        out[k] = zlib.crc32(data[start[k]:words.stop[k]].tobytes())
    order = np.argsort(-np.where(size > TABLE_WORD, 0, size).astype(np.int16), kind="stable")
    order = order[:len(order) - len(long)]
    size, at = size[order], start[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    # words with more than k bytes stand first
    live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
    for k, n in enumerate(live.tolist()):
        c = crc[:n]
        crc[:n] = _CRC[(c ^ data[at[:n] + k]) & np.uint32(255)] ^ (c >> np.uint32(8))
    out[order] = ~crc
    return out


def text_slices(batch: pa.RecordBatch, column: int, limit: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``limit`` bytes of the column's texts."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
        yield batch.slice(at, stop - at)
        at = stop

