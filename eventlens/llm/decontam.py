r"""Benchmark decontamination: rare word pairs as seeds, then Smith-Waterman alignment.

A leak is a passage whose local alignment with a test item (match 2, mismatch
and gap -1) scores at least

* ``THRESHOLD`` of a perfect copy of the item, but at least ``SHORT`` points
  (or a perfect copy, if that is less), or
* ``LONG`` points within ``LONG_SPAN`` words: a run too long to be chance, however long the
  item is.

Seeds are all pairs of an item's words, one or two words apart, that stand one
or two words apart in a document. A step of an alignment from one match to the
next that is no such pair gains nothing, so an alignment of score T has at
least (T - 2) / 2 seeds, in a passage of bounded length, and one that
begins at a seed scores no less. Where a window of that length from a seed on holds fewer seeds of
an item, there is no leak; common pairs are counted like others and nothing
is left out. So seeds join passages to items by an exact bound, not by a guess,
and every leak is found at any rate of edits down to the threshold
(insertions, deletions and changed words).

1. The test items are read in blocks of at most ``BLOCK_BYTES`` of text; up to
   ``BLOCKS`` of them are looked for in one pass over the documents, so a task's memory
   is bounded.
2. Tasks cut texts into words by numpy, look up the pairs, expand them to the
   items that hold them, and count seeds per window by binary search. Long
   texts are looked at in parts that overlap by a window, so a text that
   repeats a common pair has bounded arrays.
3. Windows of one item that touch are one candidate, cut into overlapping
   pieces of two windows' length. All candidates of a batch are aligned together, row by row
   of the dynamic programme.

Words are runs of letters and digits, lower-cased; in scripts without spaces
each character is a word, so that copies are found there, too. Nothing of a
text is cut away.

Defined results: a null or empty text has no match; items with fewer than
``LEAST_WORDS`` words (null ones, too) match nothing; repeated items match each
under their own id; repeated documents each give their rows; if the id columns
of both tables have one name, the item's becomes ``<name>_item``; other columns
are not read (``leaks``) or pass through (``without_leaks``); an empty table of
either kind gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from eventlens.llm.byte_table import ByteTable
from eventlens.llm.common import read_table, stored
from eventlens.llm.words import Words, text_slices

THRESHOLD = 0.45
SHORT, LONG, LONG_SPAN = 12, 50, 150
LEAST_WORDS = 3
BLOCK_BYTES = 8 << 20
BLOCKS = 4
CANDIDATES = 2048  # aligned at a time
ALIGNED = 1 << 20  # cells of a row of all of these
CELLS = 1 << 21  # seeds times items looked at together
GAP = 2  # no pair of words goes from one text into the next
_FILTER = 22  # bits

WORDS = re.compile(r"\w+")


def passage_words(texts: pa.Array) -> Words:
    """Lower-cased words of string values (null: none): runs of letters and
    digits, single characters in scripts without spaces."""
    texts = pc.utf8_lower(texts.fill_null("")).cast(pa.large_string())
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, np.int64)
    size = int(ends[-1] - ends[0])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0]:ends[-1]] if size else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    at = np.flatnonzero((data & 0xC0) != 0x80)  # characters
    a = data[at]
    ascii_word = ((a >= 0x30) & (a <= 0x39)) | ((a >= 0x61) & (a <= 0x7A)) | (a == 0x5F)
    kind = np.where(a < 0x80, ascii_word, 1).astype(np.int8)  # 0: between words, 1: in a word, 2: a word alone
    far = np.flatnonzero(a >= 0x80)
    if len(far):
        a = a[far]
        b, c = (data[np.minimum(at[far] + k, size - 1)] for k in (1, 2))
        none = ((a == 0xC2) & ~np.isin(b, (0xAA, 0xB5, 0xBA)) | (a == 0xC3) & ((b == 0x97) | (b == 0xB7))
                | (a == 0xE2) & ((b == 0x80) | (b == 0x81) & (c < 0xB0)) | (a == 0xE3) & (b == 0x80)
                | (a == 0xEF) & (b == 0xBC) & ((c < 0x90) | (c > 0x99) & (c < 0xA1) | (c > 0xBA)) | (a == 0xEF) & (b == 0xBD) & (c > 0x9A) & (c < 0xA6))
        alone = ((a >= 0xE3) & (a <= 0xED) | (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB) | (a == 0xE1) & np.isin(b, (0x80, 0x81, 0x9E, 0x9F))
                 | (a == 0xEF) & (b == 0xBD) & (c >= 0xA6) | (a == 0xEF) & (b == 0xBE) | (a >= 0xF0))
        kind[far] = np.where(none, 0, np.where(alone, 2, 1))
    first = np.zeros(size + 1, bool)
    first[ends[:-1]] = True
    fresh = first[at]
    before = np.concatenate([[0], kind[:-1]]) if len(kind) else kind
    begin = np.flatnonzero((kind == 2) | (kind == 1) & (fresh | (before != 1)))
    stops = np.flatnonzero(np.append((kind != 1) | fresh, True))
    to = np.where(kind[begin] == 2, begin + 1, stops[np.searchsorted(stops, begin, "right")]) if len(begin) else begin
    bounds = np.append(at, size)
    start, stop = bounds[begin], bounds[to]
    return Words(data, start, stop, np.searchsorted(start, ends))


class Items(NamedTuple):
    """Test items of a block, in arrays: words as numbers from 1 on."""

    ids: list
    words: list[np.ndarray]
    number: dict[str, int]
    table: ByteTable
    pairs: np.ndarray  # sorted keys of all seeds
    starts: np.ndarray  # per key, its range in `item`
    item: np.ndarray
    may_be: np.ndarray  # bits of the keys' hashes: most pairs are in no item
    least: np.ndarray  # per item: score of a leak,
    span: np.ndarray  # words of the passage that is looked for,
    need: np.ndarray  # its seeds,
    reach: np.ndarray  # and words of the longest passage with that score


def least_score(n: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Score of a leak of items of n words."""
    share = np.minimum(np.maximum(threshold * 2 * n, SHORT), 2 * n)
    return np.ceil(np.minimum(share, LONG) - 1e-9).astype(np.int64)


def _hash(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER)).astype(np.int64)


def _pair_keys(words: np.ndarray, base: int, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a known word with a known one ``apart`` words behind it, and the pair's key."""
    a, b = words[:-apart], words[apart:]
    at = np.flatnonzero((a > 0) & (b > 0))
    return at, a[at] * base + b[at]


def make_items(rows: list[tuple], threshold: float = THRESHOLD) -> Items:
    """``rows``: (id, text) of a block."""
    found = passage_words(pa.array([t for _, t in rows], pa.string()))
    strings = [found.data[x:y].tobytes().decode("utf-8") for x, y in zip(found.start, found.stop)]
    split = [(i, strings[x:y]) for (i, _), x, y in zip(rows, found.first, found.first[1:])]
    split = sorted([(i, w) for i, w in split if len(w) >= LEAST_WORDS], key=lambda x: (x[0] is None, x[0], x[1]))
    number: dict[str, int] = {}
    words = [np.array([number.setdefault(w, len(number) + 1) for w in ws], np.int64) for _, ws in split]
    table, raw = ByteTable(), [w.encode("utf-8") for w in number]
    if raw:
        ends = np.cumsum([0, *map(len, raw)]).astype(np.int64)
        got, _ = table.numbers(np.frombuffer(b"".join(raw), np.uint8), ends[:-1], ends[1:])
        number = {w: int(k) + 1 for w, k in zip(number, got)}  # the table numbers them in an order of its own
        renumber = np.concatenate([[0], got + 1])
        words = [renumber[w] for w in words]
    base = len(number) + 1
    keys = [np.unique(np.concatenate([_pair_keys(w, base, k)[1] for k in (1, 2)])) for w in words]
    flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    item = np.repeat(np.arange(len(keys)), [len(k) for k in keys]).astype(np.int64)
    order = np.argsort(flat, kind="stable")
    pairs, starts = np.unique(flat[order], return_index=True)
    may_be = np.zeros(1 << _FILTER, bool)
    may_be[_hash(pairs)] = True
    n = np.array([len(w) for w in words], np.int64)
    least = least_score(n, threshold)
    # words beside the matches cost a point each: at most 2n - T of them, and n matches
    reach = np.maximum(3 * n - least, 2)
    span = np.where(least >= LONG, np.minimum(reach, LONG_SPAN), reach)
    return Items([i for i, _ in split], words, number, table, pairs, np.append(starts, len(flat)), item[order], may_be,
                 least, span, np.maximum(1, -(-(least - 2) // 2)), reach)


def _numbers(items: Items, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts as numbers (0: in no item) with a gap after each text, and where texts begin."""
    words = passage_words(texts)
    n = words.counts
    out = np.zeros(len(words.start) + GAP * len(n), np.int64)
    out[np.arange(len(words.start)) + GAP * np.repeat(np.arange(len(n)), n)] = items.table.find(words.data, words.start, words.stop) + 1
    return out, words.first[:-1] + GAP * np.arange(len(n))


def _seeds(items: Items, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``flat`` where a pair of an item begins, and which one, in order."""
    places, pairs = [], []
    for apart in (1, 2):
        at, key = _pair_keys(flat, len(items.number) + 1, apart)
        some = np.flatnonzero(items.may_be[_hash(key)])
        at, key = at[some], key[some]
        g = np.minimum(np.searchsorted(items.pairs, key), len(items.pairs) - 1)
        ok = items.pairs[g] == key
        places.append(at[ok])
        pairs.append(g[ok])
    at, pair = np.concatenate(places), np.concatenate(pairs)
    order = np.argsort(at, kind="stable")
    return at[order], pair[order]


def _windows(items: Items, at: np.ndarray, pair: np.ndarray, ends: np.ndarray, size: int, upto: int) -> tuple[np.ndarray, ...]:
    """``(item, first, stop)`` of candidates that begin before ``upto``; ``ends``: where the text of each seed ends."""
    n = items.starts[pair + 1] - items.starts[pair]
    pick = np.repeat(items.starts[pair] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    key = items.item[pick] * size + np.repeat(at, n)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key  # a place counts once
    item, p = key // size, key % size
    stop = np.minimum(p + items.span[item], ends[np.searchsorted(at, p)])
    count = np.searchsorted(key, item * size + stop) - np.arange(len(key))
    ok = (count >= items.need[item]) & (p < upto)
    return item[ok], p[ok], stop[ok]


def _joined(items: Items, item: np.ndarray, p: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows of one item that touch as one candidate, in pieces of two windows that overlap by one."""
    order = np.lexsort((p, item))
    item, p, stop = item[order], p[order], stop[order]
    new = np.concatenate([[True], (item[1:] != item[:-1]) | (p[1:] >= stop[:-1])]) if len(p) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    item, a, b = item[first], p[first], stop[last] if len(p) else p
    span = items.span[item]
    n = np.maximum(1, -(-(b - a) // span) - 1)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    item, a, b, span = (np.repeat(x, n) for x in (item, a, b, span))
    return item, a + k * span, np.minimum(a + (k + 2) * span, b)


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each row's item and passage (both padded by 0):
    score, and the last place of it in the item and in the passage."""
    n, width = passage.shape
    j = np.arange(width, dtype=np.int32)
    row = np.zeros((n, width + 1), np.int32)
    best, at_i, at_j = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(item.shape[1]):
        w = item[:, i:i + 1]
        score = np.where((passage == w) & (w > 0), 2, -1)
        cell = np.maximum(np.maximum(row[:, :-1] + score, row[:, 1:] - 1), 0)
        # gaps along the row: the best cell to the left, less one per step
        cell = np.maximum.accumulate(cell + j, axis=1) - j
        row[:, 1:] = cell
        k = cell.argmax(axis=1)
        top = cell[np.arange(n), k]
        more = top > best
        best[more], at_i[more], at_j[more] = top[more], i, k[more]
    return best, at_i, at_j


def _padded(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows))), np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _align(items: Items, flat: np.ndarray, item: np.ndarray, spans: np.ndarray, places: bool = False) -> tuple[np.ndarray, ...]:
    """Best alignment of each item with its passage: score, and with ``places``
    the first and last word of it in the passage."""
    own = [items.words[i] for i in item.tolist()]
    width = int((spans[:, 1] - spans[:, 0]).max())
    step, parts = max(1, ALIGNED // width), []
    for k in range(0, len(own), step):
        some, passages = own[k:k + step], [flat[a:b] for a, b in spans[k:k + step].tolist()]
        score, i, j = smith_waterman(_padded(some), _padded(passages))
        back = j
        if places:  # the same alignment backwards from its end has its start as the end
            _, _, back = smith_waterman(_padded([w[e::-1] for w, e in zip(some, i)]), _padded([p[e::-1] for p, e in zip(passages, j)]))
        parts.append((score, j - back, j))
    return tuple(np.concatenate(x) for x in zip(*parts))


def find(items: Items, texts: pa.Array | list[str | None]) -> list[list[tuple]]:
    """Per text its leaks ``(item id, score, first word, last word)``, the best of
    each item; the score is the share of a perfect copy of the item."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    out: list[list[tuple]] = [[] for _ in range(len(texts))]
    if not len(texts) or not items.ids:
        return out
    flat, starts = _numbers(items, texts)
    at, pair = _seeds(items, flat)
    if not len(at):
        return out
    text_ends = np.append(starts[1:], len(flat)) - GAP
    ends = text_ends[np.searchsorted(starts, at, "right") - 1]
    # parts of bounded size, each with a window's length of seeds behind it
    n = np.cumsum(items.starts[pair + 1] - items.starts[pair])
    reach, found, lo = int(items.span.max()), [], 0
    while lo < len(at):
        hi = int(np.searchsorted(n, (n[lo - 1] if lo else 0) + CELLS, "right"))
        hi = max(hi, lo + 1)
        hi = int(np.searchsorted(at, at[hi - 1], "right"))  # seeds of one place stay together
        more = int(np.searchsorted(at, at[hi - 1] + reach + 1, "right"))
        found.append(_windows(items, at[lo:more], pair[lo:more], ends[lo:more], len(flat) + 1, int(at[hi - 1]) + 1))
        lo = hi
    item, first, stop = _joined(items, *(np.concatenate(x) for x in zip(*found)))
    size = np.array([len(w) for w in items.words])
    best: dict[tuple[int, int], tuple] = {}
    order = np.lexsort((stop - first, size[item]))  # little padding
    for k in range(0, len(order), CANDIDATES):
        part = order[k:k + CANDIDATES]
        spans = np.stack([first[part], stop[part]], axis=1)
        own = item[part]
        score, _, _ = _align(items, flat, own, spans)
        hit = score >= items.least[own]
        own, spans = own[hit], spans[hit]
        if not len(own):
            continue
        doc = np.searchsorted(starts, spans[:, 0], "right") - 1
        # an item longer than its window is aligned again with all that its passage may reach
        more = np.where(items.span[own] < items.reach[own], items.reach[own], 0)
        spans = np.stack([np.maximum(spans[:, 0] - more, starts[doc]), np.minimum(spans[:, 1] + more, text_ends[doc])], axis=1)
        for d, i, a, points, x, y in zip(doc.tolist(), own.tolist(), spans[:, 0].tolist(), *_align(items, flat, own, spans, True)):
            begin, end = int(a + x - starts[d]), int(a + y - starts[d])
            row = (round(float(points) / (2 * int(size[i])), 6), -begin, -end)
            if row > best.get((d, i), (0.0,)):
                best[d, i] = row
    for (d, i), (score, a, b) in sorted(best.items()):
        out[d].append((items.ids[i], score, -a, -b))
    return out


def item_blocks(bench: DataFrame, item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
                threshold: float = THRESHOLD) -> Iterator[Items]:
    """The test items in blocks of bounded size."""
    rows = bench.select(F.col(f"`{item_col}`").alias("i"), F.col(f"`{item_text_col}`").alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    for k in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()
        items = make_items([tuple(r) for r in own], threshold)
        if items.ids:
            yield items


def _passes(bench: DataFrame, item_col: str, item_text_col: str, threshold: float) -> Iterator[list[Items]]:
    """The blocks that one pass over the documents takes."""
    held: list[Items] = []
    for items in item_blocks(bench, item_col, item_text_col, threshold=threshold):
        held.append(items)
        if len(held) == BLOCKS:
            yield held
            held = []
    if held:
        yield held


def leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(id, item, score, first_word, last_word)``: each test item found in each document, at its best place."""
    kind, item_kind = (x.schema[c].dataType for x, c in ((docs, id_col), (bench, item_col)))
    arrow_kind, item_name = to_arrow_type(item_kind), f"{item_col}_item" if item_col == id_col else item_col
    schema = (f"`{id_col}` {kind.simpleString()}, `{item_name}` {item_kind.simpleString()}, score double, "
              "first_word long, last_word long")
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = docs.sparkSession.createDataFrame([], schema)
    for blocks in _passes(bench, item_col, item_text_col, threshold):

        def run(batches: Iterator[pa.RecordBatch], blocks: list[Items] = blocks) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in text_slices(whole, 1):
                    rows = [(k, *m) for items in blocks for k, ms in enumerate(find(items, b.column(1))) for m in ms]
                    which, item, score, first, last = zip(*rows) if rows else [()] * 5
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(which, pa.int64())), pa.array(item, arrow_kind),
                         pa.array(score, pa.float64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())],
                        names=[id_col, item_name, "score", "first_word", "last_word"])

        found = found.union(narrow.mapInArrow(run, schema))
    return found


def without_leaks(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that hold a test item. Documents are
    judged where they stand; nothing is shuffled. With more blocks of items than
    one pass takes, what each pass leaves is stored, so no task runs several of them."""
    where = docs.columns.index(text_col)
    out, passes = docs, 0
    for blocks in _passes(bench, item_col, item_text_col, threshold):

        def run(batches: Iterator[pa.RecordBatch], blocks: list[Items] = blocks) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in text_slices(whole, where):
                    clean = np.ones(b.num_rows, bool)
                    for items in blocks:
                        clean &= [not m for m in find(items, b.column(where))]
                    yield b.filter(pa.array(clean))

        out = (stored(out, "without-leaks") if passes else out).mapInArrow(run, docs.schema)
        passes += 1
    return out


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents", "doc_id", "text"),
                 read_table(spark, sf_dir, "benchmark", "item_id", "text"))
