"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints: A-Z is lower-cased, words are split at space and ``\\t``..``\\r``,
shingles of ``shingle`` words (repeats included) are hashed with XXH64 (seed
42), and a bit is set when it is set in over half of the hashes. Exact copies
share a fingerprint; all later work is on distinct fingerprints.

Join: two fingerprints within ``distance`` bits agree on one of ``distance + 1``
bit blocks. Each block's value is a bucket; a bucket that is too large for one
task is cut again in the same way by the bits not yet used, which keeps every
pair together in at least one part. A bucket is then joined with itself as a
binary trie: pairs of nodes are walked down together, differing bits are added
up, and a pair is dropped when it exceeds the distance. All buckets of a chunk
go down in one numpy pass. What a bucket gives is a spanning forest of its
links (one link per fingerprint at most), never all pairs of a group; the
components over all buckets follow from it.

Defined results: a null or empty text has fingerprint zero, linked like any
other; equal fingerprints are one group; rows of equal id are rows like any
other; a null id is never the smallest (a group of null ids only has a null
``component_id``); an empty table gives an empty result; other columns of the
input are not read (``one_of_each`` keeps them; names that begin with two
underscores are taken).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.common import read_table, stored
from eventlens.llm.components import connected_components

SEED = 42
SHINGLE = 3
DISTANCE = 3
#: Fingerprints of a bucket that one trie takes; larger buckets are cut again.
BUCKET = 1024
CHUNK = 1 << 15
PAIRS = 1 << 21


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # on bytes: A-Z, and exactly the six separators
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        line, digest = b" ".join(words), xxhash.xxh64_intdigest
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [digest(line[a:b], SEED) for a, b in
                  zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[k:k + (1 << 14)], "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, th, fp)``: the id, the text's 64-bit hash, and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t or b"", shingle) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["id", "th", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("id"), text_hash(text_col), F.col(f"`{text_col}`").cast("binary").alias("t")) \
        .mapInArrow(run, f"id {kind}, th long, fp long")


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("th")


class _Forest:
    """Least-index labels of linked positions."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(self.label, high, low)
            while True:  # every label points at a root again
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def trie_links(group: np.ndarray, fp: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For each fingerprint the position of the first one of its group that it
    is linked to, directly or over others of the group. ``group`` and ``fp``
    (unsigned) are sorted together; equal ones stand next to each other."""
    n = len(fp)
    forest = _Forest(n)
    if n < 2:
        return forest.label
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    ends = np.concatenate([starts[1:], [n]])
    many = ends - starts > 1
    lo, hi = starts[many].astype(np.int32), ends[many].astype(np.int32)
    # Ranges of one trie level: (first node, second node, differing bits, bit to look at)
    stack = [(lo, hi, lo, hi, np.zeros(len(lo), np.int8), 63)]
    while stack:
        l1, h1, l2, h2, d, bit = stack.pop()
        if len(l1) > PAIRS:
            half = len(l1) // 2
            for s in (slice(half, None), slice(half)):
                stack.append((l1[s], h1[s], l2[s], h2[s], d[s], bit))
            continue
        leaf = (h1 - l1 == 1) & (h2 - l2 == 1) & (l1 != l2)
        if bit < 0:  # two whole paths; equal fingerprints of a node are linked as well
            same = np.flatnonzero((l1 == l2) & (h1 - l1 > 1))
            for k in same:
                forest.link(np.arange(l1[k] + 1, h1[k]), np.full(h1[k] - l1[k] - 1, l1[k]))
            forest.link(l1[l1 != l2], l2[l1 != l2])
            continue
        if leaf.any():
            i, j = l1[leaf], l2[leaf]
            near = np.bitwise_count(fp[i] ^ fp[j]) <= distance
            forest.link(i[near], j[near])
            l1, h1, l2, h2, d = (x[~leaf] for x in (l1, h1, l2, h2, d))
        if not len(l1):
            continue
        ones = np.concatenate([[0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)]).astype(np.int32)
        m1 = h1 - (ones[h1] - ones[l1])  # a node's zeros stand before its ones
        m2 = h2 - (ones[h2] - ones[l2])
        own = l1 == l2
        out = []
        for a1, b1, a2, b2, more, use in ((l1, m1, l2, m2, 0, None), (m1, h1, m2, h2, 0, None),
                                          (l1, m1, m2, h2, 1, None), (m1, h1, l2, m2, 1, ~own)):
            keep = (b1 > a1) & (b2 > a2) & (d + more <= distance)
            if use is not None:
                keep &= use  # a node with itself: its two halves meet once
            if not more:
                keep &= ~own | (b1 - a1 > 1)
            out.append((a1[keep], b1[keep], a2[keep], b2[keep], d[keep] + np.int8(more)))
        stack.append((*(np.concatenate(x) for x in zip(*out)), bit - 1))
    return forest.label


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(np.array(bits), parts)]


def _signed(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _cut(rows: DataFrame, rest: list[list[int]], distance: int) -> tuple[DataFrame, list[list[int]]]:
    """Rows ``(key, path, fp)`` cut by the blocks of the bits that their path has
    not used; ``rest`` has these bits by path. Keys are hashes of what the members
    agree on: if two keys ever met, a bucket would only hold more than it must,
    as pairs are measured in full."""
    parts = distance + 1
    blocks = [_blocks(bits, parts) for bits in rest]
    own = []
    for k in range(parts):
        masks = F.array(*[F.lit(_signed(x[k])).cast("long") for x in blocks])
        own.append(F.struct((F.col("path") * parts + k).alias("path"), F.xxhash64(
            "key", F.col("path") * parts + k,
            F.col("fp").bitwiseAND(F.get(masks, F.col("path").cast("int")))).alias("key")))
    left = [[b for b in bits if b not in x[k]] for bits, x in zip(rest, blocks) for k in range(parts)]
    return rows.select(F.explode(F.array(*own)).alias("x"), "fp").select("x.key", "x.path", "fp"), left


def _bucket_links(rows: DataFrame, distance: int) -> DataFrame:
    """``(a, b)`` links of each bucket's spanning forest."""

    def solve(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        label = trie_links(key, fp, distance)
        linked = np.flatnonzero(label != np.arange(len(fp)))
        out = fp.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(out[linked]), pa.array(out[label[linked]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:  # sorted by key: a bucket's rows follow each other
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)))
            size += b.num_rows
            if size >= CHUNK:
                key, fp = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield solve(key[:cut], fp[:cut])
                held, size = [(key[cut:], fp[cut:])], len(key) - cut
        if size:
            yield solve(*(np.concatenate(x) for x in zip(*held)))

    return rows.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def near_links(distinct: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints (column ``fp``) that have
    the same components as all pairs within ``distance`` bits."""
    rows = distinct.select(F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("path"), "fp")
    rest, found = [list(range(64))], None
    while True:
        cut, rest = _cut(rows, rest, distance)
        cut = stored(cut, "simhash-buckets")
        sizes = cut.groupBy("key").agg(F.count("fp").alias("n")).where("n > 1")
        sized = cut.join(sizes, "key")
        # With few bits left, a bucket of distinct fingerprints is small by itself.
        last = max(map(len, rest)) <= 12
        cold = _bucket_links(sized if last else sized.where(F.col("n") <= bucket), distance)
        found = cold if found is None else found.union(cold)
        if last:
            return found
        rows = stored(sized.where(F.col("n") > bucket).select("key", "path", "fp"), "simhash-large")
        if rows.isEmpty():
            return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Per row of ``docs``: ``id``, ``th`` (text hash), ``fp``, ``root`` (a
    fingerprint that names the group) and ``component_id``, the smallest id
    reachable over links."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    own = stored(prints.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    comp = connected_components(near_links(own.select("fp"), distance, bucket), "a", "b")
    rooted = own.join(comp.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp") \
        .select("id", "th", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each group: the smallest id's (null ids last,
    then by text hash). A kept row that is there twice, id and text alike, stays once."""
    groups = stored(near_duplicates(docs, id_col, text_col, shingle, distance), "simhash-groups")
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("x")) \
        .select(F.col("x.id").alias("__id"), F.col("x.th").alias("__th"))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (text_hash(text_col) == F.col("__th"))
    kept = docs.join(best, same, "left_semi")
    if groups.groupBy("id", "th").count().where("count > 1").isEmpty():
        return kept
    return kept.withColumn("__th", text_hash(text_col)).dropDuplicates([id_col, "__th"]).drop("__th")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return groups.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                         "component_id")
