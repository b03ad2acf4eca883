r"""Line dedup by pairwise alignment.

Documents that share lines are aligned two by two with patience diff, and the
aligned common blocks are deleted from the later one.

* Every line with a word (``\n``-split, outer white space aside) gets a 64-bit
  hash of its text and of how often the document had it before, so a line is
  unique within its document.
* The first holder of a line is its earliest document (by id, then by text
  hash). Each later holder is paired with it: a line in n documents makes n - 1
  links, never all pairs, whether it is rare or in a third of all documents.
  Links are gathered by the later document and are bounded by its lines.
* Each pair is aligned: the longest increasing run over the *rare* shared lines
  (in at most ``RARE`` documents) gives the anchors; frequent lines are aligned
  between anchors by the same rule. What is left was moved: it is aligned again
  by itself, and counts only in blocks of ``MOVED_WORDS`` words or more.
* A line that lies out of order against its first holder may be in order against
  another one. Such lines that were left over are paired anew, with the first of
  the documents that left them over too; these two are aligned over all lines
  that they share. This goes on until no line is left over twice. Each round
  takes the first holder of every such line away, and all later documents that
  have its order with it; an exact copy loses all that its original holds.
* Neighbouring aligned lines form blocks, over all partners of a document;
  blocks of fewer than ``BLOCK_WORDS`` words stay.

Defined results: a null text stays null, an empty one empty; blank lines stay;
a null id comes before all others; rows of equal id are the same document if
their texts are equal (none is cleaned against the other) and otherwise come in
order of their text hash; an empty table gives an empty result; other columns
pass through untouched, but one named like the added struct is replaced, and
names that begin with two underscores are taken.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.common import read_table, stored

RARE = 20
BLOCK_WORDS = 5
MOVED_WORDS = 20

LINES = "id long, th long, key long, pos int, k int, words int"
SPACE = " \t\n\x0b\x0c\r"


def line_rows(text: str) -> list[tuple[int, int, int, int]]:
    """``(key, pos, k, words)`` of each line with a word: its hash, its place
    among all lines and among the lines with a word, and its words."""
    out, seen = [], {}
    for pos, line in enumerate(text.split("\n")):
        words = len(line.encode("utf-8").split())
        if words:
            line = line.strip(SPACE)
            n = seen[line] = seen.get(line, -1) + 1
            key = xxhash.xxh64_intdigest(line.encode("utf-8"), n)
            out.append((key - (1 << 64) if key >> 63 else key, pos, len(out), words))
    return out


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence (patience sorting)."""
    tops, piles, back = [], [], []
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        back.append(piles[p - 1] if p else -1)
        if p == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[p], piles[p] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(there: list[int], rare: list[bool]) -> list[int]:
    """Patience diff of two documents over their shared lines, which are given
    in the order of the later document by their place in the earlier one.
    Returns the indices of the aligned lines."""
    first = [i for i in range(len(there)) if rare[i]] or list(range(len(there)))
    anchors = [first[i] for i in increasing([there[i] for i in first])]
    out = []
    for a, b in zip([-1, *anchors], [*anchors, len(there)]):
        low = there[a] if a >= 0 else -1
        high = there[b] if b < len(there) else float("inf")
        between = [i for i in range(a + 1, b) if low < there[i] < high]
        out += [between[i] for i in increasing([there[i] for i in between])]
        if b < len(there):
            out.append(b)
    return out


def _runs(ks: list[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for k in sorted(ks):
        if out and k == out[-1][-1] + 1:
            out[-1].append(k)
        else:
            out.append([k])
    return out


def aligned_lines(links: list[tuple[tuple, int, int, int, int]], rare: int = RARE,
                  moved_words: int = MOVED_WORDS) -> set[int]:
    """Lines of a document that are aligned with a partner, from its links
    ``(partner, place in partner, own place, words, documents with the line)``;
    places count lines with a word."""
    words = {own: w for _, _, own, w, _ in links}
    by_partner: dict[tuple, list] = {}
    for x in links:
        by_partner.setdefault(x[0], []).append(x)
    aligned: set[int] = set()
    for rows in by_partner.values():
        rows.sort(key=lambda x: x[2])
        moved = False
        while rows:
            hit = set(align([x[1] for x in rows], [x[4] <= rare for x in rows]))
            own = [rows[i][2] for i in sorted(hit)]
            if moved:
                own = [k for run in _runs(own) if sum(words[k] for k in run) >= moved_words for k in run]
            aligned.update(own)
            rows, moved = [x for i, x in enumerate(rows) if i not in hit], True
    return aligned


def _blocks(words: dict[int, int], block_words: int) -> set[int]:
    """Of the aligned lines, given with their words, those in long enough blocks."""
    return {k for run in _runs(list(words)) if sum(words[k] for k in run) >= block_words for k in run}


def removed_lines(links: list[tuple[tuple, int, int, int, int]], rare: int = RARE, block_words: int = BLOCK_WORDS,
                  moved_words: int = MOVED_WORDS) -> set[int]:
    """Lines of a document to delete, from the same links."""
    words = {own: w for _, _, own, w, _ in links}
    return _blocks({k: words[k] for k in aligned_lines(links, rare, moved_words)}, block_words)


def _lines(docs: DataFrame) -> DataFrame:
    """One row for each line with a word, of ``docs`` (id, th, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, h, *x) for i, h, t in zip(*(c.to_pylist() for c in b.columns)) if t for x in line_rows(t)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            cols = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                             names=["id", "th", "key", "pos", "k", "words"])

    return docs.mapInArrow(run, LINES)


LINKS = ("id", "th", "pos", "k", "words", "a_id", "a_th", "a_k", "n", "key", "todo")
ALIGNED = "aligned array<struct<pos int, k int, words int, partner long>>"


def _alignments(links: DataFrame, rare: int, moved_words: int) -> DataFrame:
    """Per later document of ``LINKS``: its ``aligned`` lines with the partner,
    and the keys of those left over. ``todo``: 0 for lines that only tell the
    order, 2 for those that are not left over."""
    parts = pa.struct([("pos", pa.int32()), ("k", pa.int32()), ("words", pa.int32()), ("partner", pa.int64())])
    kinds = (pa.int64(), pa.int64(), pa.list_(parts), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> tuple:
            by_partner: dict[tuple, list] = {}
            for x in held:
                by_partner.setdefault((x[5], x[6]), []).append(x)
            found: dict[int, dict] = {}
            for (a, ah), rows in by_partner.items():
                hit = aligned_lines([((a, ah), x[7], x[3], x[4], x[8]) for x in rows], rare, moved_words)
                for x in rows:
                    if x[3] in hit and x[10]:
                        found.setdefault(x[3], {"pos": x[2], "k": x[3], "words": x[4], "partner": a})
            left = {x[9] for x in held if x[10] == 1 and x[3] not in found}
            return *held[0][:2], list(found.values()), sorted(left)

        def batch(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                              names=["id", "th", "aligned", "left"])

        for b in batches:  # sorted by document
            found = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[0][:2] != row[:2]:
                    found.append(done())
                    held = []
                held.append(row)
            yield batch(found)
        if held:
            yield batch([done()])

    # A repeated row has its links once: the distinct is by the same key as the gathering.
    return links.select(*LINKS).repartition("id", "th").dropDuplicates(["id", "th", "pos", "k", "a_id", "a_th"]) \
        .sortWithinPartitions("id", "th", "k", "a_id", "a_th") \
        .mapInArrow(run, f"id long, th long, {ALIGNED}, left array<long>")


def _shared_lines(near: DataFrame, pairs: DataFrame) -> DataFrame:
    """The lines of ``near`` that both documents of each pair hold, with the
    earlier one's place ``a_k``. A pair's lines are taken from the document with
    fewer of them and looked up in the other: rows in between are at most the
    shorter document's lines for each pair, however long its partner is."""
    sizes = near.groupBy(F.col("id").alias("s_id"), F.col("th").alias("s_th")).agg(F.count("*").alias("s_n"))

    def same(i: str, h: str, other: str) -> Column:
        return F.col(i).eqNullSafe(F.col(f"{other}_id")) & (F.col(h) == F.col(f"{other}_th"))

    with_own = pairs.join(sizes, same("id", "th", "s")).drop("s_id", "s_th").withColumnRenamed("s_n", "own_n")
    sized = with_own.join(sizes, same("a_id", "a_th", "s")).drop("s_id", "s_th")
    line = ["key", "pos", "k", "words", "n"]
    few, many = (near.select(F.col("id").alias(f"{p}_id"), F.col("th").alias(f"{p}_th"),
                             F.struct(*line).alias(f"{p}_line"), F.col("key").alias(f"{p}_key")) for p in ("f", "m"))

    def looked_up(wanted: DataFrame, from_: tuple[str, str], to: tuple[str, str], own: str, other: str) -> DataFrame:
        return wanted.join(few, same(*from_, "f")).join(many, same(*to, "m") & (F.col("f_key") == F.col("m_key"))) \
            .select("id", "th", "a_id", "a_th", *[F.col(f"{own}_line.{c}").alias(c) for c in line],
                    F.col(f"{other}_line.k").alias("a_k"))

    me, there = ("id", "th"), ("a_id", "a_th")
    return looked_up(sized.where("own_n <= s_n"), me, there, "f", "m") \
        .unionByName(looked_up(sized.where("own_n > s_n"), there, me, "m", "f"))


def _further(lines: DataFrame, first: DataFrame, done: DataFrame, rare: int, moved_words: int) -> list[DataFrame]:
    """Alignments of what the first ones, ``done``, left over: a table for each round."""
    left = done.where(F.size("left") > 0).select("id", "th", F.explode("left").alias("key"))
    if left.isEmpty():
        return []
    left = stored(left, "lines-left")
    own = left.select("id", "th").distinct()
    near = lines.join(own, lines["id"].eqNullSafe(own["id"]) & (lines["th"] == own["th"]), "left_semi")
    near = stored(near.join(first.select("key", "n"), "key").dropDuplicates(["id", "th", "key"]), "lines-near")
    out = []
    while True:
        holders = left.groupBy("key").agg(F.min(F.struct("id", "th")).alias("a"), F.count("*").alias("m")).where("m > 1") \
            .select("key", F.col("a.id").alias("a_id"), F.col("a.th").alias("a_th"))
        self = F.col("id").eqNullSafe(F.col("a_id")) & (F.col("th") == F.col("a_th"))
        left = stored(left.join(holders, "key", "left")
                      .withColumn("todo", F.when(F.col("a_th").isNull() | self, 2).otherwise(1)), "lines-todo")
        pairs = left.where("todo = 1").select("id", "th", "a_id", "a_th").distinct()
        if pairs.isEmpty():
            return out
        todo = left.select(F.col("id").alias("l_id"), F.col("th").alias("l_th"), F.col("key").alias("l_key"), "todo")
        links = _shared_lines(near, pairs) \
            .join(todo, F.col("id").eqNullSafe(F.col("l_id")) & (F.col("th") == F.col("l_th")) & (F.col("key") == F.col("l_key")), "left") \
            .withColumn("todo", F.coalesce("todo", F.lit(0)))
        out.append(stored(_alignments(links, rare, moved_words), "line-alignments"))
        left = out[-1].select("id", "th", F.explode("left").alias("key"))


def _removals(aligned: DataFrame, block_words: int) -> DataFrame:
    """Per document with aligned lines: ``drop`` (a flag for each line) and its partners' ids."""
    out = "id long, th long, drop array<boolean>, partners array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, h, own in zip(*(c.to_pylist() for c in b.columns)):
                gone = _blocks({x["k"]: x["words"] for x in own}, block_words)
                if gone:
                    lost = [x for x in own if x["k"] in gone]
                    flags = np.zeros(max(x["pos"] for x in lost) + 1, bool)
                    flags[[x["pos"] for x in lost]] = True
                    rows.append((i, h, flags.tolist(), sorted({x["partner"] for x in lost} - {None})))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.bool_()), pa.list_(pa.int64()))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                             names=["id", "th", "drop", "partners"])

    return aligned.mapInArrow(run, out)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE,
                block_words: int = BLOCK_WORDS, moved_words: int = MOVED_WORDS, out: str = "dedup") -> DataFrame:
    """``docs`` with cleaned texts, plus a struct ``out``: ``n_removed`` lines
    and ``partners`` (ids of the earlier documents that hold them)."""
    docs = docs.drop(out)
    th = F.xxhash64(F.col(f"`{text_col}`"))
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), th.alias("th"), F.col(f"`{text_col}`").alias("text"))
    lines = stored(_lines(narrow), "lines")
    first = lines.groupBy("key").agg(F.min(F.struct("id", "th", "k")).alias("a"), F.count("*").alias("n")) \
        .where("n > 1").select("key", F.col("a.id").alias("a_id"), F.col("a.th").alias("a_th"),
                               F.col("a.k").alias("a_k"), F.col("n").cast("int").alias("n"))
    # Stored, so that the join has exchanges of its own on both sides and the
    # adaptive plan may split the rows of a very common line.
    first = stored(first, "line-holders")
    links = lines.join(first, "key").where(~(F.col("id").eqNullSafe(F.col("a_id")) & (F.col("th") == F.col("a_th"))))
    done = stored(_alignments(links.withColumn("todo", F.lit(1)), rare, moved_words), "line-alignments")
    aligned, rounds = done.select("id", "th", "aligned"), _further(lines, first, done, rare, moved_words)
    if rounds:
        for more in rounds:
            aligned = aligned.union(more.select("id", "th", "aligned"))
        aligned = aligned.groupBy("id", "th").agg(F.flatten(F.collect_list("aligned")).alias("aligned"))
    gone = _removals(aligned, block_words) \
        .select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("drop").alias("__drop"),
                F.col("partners").alias("__partners"))
    joined = docs.join(gone, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__id")) & (th == F.col("__th")), "left")
    kept = F.array_join(F.filter(F.split(F.col(f"`{text_col}`"), "\n", -1),
                                 lambda x, i: ~F.coalesce(F.get(F.col("__drop"), i), F.lit(False))), "\n")
    n = F.when(F.col("__drop").isNull(), 0).otherwise(F.size(F.filter(F.col("__drop"), lambda x: x)))
    struct = F.struct(n.cast("long").alias("n_removed"),
                      F.coalesce("__partners", F.array().cast("array<bigint>")).alias("partners"))
    cols = [F.when(F.col("__drop").isNull(), F.col(f"`{c}`")).otherwise(kept).alias(c) if c == text_col
            else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*cols, struct.alias(out))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read_table(spark, sf_dir, "documents", "doc_id", "text")) \
        .select("doc_id", "dedup.n_removed", "dedup.partners", "text")
