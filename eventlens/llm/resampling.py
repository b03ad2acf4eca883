r"""Target-distribution importance resampling by bit-sliced aggregation.

Features are runs of ``1..max_run`` consecutive words (see ``words.py``; joined
by one space, repeats counted), each in the bucket ``crc32 mod BUCKETS``. With
s of the S features of the corpus and t of the T of the target texts in a
bucket, its gain is ``floor(1000 * ln((t+1)(S+B) / ((s+1)(T+B))))``, in doubles.
A document's weight is the floored mean of the gains of its features.

1. One pass over the texts cuts them into words by numpy and stores the buckets
   of each document's features, two bytes each (no text).
2. Tasks add up their buckets; a row per bucket and task is shuffled, and the
   ``BUCKETS`` counts are what the driver gets of the corpus.
3. The documents' bucket counts become planes of ``BUCKETS`` bits: bit b of
   plane i says whether the count of bucket b has the bit ``2^i``. The gains
   become planes as well, in two's complement, so the last one counts
   negatively. The sum of a document's gains is the sum over pairs of planes of
   ``+-2^(i+j) * popcount(document plane i AND gain plane j)``: integers only,
   so the weights are exact whatever the order of work.
4. The score adds a Gumbel draw keyed by the id. The draw is the highest
   ``floor(percent * N / 100)`` scores of the N documents of enough words:
   counts by score give the lowest score that is drawn, and only documents from
   there on are range partitioned and numbered (``prefix_sums``).

Counts by score are what the driver gets of the documents: gains are bounded by
the logarithm of the corpus, so scores are some ten thousand whole numbers.

Defined results: a null or empty text has no features, weight 0, and is never
drawn; a null id draws by the empty text and stands after other ids on ties;
repeated rows draw the same score and get ranks in a row; without target texts
the gains follow the corpus alone; an empty table gives an empty result; other
columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.common import read_table, stored
from eventlens.llm.prefix_sums import prefix_sums
from eventlens.llm.words import Words, split_words, text_slices, word_crc32

BUCKETS = 10_000
MAX_RUN = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
ROWS = 64  # documents whose planes are made together

FEATURES = "id {kind}, n_words long, buckets binary"


def run_buckets(words: Words, max_run: int = MAX_RUN, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every run of up to ``max_run`` words of a text, text by text,
    and where each text's buckets begin."""
    text = np.repeat(np.arange(len(words.first) - 1), words.counts)
    found, owner = [word_crc32(words) % np.uint32(buckets)], [text]
    for n in range(2, max_run + 1):
        at = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1:]) if len(text) >= n else np.zeros(0, np.int64)
        # a run's words with single spaces are a text of their own; its crc32 is that of one long word
        size = words.stop - words.start
        width = sum(size[at + k] for k in range(n)) + n - 1
        stop = np.cumsum(width)
        data, to = np.full(int(stop[-1]) if len(at) else 0, 0x20, np.uint8), stop - width
        for k in range(n):
            m = size[at + k]
            step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            data[np.repeat(to, m) + step] = words.data[np.repeat(words.start[at + k], m) + step]
            to = to + m + 1
        found.append(word_crc32(Words(data, stop - width, stop, words.first)) % np.uint32(buckets))
        owner.append(text[at])
    text = np.concatenate(owner)
    order = np.argsort(text, kind="stable")
    return np.concatenate(found)[order].astype("<u2"), np.searchsorted(text[order], np.arange(len(words.first)))


def text_features(texts: DataFrame, max_run: int = MAX_RUN, buckets: int = BUCKETS) -> DataFrame:
    """``(id, n_words, buckets)`` of a table ``(id, text)``: the buckets of all
    features of a text, as little-endian 16-bit integers."""
    if buckets > 1 << 16:
        raise ValueError("buckets are stored in two bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole, 1):
                words = split_words(b.column(1))
                found, first = run_buckets(words, max_run, buckets)
                at = pa.py_buffer(found.tobytes())
                ends = (first * 2).astype(np.int64)
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(ends.tobytes()), at])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words.counts, pa.int64()), held.cast(pa.binary())],
                                                 names=["id", "n_words", "buckets"])

    return texts.mapInArrow(run, FEATURES.format(kind=texts.schema[0].dataType.simpleString()))


def bucket_totals(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column(0):
                if x.is_valid:
                    total += np.bincount(np.frombuffer(x.as_buffer(), "<u2"), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["b", "n"])

    out = np.zeros(buckets, np.int64)
    for b, n in features.select("buckets").mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n")).collect():
        out[b] = n  # one row per bucket
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of target to corpus, a bucket each."""
    n, cs, ts = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (cs + n) / ((s + 1) * (ts + n))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _planes(bits: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 as rows of 64-bit words."""
    raw = np.packbits(bits.astype(bool), axis=-1)
    pad = -raw.shape[-1] % 8
    return np.ascontiguousarray(np.pad(raw, [(0, 0)] * (raw.ndim - 1) + [(0, pad)])).view(np.uint64)


class GainPlanes:
    """Signed gains as planes of bits; the last plane has the sign of two's complement."""

    def __init__(self, gains: np.ndarray):
        n = max(int(gains.max(initial=0)), -int(gains.min(initial=0)) - 1, 0).bit_length() + 1
        self.planes = [_planes(((gains >> j) & 1)) for j in range(n)]
        self.power = [1 << j for j in range(n - 1)] + [-(1 << (n - 1))]
        self.buckets = len(gains)

    def sums(self, counts: np.ndarray) -> np.ndarray:
        """Sum of the gains of each row of bucket counts."""
        out, top = np.zeros(len(counts), np.int64), counts.max(axis=1, initial=0)
        for i in range(int(top.max(initial=0)).bit_length()):
            rows = np.flatnonzero(top >> i)
            own = _planes((counts[rows] >> i) & 1)
            for plane, power in zip(self.planes, self.power):
                out[rows] += (power << i) * np.bitwise_count(own & plane).sum(axis=1, dtype=np.int64)
        return out


def gumbel(seed: int, doc_id: int | None) -> int:
    """Whole thousandths of the Gumbel draw of an id."""
    key = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(features: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """``(id, n_words, n_features, weight, score)`` of stored features."""
    kind = features.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = GainPlanes(gains)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                own = [np.frombuffer(x.as_buffer(), "<u2") for x in b.column(2)]
                n = np.array([len(x) for x in own], np.int64)
                row = np.repeat(np.arange(len(own)), n) * gain.buckets
                flat = np.concatenate(own).astype(np.int64)
                counts = np.bincount(row + flat, minlength=len(own) * gain.buckets).reshape(len(own), gain.buckets)
                weight = gain.sums(counts) // np.maximum(n, 1)  # rounds down
                draw = np.array([gumbel(seed, i) for i in b.column(0).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, (n, weight, weight + draw))],
                                                 names=["id", "n_words", "n_features", "weight", "score"])

    return features.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long, score long")


def lowest_drawn(counts: list[tuple[int, int]], n: int) -> int | None:
    """The least score among the ``n`` highest; None if none is drawn."""
    seen = 0
    for score, k in sorted(counts, reverse=True):
        seen += k
        if seen >= n > 0:
            return score
    return None


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             max_run: int = MAX_RUN, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT,
             seed: int = SEED) -> DataFrame:
    """``(id, n_features, weight, score, rank)`` of all documents; ``rank`` is
    null for those that are not drawn."""
    pick = lambda df, i, t: df.select(i.alias("id"), F.col(f"`{t}`").alias("text"))
    features = stored(text_features(pick(docs, F.col(f"`{id_col}`"), text_col), max_run, buckets), "features")
    wanted = bucket_totals(text_features(pick(target, F.lit(0), target_col), max_run, buckets), buckets)
    scored = stored(weigh(features, bucket_gains(bucket_totals(features, buckets), wanted), seed), "scores")
    able = scored.where(F.col("n_words") >= min_words)
    by_score = [tuple(r) for r in able.groupBy("score").count().collect()]  # a row per whole score
    n = percent * sum(k for _, k in by_score) // 100
    low = lowest_drawn(by_score, n)
    drawn = able.where(F.lit(False) if low is None else F.col("score") >= low)
    last = F.col("id").isNull()
    numbered, _ = prefix_sums(drawn.select(F.col("id"), "n_words", "n_features", "weight", "score",
                                           (-F.col("score")).alias("__high"), last.alias("__last")),
                              ["__high", "__last", "id", "n_features", "weight", "n_words"], "__before")
    ranked = numbered.withColumn("rank", F.when(F.col("__before") < n, F.col("__before") + 1))
    rest = scored.where(F.lit(True) if low is None else (F.col("n_words") < min_words) | (F.col("score") < low))
    out = ["n_features", "weight", "score"]
    return (ranked.select(F.col("id").alias(id_col), *out, "rank")
            .unionByName(rest.select(F.col("id").alias(id_col), *out, F.lit(None).cast("long").alias("rank"))))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents", "doc_id", "text"),
                    read_table(spark, sf_dir, "benchmark", "text"))


#: crc32 of a word's bytes: per byte an xor and eight shifts (marked by -1), folded over a list.
_CRC_SQL = """(-1 - list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, octet_length(encode(w)) + 1), lambda i:
        list_prepend(('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT, [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) & 4294967295"""

OP12_SQL = f"""
WITH texts AS (
  SELECT 1 AS side, row_number() OVER () AS k, doc_id, text FROM documents
  UNION ALL SELECT 2, row_number() OVER (), NULL, text FROM benchmark),
words AS (
  SELECT side, k, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM texts),
bucket_of AS MATERIALIZED (SELECT w, ({_CRC_SQL}) % {BUCKETS} AS b FROM (SELECT DISTINCT w FROM words)),
counts AS MATERIALIZED (SELECT side, k, b, count(*) AS n FROM words JOIN bucket_of USING (w) GROUP BY ALL),
sides AS (SELECT b, sum(n) FILTER (side = 1) AS s, sum(n) FILTER (side = 2) AS t FROM counts GROUP BY b),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS all_s, coalesce(sum(t), 0)::DOUBLE AS all_t FROM sides),
gains AS (
  SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + {BUCKETS}) /
                            ((coalesce(s, 0) + 1)::DOUBLE * (all_t + {BUCKETS}))))::BIGINT AS g
  FROM sides, totals),
sums AS (SELECT k, sum(n)::BIGINT AS n, sum(n * g)::BIGINT AS total FROM counts JOIN gains USING (b) WHERE side = 1 GROUP BY k),
weighed AS (
  SELECT doc_id, coalesce(n, 0) AS n_features,
         CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END::BIGINT AS weight,
         ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM texts LEFT JOIN sums USING (k) WHERE side = 1),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weighed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS r,
         count(*) FILTER (n_features >= {MIN_WORDS}) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= {MIN_WORDS} AND r <= {PERCENT} * able // 100 THEN r END::BIGINT AS rank
FROM placed
"""
