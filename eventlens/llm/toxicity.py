r"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams.

Features of a text, each counted once: words, pairs of neighbouring words and
pairs with one word between them (skip-grams), hashed to ``1 << BITS`` slots.
Words are runs of letters and digits, lower-cased. FTRL-proximal learns with a
rate of its own for each slot and an L1 penalty that leaves most slots at zero,
so the weights that go to the executors are the few non-zero ones.

Training rows are a bounded sample: of the labelled rows, the ``TRAIN_ROWS``
with the smallest hash of their id (all of them, if there are fewer). Their
features are made in parallel; one task learns from them, in order of that
hash, ``EPOCHS`` times. It streams them from a sort that Spark may spill, so it
holds the model and one batch, however long the texts are. Sample and order depend on ids alone, so a retried task
learns the same weights. Scoring is one pass over all rows and whole texts.

Defined results: a null or empty text has no features and scores by the bias
alone; a text repeated scores the same; labels that are null, or whose document
is missing, do not count; a document with several labels is toxic if one says
so; a null id is never a training row and never held out; without training rows every score is 0;
an empty table gives an empty result; other columns pass through untouched,
but one named like the score is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.llm.common import read_table, stored, worker_state

BITS = 22
TRAIN_ROWS = 20_000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 4.0, 1.0, 4.0, 0.01
TOXIC_AT = 0.7

WORDS = re.compile(r"\w+")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _Hashes(dict):
    """Word -> 64-bit hash; forgets all when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def features(text: str, hashes: dict[str, int], bits: int = BITS) -> np.ndarray:
    """Distinct slots of a text's features, sorted."""
    words = WORDS.findall(text.lower())
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    h = np.concatenate([h, h[:-1] * _M1 + h[1:] * _M2, h[:-2] * _M2 + h[2:] * _M3])
    return np.unique((h * _M1) >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """FTRL-proximal logistic regression on sets of slots; slot ``size`` is the bias."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.size, self.alpha, self.beta, self.l1, self.l2 = size, alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / rate)

    def learn(self, slots: np.ndarray, label: int, weight: float = 1.0) -> None:
        at = np.append(slots, self.size)
        w = self.weights(at)
        g = weight * (1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label)
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          rows: int = TRAIN_ROWS, bits: int = BITS, epochs: int = EPOCHS) -> dict[int, float]:
    """Non-zero weights by slot (the bias under ``1 << bits``); ``labels`` has the ids that may be learned from."""
    chosen = (labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
              .groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(F.col(f"`{label_col}`").cast("int")).alias("y"))
              .withColumn("order", F.xxhash64("id")).orderBy("order", "id").limit(rows))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    joined = texts.join(F.broadcast(chosen), "id")  # at most `rows` narrow rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_state("toxicity-hashes", _Hashes)
        for b in batches:
            slots = [features(t or "", hashes, bits).astype(np.uint32).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("order"), b.column("id"), b.column("y"), pa.array(slots, pa.binary())],
                                             names=["order", "id", "y", "slots"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = stored(joined.select("order", "id", "y", "text").mapInArrow(extract, f"order long, id {kind}, y int, slots binary"),
                  "toxicity-features")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl(1 << bits)
        for b in batches:  # rows of the first epoch, then of the next one
            for y, slots in zip(b.column("y"), b.column("slots")):
                model.learn(np.frombuffer(slots.as_buffer(), np.uint32).astype(np.int64), y.as_py())
        at = np.flatnonzero(np.abs(model.z) > model.l1)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(model.weights(at))], names=["slot", "w"])

    again = made.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    learned = again.coalesce(1).sortWithinPartitions("epoch", "order", "id", "slots").mapInArrow(learn, "slot long, w double")
    return {r["slot"]: r["w"] for r in learned.collect()} if not made.isEmpty() else {}


def score(docs: DataFrame, weights: dict[int, float], text_col: str = "text", out: str = "score", bits: int = BITS) -> DataFrame:
    """``docs`` plus the probability ``out`` that a text is toxic."""
    docs = docs.drop(out)
    where = docs.columns.index(text_col)
    slots = np.array(sorted(k for k in weights if k < 1 << bits), np.int64)
    values = np.array([weights[k] for k in slots.tolist()])
    bias, trained = weights.get(1 << bits, 0.0), bool(weights)
    sent = docs.sparkSession.sparkContext.broadcast((slots, values))
    schema = T.StructType(docs.schema.fields + [T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_state("toxicity-hashes", _Hashes)

        def dense() -> np.ndarray:
            w = np.zeros(1 << bits, np.float32)
            at, v = sent.value
            w[at] = v
            return w

        w = dense()
        for b in batches:
            s = np.array([w[features(t, hashes, bits)].sum(dtype=np.float64) if t else 0.0
                          for t in b.column(where).to_pylist()], np.float64) + bias
            p = 1.0 / (1.0 + np.exp(-np.clip(s, -35, 35))) if trained else np.zeros(len(s))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, out])

    return docs.mapInArrow(run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    labels = read_table(spark, sf_dir, "labels", "doc_id", "toxic")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    scored = score(docs, train(docs, labels.where(~held_out)))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                         F.when(F.col("score") >= TOXIC_AT, 1).otherwise(0).alias("predicted"))
