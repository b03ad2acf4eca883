"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised by its cumulative distribution over all rows (at
most ``2 ** BITS`` buckets, cut between distinct values, order-preserving), the
buckets' place on a Hilbert curve is the sort key, and the sorted rows are cut
into runs of equal count. Neighbours on the curve are neighbours in every
dimension, so the files of a shard have narrow minima and maxima in all of
them, and readers skip files for filters on any of the dimensions.

Only narrow rows (id, size, key) are sorted; ``write_shards`` moves the texts.

Defined results: null metadata lies before all values; a null text has no
bytes; a null id sorts first; rows that tie in key, id and text hash get
neighbouring slots in any order; an empty table gives an empty result; columns
of the added names (curve, shard, slot) are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.common import read_table
from eventlens.llm.prefix_sums import prefix_sums

BITS = 5
SHARDS = 8
DIMENSIONS = ("lang", "source", "size")


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of points, one row each (Skilling's transform, vectorised)."""
    x = [points[:, k].astype(np.int64).copy() for k in range(points.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations, from the coarsest cell on
        low = q - 1
        for k in range(len(x)):
            on = (x[k] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(on, low, swap)
            x[k] ^= swap
        q >>= 1
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = (out << 1) | (((v ^ flip) >> b) & 1)
    return out


def cuts(df: DataFrame, col: str, buckets: int) -> list[tuple]:
    """``(value, bucket)`` where a new bucket begins: at most ``buckets - 1``,
    from the exact counts of all rows. A value lies in one bucket, and a bucket's
    number is its share of the rows below, so the values spread over the whole axis."""
    counts = df.where(F.col(f"`{col}`").isNotNull()).groupBy(F.col(f"`{col}`").alias("v")).agg(F.count("*").alias("n"))
    before, total = prefix_sums(counts, ["v"], "before", "n")
    if not total:
        return []
    bucket = F.expr(f"before * {buckets} div {total}")
    first = before.groupBy(bucket.alias("b")).agg(F.min("v").alias("v"))
    return sorted((r["v"], r["b"]) for r in first.where("b > 0").collect())


def quantised(col: Column, at: list[tuple]) -> Column:
    """Bucket of a value plus 1, or 0 for null."""
    if not at:
        return F.when(col.isNull(), 0).otherwise(1)
    passed = F.size(F.filter(F.array(*[F.lit(v) for v, _ in at]), lambda c: c <= col))
    return F.when(col.isNull(), 0).otherwise(F.get(F.array(F.lit(1), *[F.lit(b + 1) for _, b in at]), passed))


def shard_rows(df: DataFrame, order_cols: list[str], dims: tuple[str, ...] = DIMENSIONS,
               shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``df`` plus ``curve`` (Hilbert index), ``shard`` and ``slot``. Shards
    have counts at most one apart; slots count from 0 within a shard."""
    df = df.drop("curve", "shard", "slot")
    at = {d: cuts(df, d, (1 << bits) - 1) for d in dims}
    names = df.columns

    @F.pandas_udf("long")
    def curve(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in it:
            yield pd.Series(hilbert_index(np.column_stack([c.to_numpy() for c in cols]), bits))

    keyed = df.withColumn("curve", curve(*[quantised(F.col(f"`{d}`"), at[d]).cast("int") for d in dims]))
    ranked, total = prefix_sums(keyed, ["curve", *order_cols], "__rank")
    shard = F.expr(f"cast(__rank * {shards} div {max(total, 1)} as int)")
    first = F.expr(f"(cast(shard as long) * {total} + {shards - 1}) div {shards}")  # least rank of the shard
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("__rank") - first) \
        .select(*[f"`{c}`" for c in names], "curve", "shard", "slot")


def write_shards(docs: DataFrame, places: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write ``docs`` along the curve, one folder per shard; ``places`` has (id, shard, slot) for unique ids."""
    (docs.join(places.select(id_col, "shard", "slot"), id_col).repartitionByRange("shard", "slot")
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    narrow = docs.select("doc_id", "lang", "source", (F.octet_length(raw) + 1).cast("long").alias("size"),
                         F.crc32(raw).alias("text_crc32"))
    placed = shard_rows(narrow, ["doc_id", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
