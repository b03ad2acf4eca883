"""Join-side sizing: broadcast only behind a measured size.

The small side of the event joins (the returns table, per-ticker bounds) is an
aggregate whose size is bounded by (tickers x trading days), not by the event
volume. We still never assume it: the side is materialised once in the shared
checkpoint folder (which also cuts its lineage), its rows and bytes are added
up by one partial aggregation over it, and it is broadcast only under both
bounds. Beyond them the same join runs as a shuffle join, where AQE splits
skewed partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.session import materialize

# ~1M rows x ~100 B per returns row is ~100 MB per executor: the upper end of
# what is reasonable to ship to every executor. Wide rows (texts) hit the byte
# bound first.
DEFAULT_MAX_BROADCAST_ROWS = 1_000_000
DEFAULT_MAX_BROADCAST_BYTES = 256 * 1024 * 1024


def _row_bytes(df: DataFrame) -> F.Column:
    """Approximate in-memory size of a row: 8 per field, and the bytes of
    texts and of nested values (as JSON)."""
    parts = [F.lit(8 * len(df.columns))]
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)))
    return reduce(lambda a, b: a + b, parts)


def measured_size(df: DataFrame) -> tuple[int, int]:
    """``(rows, approximate bytes)``; tasks send one partial sum each."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(_row_bytes(df)).alias("b")).first()
    return int(r["n"]), int(r["b"] or 0)


def sized_side(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
               strategy: str = "auto", max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Prepare the small side of a join.

    ``auto``: materialise, measure rows and bytes, broadcast when both fit;
    ``shuffle``: never broadcast (no action is run); ``prepared``: ``df``
    already went through ``sized_side`` (it keeps its broadcast hint), use it
    as is. Project the side before: what is not needed is stored all the same.
    """
    if strategy in ("shuffle", "prepared"):
        return df
    if strategy != "auto":
        raise ValueError(f"unknown join strategy {strategy!r}")
    side = materialize(df)
    rows, size = measured_size(side)
    if rows <= max_rows and size <= max_bytes:
        return F.broadcast(side)
    return side


def balance(df: DataFrame, key: str, min_partitions: int | None = None) -> DataFrame:
    """Spread a text-heavy scan that has fewer splits than the cluster has
    cores: hash-repartitioned on ``key`` (deterministic, so a retried task
    after executor loss gets the same rows). A scan with a split per core is
    returned as is. Only planning is done here, no job runs."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target, key) if df.rdd.getNumPartitions() < target else df
