"""Exclusive prefix sums over a total order of any size.

A window without a partition key would sort everything in one task. Here the
rows are range partitioned and sorted, each task numbers its own rows, and the
tasks' totals (one row per partition, the only thing the driver sees) are added
as a base. The numbered rows are stored before the totals are read, as a range
partition may be cut elsewhere when it is computed again.

The names ``__<out>_part``, ``__<out>_local`` and ``__base`` are taken inside; the
caller's columns must not have them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.llm.common import stored


def prefix_sums(df: DataFrame, order: list[str], out: str, weight: str | None = None) -> tuple[DataFrame, int]:
    """``df`` plus ``out``: the sum of ``weight`` (long; None: rows) over all
    rows before this one in the order; and the sum over all rows. Rows that
    tie in the order stand in any order among themselves."""
    part, local = f"__{out}_part", f"__{out}_local"
    names = df.columns
    at = names.index(weight) if weight else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, pid = 0, TaskContext.get().partitionId()
        for b in batches:
            w = np.ones(b.num_rows, np.int64) if at is None else b.column(at).to_numpy()
            ends = before + np.cumsum(w)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(b.num_rows, pid, np.int32)), pa.array(ends - w)],
                names=[*names, part, local])
            before = int(ends[-1]) if b.num_rows else before

    schema = T.StructType(df.schema.fields + [T.StructField(part, T.IntegerType()), T.StructField(local, T.LongType())])
    numbered = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "prefix-sums")
    own = F.col(f"`{weight}`") if weight else F.lit(1)
    totals = sorted(numbered.groupBy(part).agg(F.max(F.col(local) + own)).collect())
    base, at_sum = [], 0
    for pid, n in totals:
        base.append((pid, at_sum))
        at_sum += n
    bases = df.sparkSession.createDataFrame(base, f"`{part}` int, __base long")  # a row per partition
    return (numbered.join(F.broadcast(bases), part).withColumn(out, F.col(local) + F.col("__base"))
            .select(*[f"`{c}`" for c in names], out)), at_sum
