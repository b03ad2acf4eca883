r"""Centroid clustering over a VA-file.

Vectors of whole numbers (``floor(scale * x)``) are clustered by rounds of
assignment and exact floored means. The VA-file keeps a few bits per
dimension of each vector: the number of the cell that its component lies in.

1. One scan finds the first centroids (smallest keyed hash of the id), one
   range and spread of each dimension; cells are equal steps over
   ``SPREAD`` deviations to both sides, the outer ones reach to the range's ends.
2. Vectors and their cells are written once, bucketed by row key. The cells are
   a column of their own, so a scan of the VA-file reads ``bits / 32`` of the
   vectors' bytes.
3. A round scans the VA-file. Per dimension and cell a lookup table has
   the least and the greatest that a component of this cell adds to the distance of
   each centroid; summed up, they give an interval per centroid. (All
   distances are taken less that to one common point, which changes none of
   their differences and makes the intervals many times narrower.) Where the
   lowest interval overlaps no other, the vector is assigned. Only for the others, and for those
   whose cluster has changed since the last round, the full vector is fetched by
   a join on the row key. Their keys are shuffled to the buckets; the full vectors are
   read where they lie and never shuffled.
4. Sums are kept and only corrected by vectors that change their cluster: each
   task sends one row per cluster, added up as whole numbers of any size, and the
   ``k`` sums are all that the driver sees. The cluster of the round before is
   computed again from its centroids, so no state is written between rounds
   and a lost task is simply run again.
5. A last scan assigns all vectors and fetches them all for their distances.

Rounds stop early when the centroids stand still; more would change nothing.

Defined results: vectors that are null, of another length, or with a null, NaN or
infinite component are left out; ties go to the smaller centroid number; a null id has the
empty text as its decimal; among equal hashes the smaller components come first; repeated
rows are vectors like others; with fewer than ``k`` vectors there are as many
centroids; components of 2^25 and more are computed exactly, without cells;
distances and inertias beyond a 64-bit integer are given as its largest; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.common import read_table, stored
from eventlens.session import scratch_path

DIMS = 64
CLUSTERS = 8
ROUNDS = 10
SEED = "3"
SCALE = 1024
BITS = 6
SPREAD = 2.5
NARROW = 1 << 25  # components below it have cells and 64-bit arithmetic
LARGEST = (1 << 63) - 1
ROWS = 2000  # at a time
MAX_BUCKETS = 20_000
UNKNOWN, NEW = -1, -2


class Clustering(NamedTuple):
    """``(id, cluster, distance)`` of all vectors, and the final centroids."""

    assigned: DataFrame
    centroids: list[list[int]]


class Cells(NamedTuple):
    """Cells per dimension: inner edges, and the least and greatest component of each cell."""

    bits: int
    edges: np.ndarray
    low: np.ndarray
    high: np.ndarray


def make_cells(low: np.ndarray, high: np.ndarray, mean: np.ndarray, deviation: np.ndarray, bits: int = BITS) -> Cells:
    steps = np.linspace(-SPREAD, SPREAD, (1 << bits) - 1)
    edges = np.ceil(mean[:, None] + deviation[:, None] * steps).astype(np.int64)
    edges = np.clip(edges, low[:, None], high[:, None] + 1)
    first, last = np.hstack([low[:, None], edges]), np.hstack([edges - 1, high[:, None]])
    return Cells(bits, edges, first, np.maximum(first, last))


def to_cells(cells: Cells, vectors: np.ndarray) -> np.ndarray:
    out = np.empty(vectors.shape, np.uint8)
    for d in range(vectors.shape[1]):
        out[:, d] = np.searchsorted(cells.edges[d], vectors[:, d], "right")
    return out


def pack_cells(cells: np.ndarray, bits: int) -> np.ndarray:
    """A row of bytes per vector, ``bits`` bits per cell."""
    return np.packbits(np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - bits:].reshape(len(cells), -1), axis=1)


def unpack_cells(raw: np.ndarray, dims: int, bits: int) -> np.ndarray:
    own = np.unpackbits(raw, axis=1)[:, : dims * bits].reshape(len(raw), dims, bits)
    return np.packbits(np.pad(own, ((0, 0), (0, 0), (8 - bits, 0))), axis=2)[:, :, 0]


class Lookup:
    """Distance intervals of one set of centroids by cell."""

    def __init__(self, cells: Cells, centroids: list[list[int]]):
        self.k = len(centroids)
        self.usable = all(abs(x) < NARROW for c in centroids for x in c)
        if not self.usable:
            return
        c = np.array(centroids, np.int64)
        origin = c.sum(axis=0) // self.k
        move = (c - origin).T[:, None, :]  # dimension, cell, centroid
        at_low = move * move - 2 * (cells.low - origin[:, None])[:, :, None] * move
        at_high = move * move - 2 * (cells.high - origin[:, None])[:, :, None] * move
        self.table = np.concatenate([np.minimum(at_low, at_high), np.maximum(at_low, at_high)], axis=2)

    def intervals(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance of each vector to each centroid, less the one to the common point."""
        total = np.zeros((len(cells), 2 * self.k), np.int64)
        for d in range(cells.shape[1]):
            total += self.table[d][cells[:, d]]
        return total[:, : self.k], total[:, self.k:]

    def decide(self, cells: np.ndarray) -> np.ndarray:
        """Cluster of each vector, UNKNOWN where intervals overlap."""
        if not self.usable:
            return np.full(len(cells), UNKNOWN, np.int32)
        low, high = self.intervals(cells)
        open_ = low <= high.min(axis=1, keepdims=True)
        return np.where(open_.sum(axis=1) == 1, open_.argmax(axis=1), UNKNOWN).astype(np.int32)


def distances(vectors: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances, vector by centroid; of Python integers where 64 bits may not do."""
    c = np.array(centroids, object)
    if vectors.dtype != object and all(abs(x) < NARROW for x in c.ravel()):
        c = c.astype(np.int64)
    else:
        vectors = vectors.astype(object)
    return np.stack([((vectors - own) ** 2).sum(axis=1) for own in c], axis=1)


def nearest(vectors: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    d = distances(vectors, centroids)
    return np.array([min(range(len(r)), key=r.__getitem__) for r in d.tolist()], np.int32) if d.dtype == object \
        else d.argmin(axis=1).astype(np.int32)


def whole_number(x: float, scale: int = SCALE) -> int:
    """Exact ``floor(scale * x)``; of large x without the product in doubles."""
    return math.floor(scale * x) if abs(x) < 2.0**52 else math.floor(x) * scale


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def _whole(x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers of the narrow rows (0 in the others), and which rows are wide."""
    with np.errstate(over="ignore", invalid="ignore"):
        y = np.floor(scale * x)
        wide = ~(np.abs(y) < NARROW).all(axis=1)
    y[wide] = 0
    return y.astype(np.int64), wide


def _spread(rows: DataFrame, dims: int, scale: int) -> list[np.ndarray]:
    """Least, greatest, mean and deviation of each dimension over the narrow vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.full(dims, LARGEST), np.full(dims, -LARGEST)
        total, square = np.zeros(dims), np.zeros(dims)
        for b in batches:
            y, wide = _whole(_vectors(b.column(0), dims), scale)
            y = y[~wide]
            if len(y):
                n, low, high = n + len(y), np.minimum(low, y.min(axis=0)), np.maximum(high, y.max(axis=0))
                total, square = total + y.sum(axis=0), square + (y.astype(float) ** 2).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([*map(pa.array, (np.arange(dims), np.full(dims, n), low, high, total, square))],
                                             names=["d", "n", "low", "high", "total", "square"])

    found = (rows.mapInArrow(run, "d long, n long, low long, high long, total double, square double").groupBy("d")
             .agg(F.sum("n").alias("n"), F.min("low"), F.max("high"), F.sum("total"), F.sum("square")).orderBy("d").collect())
    if not found:  # no narrow vector
        return [np.zeros(dims, np.int64), np.zeros(dims, np.int64), np.zeros(dims), np.zeros(dims)]
    n, low, high, total, square = (np.array([r[k] for r in found]) for k in range(1, 6))
    mean = total / n
    return [low, high, mean, np.sqrt(np.maximum(square / n - mean * mean, 0))]


def _bucketed(rows: DataFrame, cells: Cells, dims: int, scale: int) -> str:
    """Writes ``(key, id, cells, full, wide)`` in buckets of the key; the table's name. A
    wide vector has no cells, and its whole numbers as text."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            x = _vectors(b.column(1), dims)
            y, wide = _whole(x, scale)
            small = [r.tobytes() for r in pack_cells(to_cells(cells, y), cells.bits)]
            full = [r.tobytes() for r in y.astype("<i4")]
            for k in np.flatnonzero(wide).tolist():
                small[k], full[k] = None, ",".join(str(whole_number(v, scale)) for v in x[k].tolist()).encode()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + b.num_rows)), b.column(0), pa.array(small, pa.binary()),
                                              pa.array(full, pa.binary()), pa.array(wide)], names=["key", "id", "cells", "full", "wide"])
            at += b.num_rows

    spark, name = rows.sparkSession, f"va_file_{uuid.uuid4().hex}"
    tasks = max(rows.rdd.getNumPartitions(), 1)
    (rows.mapInArrow(run, f"key long, id {kind}, cells binary, full binary, wide boolean").repartition(min(tasks, MAX_BUCKETS), "key")
     .write.bucketBy(min(tasks, MAX_BUCKETS), "key").sortBy("key").option("path", scratch_path(spark, "va-file")).saveAsTable(name))
    return name


def _decided(va_file: DataFrame, cells: Cells, dims: int, now: list[list[int]], before: list[list[int]] | None) -> DataFrame:
    """``(key, was, now)`` by cells alone: clusters of the round before (NEW: none) and of this one."""
    tables = [Lookup(cells, c) if c else None for c in (before, now)]

    @F.pandas_udf("struct<was: int, now: int>")
    def decide(raw: pd.Series) -> pd.DataFrame:
        some = raw.notna().to_numpy()
        own = unpack_cells(np.frombuffer(b"".join(raw[some]), np.uint8).reshape(int(some.sum()), -1), dims, cells.bits)
        out = []
        for t in tables:
            got = np.full(len(raw), NEW if t is None else UNKNOWN, np.int32)
            if t is not None:
                got[some] = t.decide(own)
            out.append(got)
        return pd.DataFrame({"was": out[0], "now": out[1]})

    # "nondeterministic" keeps the plan from computing it again for a filter; the hint keeps to the buckets
    return va_file.select("key", decide.asNondeterministic()("cells").alias("c")).select("key", "c.was", "c.now")


def _fetched(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Full vectors of a batch (column ``full``) and their places: narrow ones, then wide ones."""
    wide = np.array(batch.column("wide"), bool) if batch.num_rows else np.zeros(0, bool)
    full = batch.column("full").to_pylist()
    for own in (np.flatnonzero(~wide), np.flatnonzero(wide)):
        if not len(own):
            continue
        if wide[own[0]]:
            out = np.empty((len(own), dims), object)
            for row, k in enumerate(own.tolist()):
                out[row] = [int(v) for v in full[k].split(b",")]
            yield out, own
        else:
            yield np.frombuffer(b"".join(full[k] for k in own.tolist()), "<i4").reshape(-1, dims).astype(np.int64), own


def _settled(batch: pa.RecordBatch, name: str, vectors: np.ndarray, own: np.ndarray, centroids: list[list[int]] | None) -> np.ndarray:
    """Clusters of fetched vectors; those that the cells left open by their exact distances."""
    out = batch.column(name).to_numpy()[own].copy()
    todo = np.flatnonzero(out == UNKNOWN)
    if len(todo):
        out[todo] = nearest(vectors[todo], centroids)
    return out


def _corrections(needed: DataFrame, dims: int, now: list[list[int]], before: list[list[int]] | None) -> list:
    """``(cluster, vectors, sums as text)``: what the sums of each cluster change by."""
    k = len(now)
    schema = "cluster int, n long, sums array<string>"

    def rows(n: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        some = [c for c in range(k) if n[c] or any(sums[c])]
        return pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array([int(n[c]) for c in some], pa.int64()),
             pa.array([[str(x) for x in sums[c]] for c in some], pa.list_(pa.string()))], names=["cluster", "n", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.full((k, dims), 0, object)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                for vectors, own in _fetched(b, dims):
                    was, to = _settled(b, "was", vectors, own, before), _settled(b, "now", vectors, own, now)
                    for c in range(k):
                        out, into = (was == c) & (to != c), (to == c) & (was != c)
                        n[c] += int(into.sum()) - int(out.sum())
                        if out.any() or into.any():
                            sums[c] = sums[c] + (vectors[into].sum(axis=0) - vectors[out].sum(axis=0)).astype(object)
        yield rows(n, sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.full((k, dims), 0, object)
        for b in batches:
            for c, m, own in zip(*(b.column(j).to_pylist() for j in range(3))):
                n[c] += m
                sums[c] = sums[c] + np.array([int(x) for x in own], object)
        yield rows(n, sums)

    return needed.mapInArrow(run, schema).repartition("cluster").mapInArrow(add, schema).collect()  # a row per cluster


def _first_centroids(rows: DataFrame, k: int, seed: str, scale: int) -> list[list[int]]:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    first = rows.select("v", F.sha2(text, 256).alias("h")).orderBy("h", "v").limit(k).collect()
    return [[whole_number(float(x), scale) for x in r.v] for r in first]


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS,
                    k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED, scale: int = SCALE, bits: int = BITS) -> Clustering:
    """Clusters of all vectors with ``dims`` finite components (see the module's text)."""
    if not 1 <= bits <= 8:
        raise ValueError("cells have 1 to 8 bits")
    spark = df.sparkSession
    v = F.col(f"`{vector_col}`")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).where((F.size(v) == dims) & finite)
    kind = rows.schema["id"].dataType.simpleString()
    now = _first_centroids(rows, k, seed, scale)
    if not now:
        return Clustering(spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long"), [])
    cells = make_cells(*_spread(rows.select("v"), dims, scale), bits)
    name = _bucketed(rows, cells, dims, scale)
    try:
        table = spark.table(name)
        va_file, full = table.select("key", "cells"), table.select("key", "id", "full", "wide")
        before, n, sums = None, np.zeros(len(now), np.int64), np.full((len(now), dims), 0, object)
        for _ in range(rounds):
            known = _decided(va_file, cells, dims, now, before)
            moved = known.where((F.col("was") != F.col("now")) | (F.col("now") == UNKNOWN)).hint("merge")
            for c, m, own in _corrections(moved.join(full.select("key", "full", "wide"), "key"), dims, now, before):
                n[c] += m
                sums[c] = sums[c] + np.array([int(x) for x in own], object)
            before = now
            now = [[int(s) // int(n[c]) for s in sums[c]] if n[c] else before[c] for c in range(len(before))]
            if now == before:
                break
        final = now

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    b = whole.slice(at, ROWS)
                    cluster, distance = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int64)
                    for vectors, own in _fetched(b, dims):
                        to = cluster[own] = _settled(b, "now", vectors, own, final)
                        for c in np.unique(to).tolist():
                            d = distances(vectors[to == c], [final[c]])[:, 0]
                            distance[own[to == c]] = np.minimum(d, LARGEST).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(cluster), pa.array(distance)],
                                                     names=[id_col, "cluster", "distance"])

        known = _decided(va_file, cells, dims, now, None).hint("merge")
        assigned = stored(known.join(full, "key").mapInArrow(run, f"`{id_col}` {kind}, cluster int, distance long"), "clusters")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay until the scratch folder goes
    return Clustering(assigned, now)


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cluster_vectors(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    sums = {r.cluster: int(r.s) for r in got.assigned.groupBy("cluster")
            .agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row per cluster
    rows = [(c, min(sums.get(c, 0), LARGEST), min(sum(sums.values()), LARGEST),
             hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(got.centroids)]
    more = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return got.assigned.join(F.broadcast(more), "cluster").select("vec_id", "cluster", "distance", *more.columns[1:])


def cluster_sql(dims: int = DIMS, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED, scale: int = SCALE) -> str:
    """DuckDB SQL for the query's rows: plain distances of all vectors to all centroids, round by round."""
    parts = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {dims})""",
             f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM
    (SELECT v, sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h FROM kept ORDER BY h, v LIMIT {k}))"""]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (
  SELECT r, min((d, c)) AS best FROM (
    SELECT kept.r, c{n}.c, list_sum(list_transform(list_zip(kept.v, c{n}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM kept, c{n}) GROUP BY r)""")
        if n < rounds:
            parts.append(f"""m{n} AS (
  SELECT c, list(m ORDER BY i) AS v FROM (
    SELECT c, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS m FROM (
      SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (
        SELECT best[2] AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept JOIN a{n} USING (r)) GROUP BY c, i)) GROUP BY c)""")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c, coalesce(m{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN m{n} USING (c))")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, best[2]::INTEGER AS cluster, best[1]::BIGINT AS distance,
       (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia, (sum(best[1]) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} USING (r) JOIN c{rounds} ON c = best[2]
"""


OP11_SQL = cluster_sql()
