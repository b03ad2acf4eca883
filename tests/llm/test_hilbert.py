import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.llm.hilbert import cuts, hilbert_index, op4_hilbert_shards, quantised, shard_rows, write_shards
from eventlens.llm.prefix_sums import prefix_sums
from eventlens.session import scratch_path


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_step_by_step(dims, bits):
    points = np.array(list(itertools.product(range(2**bits), repeat=dims)))
    h = hilbert_index(points, bits)
    assert sorted(h) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(h)], axis=0)).sum(axis=1) == 1).all()


def test_prefix_sums(spark):
    rows = [(k % 17, k) for k in range(1000)]
    df, total = prefix_sums(spark.createDataFrame(rows, "w long, k long").repartition(7), ["k"], "before", "w")
    assert total == sum(w for w, _ in rows)
    at = 0
    for r in sorted(df.collect(), key=lambda r: r.k):
        assert r.before == at
        at += r.w
    assert prefix_sums(spark.createDataFrame([], "k long"), ["k"], "n")[1] == 0


def test_cuts_are_the_exact_quantiles_of_all_rows(spark):
    values = [k * k % 101 for k in range(500)] + [None] * 20
    df = spark.createDataFrame([(v,) for v in values], "v long")
    some, at = sorted(v for v in values if v is not None), cuts(df, "v", 8)
    bucket = lambda v: sum(x < v for x in some) * 8 // len(some)
    want = sorted((min(v for v in some if bucket(v) == b), b) for b in {bucket(v) for v in some} - {0})
    assert at == want
    got = df.select("v", quantised(F.col("v"), at).alias("q")).collect()
    assert all(r.q == 0 if r.v is None else r.q == 1 + bucket(r.v) for r in got)


def test_shards_are_even_and_slots_gapless(spark, odd_docs, no_docs):
    df = odd_docs.withColumn("size", F.octet_length("text").cast("long")).withColumn("slot", F.lit(1)).drop("text")
    rows = shard_rows(df, ["doc_id"], shards=4).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    counts = [len(x) for x in by.values()]
    assert len(by) == 4 and max(counts) - min(counts) <= 1
    for x in by.values():
        assert sorted(r.slot for r in x) == list(range(len(x)))
    curve = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert curve == sorted(curve)
    assert shard_rows(no_docs.withColumn("size", F.lit(1)).drop("text"), ["doc_id"]).count() == 0


def test_query_and_files_prune_in_several_dimensions(spark):
    sf = "/root/testdata/sf0.01"
    placed = op4_hilbert_shards(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = placed.collect()
    assert len(rows) == docs.count()
    sizes = {r.doc_id: len((r.text or "").encode()) + 1 for r in docs.collect()}
    assert all(r.size == sizes[r.doc_id] for r in rows)
    path = scratch_path(spark, "test-shards")
    write_shards(docs, placed, path)
    back = spark.read.parquet(path)
    assert back.count() == docs.count()
    # Files of 16 rows along the curve: a filter on any dimension skips many of them (in a random order, next to none).
    files = back.groupBy("shard", F.floor(F.col("slot") / 16)).agg(
        *[f(c).alias(f"{n}_{c}") for c in ("lang", "source", "n_chars") for n, f in (("a", F.min), ("b", F.max))]).collect()
    for c, v, share in (("lang", "de", 0.6), ("source", "src7", 0.7), ("n_chars", 300, 0.7)):
        assert sum(r[f"a_{c}"] <= v <= r[f"b_{c}"] for r in files) < share * len(files), c
