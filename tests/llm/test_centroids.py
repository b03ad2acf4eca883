import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from eventlens.llm.centroids import (NARROW, OP11_SQL, Lookup, cluster_sql, cluster_vectors, distances, make_cells, nearest,
                                     op11_clusters, pack_cells, to_cells, unpack_cells, whole_number)

INF, NAN = math.inf, math.nan


def brute(rows, dims, k=8, rounds=10, seed="3", scale=1024):
    """The contract, read literally, in Python integers."""
    kept = [(i, [whole_number(x, scale) for x in v], v) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))
    cent = [v for _, v, _ in order[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [min((dist(v, c), n) for n, c in enumerate(cent)) for _, v, _ in kept]

    for _ in range(rounds if kept else 0):
        own = [n for _, n in assign()]
        for n in range(len(cent)):
            members = [v for (_, v, _), m in zip(kept, own) if m == n]
            if members:
                cent[n] = [sum(col) // len(members) for col in zip(*members)]
    return sorted(((i, n, min(d, 2**63 - 1)) for (i, _, _), (d, n) in zip(kept, assign())), key=repr), cent


def table(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, id long, key long, cells string, now int, cluster int")


def run(spark, rows, dims, kind="double", **kw):
    got = cluster_vectors(table(spark, [(*r, 1, 2, "x", 3, 4) for r in rows], kind).repartition(3), dims=dims, **kw)
    return sorted((tuple(r) for r in got.assigned.collect()), key=repr), got.centroids


def some(n, dims, seed, spread=1.0):
    r = random.Random(seed)
    return [(i, [round(r.gauss(i % 3, spread), 4) for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize("bits, k", [(6, 8), (3, 4)])
def test_same_as_brute_force(spark, bits, k):
    rows = some(120, 5, bits)
    assert run(spark, rows, 5, bits=bits, k=k) == brute(rows, 5, k=k)


def test_odd_vectors(spark):
    rows = some(25, 3, 1) + [(100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 2.0]), (104, [1.0, NAN, 2.0]),
                             (105, [INF, 1.0, 1.0]), (106, [1.0, 1.0, -INF]), (None, [0.5, 0.5, 0.5]), (None, None),
                             (7, [0.0, -0.0, 1e-300]), (7, [0.0, 0.0, 0.0]), (8, [0.25] * 3), (8, [0.25] * 3), (108, [1.0] * 4)]
    assert run(spark, rows, 3) == brute(rows, 3)
    assert run(spark, [], 3) == ([], []) and run(spark, rows[25:28], 3) == ([], [])
    assert run(spark, rows[:2], 3) == brute(rows[:2], 3)  # fewer vectors than centroids


def test_huge_components_are_exact(spark):
    rows = some(12, 2, 2) + [(50, [4e4, 1.0]), (51, [-5e6, 3.0]), (52, [1e30, -1e30]), (53, [1.7e308, 0.0]), (54, [3e5, 3e5])]
    assert run(spark, rows, 2, rounds=3) == brute(rows, 2, rounds=3)
    assert whole_number(1.7e308) == int(1.7e308) * 1024 and whole_number(-0.0001) == -1


def test_ties_go_to_the_smaller_number_and_a_hot_vector(spark):
    rows = [(i, [float(i % 2), 1.0]) for i in range(60)] + [(100 + i, [3.0, 1.0]) for i in range(40)]
    assert run(spark, rows, 2, k=6) == brute(rows, 2, k=6)


def test_query_and_its_sql_on_floats(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = c.execute(OP11_SQL)
    names = [d[0] for d in want.description]
    df = op11_clusters(spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def test_sql_on_odd_vectors():
    rows = some(25, 3, 1) + [(100, None), (102, [1.0, 2.0]), (103, [1.0, None, 2.0]), (104, [1.0, NAN, 2.0]), (105, [INF, 1.0, 1.0])]
    c = duckdb.connect()
    c.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    c.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    got = sorted(r[:3] for r in c.execute(cluster_sql(dims=3)).fetchall())
    assert sorted(got, key=repr) == brute(rows, 3)[0]


def test_intervals_hold_every_distance_and_decide_many():
    r = np.random.default_rng(1)
    v = np.concatenate([r.normal(m, 60, (400, 16)) for m in (-300, 0, 300)]).astype(np.int64)
    cells = make_cells(v.min(axis=0), v.max(axis=0), v.mean(axis=0), v.std(axis=0))
    own = unpack_cells(pack_cells(to_cells(cells, v), 6), 16, 6)
    assert (own == to_cells(cells, v)).all()
    for d in range(16):
        assert (cells.low[d][own[:, d]] <= v[:, d]).all() and (v[:, d] <= cells.high[d][own[:, d]]).all()
    cent = [v[k].tolist() for k in (3, 500, 900, 901)]
    look = Lookup(cells, cent)
    low, high = look.intervals(own)
    true = distances(v, cent)
    less = ((v - (np.array(cent).sum(axis=0) // 4)) ** 2).sum(axis=1)[:, None]  # to the common point
    assert (low <= true - less).all() and (true - less <= high).all()
    got, want = look.decide(own), nearest(v, cent)
    assert (got[got >= 0] == want[got >= 0]).all() and (got >= 0).mean() > 0.6


@pytest.mark.parametrize("bits", range(1, 9))
def test_cells_pack_in_any_width(bits):
    raw = np.random.default_rng(bits).integers(0, 1 << bits, (7, 11)).astype(np.uint8)
    packed = pack_cells(raw, bits)
    assert packed.shape[1] == -(-11 * bits // 8) and (unpack_cells(packed, 11, bits) == raw).all()


def test_wide_centroids_use_no_table():
    cells = make_cells(np.zeros(2, np.int64), np.ones(2, np.int64), np.zeros(2), np.ones(2))
    assert (Lookup(cells, [[0, NARROW]]).decide(np.zeros((3, 2), np.uint8)) == -1).all()


def test_no_full_vector_is_shuffled_and_cells_are_scanned_alone(spark, monkeypatch):
    from eventlens.llm import centroids
    plans = []
    kept = centroids._corrections
    monkeypatch.setattr(centroids, "_corrections", lambda needed, *a: plans.append(
        needed._jdf.queryExecution().executedPlan().toString()) or kept(needed, *a))
    run(spark, some(50, 4, 9), 4, rounds=2)
    for plan in plans:
        assert plan.count("Exchange") == 1 and "Broadcast" not in plan
        head = plan[:plan.index("Exchange")]
        assert "full" not in plan[plan.index("Exchange"):].split("FileScan")[1].split("ReadSchema")[1].split("\n")[0]
        assert "SortMergeJoin" in head
