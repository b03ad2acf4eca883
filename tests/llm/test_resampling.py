import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from eventlens.llm.resampling import GainPlanes, bucket_gains, gumbel, lowest_drawn, resample
from llm_helpers import brute_words


def brute(docs, target, max_run=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    """The contract, read literally: ``docs`` are (id, text) rows."""
    def found(text):
        w = brute_words(text)
        runs = [" ".join(w[k:k + n]) for n in range(1, max_run + 1) for k in range(len(w) - n + 1)]
        return [zlib.crc32(x.encode()) % buckets for x in runs]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(found(text))
    for text in target:
        t.update(found(text))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)}
    rows = []
    for i, text in docs:
        f = found(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(brute_words(text))])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(repr, (tuple(r[:5]) for r in rows)))


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("kw", [{}, {"max_run": 3, "buckets": 64, "min_words": 5, "percent": 60}, {"percent": 0}, {"percent": 100}])
def test_same_as_brute_force_on_odd_documents(spark, odd_docs, kw):
    target = ["the of and alpha", None, "", "gamma delta gamma"]
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    got = resample(odd_docs, spark.createDataFrame([(t,) for t in target], "text string"), **kw)
    assert rows_of(got) == brute(docs, target, **kw)


def test_same_as_brute_force_on_documents(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])
    assert rows_of(resample(docs, bench)) == want


def test_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "text string")
    assert resample(no_docs, none).collect() == []
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert rows_of(resample(odd_docs, none)) == brute(docs, [])


def test_planes_give_exact_sums():
    r = np.random.default_rng(3)
    for gains in (r.integers(-30_000, 30_000, 500), np.zeros(500, int), np.full(500, -1), np.full(500, 7), np.full(500, -8)):
        counts = r.integers(0, 3, (9, 500)) * r.integers(0, 900, (9, 500))
        counts[4] = 0
        assert (GainPlanes(gains).sums(counts) == counts @ gains).all()


def test_target_words_gain_and_the_draw_is_keyed():
    gains = bucket_gains(np.array([100, 100, 0]), np.array([0, 50, 0]))
    assert gains[1] > 0 > gains[0]
    assert gumbel(2024, 5) == gumbel(2024, 5) != gumbel(2025, 5)
    draws = [gumbel(1, i) for i in range(4000)]
    assert abs(sum(draws) / 4000 - 577) < 80  # mean of the Gumbel distribution, in thousandths


def test_lowest_drawn_score():
    counts = [(5, 2), (9, 1), (7, 3)]
    assert [lowest_drawn(counts, n) for n in range(7)] == [None, 9, 7, 7, 7, 5, 5]
    assert lowest_drawn([], 0) is None


def test_a_hot_text_and_ties(spark):
    r = random.Random(2)
    docs = [(i, "same words here " * 8 if i % 3 else " ".join(r.choice("abcdefgh") for _ in range(30))) for i in range(300)]
    docs += [docs[0], docs[1]]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows_of(resample(df, spark.createDataFrame([("a b c",)], "text string"))) == brute(docs, ["a b c"])
