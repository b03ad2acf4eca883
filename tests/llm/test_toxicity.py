import zlib

import numpy as np
import pytest

from eventlens.llm.toxicity import Ftrl, features, op3_toxicity, score, train, _Hashes

LABELS = "id long, toxic int, text string"


def test_features_are_words_pairs_and_skips():
    h = _Hashes()
    one = set(features("a b c", h).tolist())
    assert len(one) == 6  # a, b, c, a b, b c, a _ c
    assert set(features("A  b, C a b", h).tolist()) > one
    assert len(features("", h)) == 0 and len(features("x", h)) == 1


def test_l1_keeps_chance_features_at_zero():
    rng, m = np.random.default_rng(1), Ftrl(1000)
    for k in range(2000):
        y = int(k % 4 == 0)
        m.learn(np.unique(np.append(rng.integers(10, 1000, 12), 3 if y else 4)), y)
    w = m.weights(np.arange(1001))
    assert w[3] > 1 and abs(w[10:1000]).max() < w[3] / 2
    assert (w[10:1000] == 0).mean() > 0.5


def test_odd_documents_and_labels(spark, odd_docs, no_docs):
    toxic = spark.createDataFrame([(i, f"you vile worm {i} " + "good words " * (i % 5)) for i in range(40)], "id long, text string")
    clean = spark.createDataFrame([(i, f"kind thing {i} " + "good words " * (i % 5)) for i in range(100, 200)], "id long, text string")
    docs = toxic.union(clean)
    labels = spark.createDataFrame([(i, int(i < 100), "x") for i in [*range(40), *range(100, 200)]]
                                   + [(1, None, "x"), (None, 1, "x"), (5000, 1, "x"), (1, 0, "x"), (1, 1, "x")], LABELS)
    w = train(docs, labels, "id", bits=16)
    got = {r.id: r.score for r in score(docs, w, bits=16).collect()}
    assert min(got[i] for i in range(40)) > 0.7 > 0.3 > max(got[i] for i in range(100, 200))
    rows = score(odd_docs.withColumnRenamed("score_", "score"), w, bits=16).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    assert score(no_docs, w, bits=16).count() == 0
    assert train(docs, labels.limit(0), "id") == {}
    assert {r.score for r in score(docs, {}).collect()} == {0.0}
    assert train(docs, labels, "id", bits=16) == w  # learned again, the same


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op3_toxicity(spark, sf).collect() if r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    positive = [r for r in held if labels[r.doc_id]]
    negative = [r for r in held if not labels[r.doc_id]]
    assert sum(r.predicted for r in positive) / len(positive) > 0.55
    assert sum(r.predicted for r in negative) / len(negative) < 0.01
    assert np.mean([r.score for r in positive]) > np.mean([r.score for r in negative]) + 0.4
    pairs = sum((p.score > n.score) + 0.5 * (p.score == n.score) for p in positive for n in negative)
    assert pairs / (len(positive) * len(negative)) == pytest.approx(1, abs=0.12)


def plain_ftrl(rows, epochs, alpha=4.0, beta=1.0, l1=4.0, l2=0.01):
    """The update rule coordinate by coordinate; ``rows``: (set of features, label) in order."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return ((l1 if z[i] > 0 else -l1) - z[i]) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for features_, y in rows:
            at = [*features_, "bias"]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in at:
                step = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
                z[i] = z.get(i, 0.0) + g - step * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if weight(i) != 0.0}


def test_learning_is_the_plain_rule_in_the_order_of_the_hash(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["vile", "worm", "kind", "sun", "tree", "road"], 6)), int(i % 3 == 0)) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "id long, toxic int")
    got = train(docs, labels, "id", bits=18, epochs=3)
    from pyspark.sql import functions as F
    order = [r.id for r in labels.orderBy(F.xxhash64("id"), "id").collect()]
    text, label, h = {i: t for i, t, _ in rows}, {i: y for i, _, y in rows}, _Hashes()
    want = plain_ftrl([(features(text[i], h, 18).tolist(), label[i]) for i in order], 3)
    want = {(1 << 18 if i == "bias" else i): w for i, w in want.items()}
    assert set(got) == set(want) and all(got[i] == pytest.approx(w, rel=1e-9) for i, w in want.items())


def test_a_null_id_is_not_held_out(spark, tmp_path):
    spark.createDataFrame([(None, "a b"), (1, None), (2, "x y")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r.doc_id: r.held_out for r in op3_toxicity(spark, str(tmp_path)).collect()}
    assert rows[None] is False and set(rows) == {None, 1, 2}
