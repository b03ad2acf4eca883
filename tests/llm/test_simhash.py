import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from eventlens.llm.components import connected_components
from eventlens.llm.simhash import fingerprint, near_duplicates, near_links, one_of_each, trie_links


def brute_components(prints, distance=3):
    label = list(range(len(prints)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= distance:
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(prints))]


def brute_print(text, n=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\x0b", " ").replace("\x0c", " ")
             .replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def near_prints(seed, bases=30, each=12):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(bases)]
    flip = lambda: sum(1 << b for b in r.sample(range(64), r.randrange(6)))
    return sorted({b ^ flip() for b in base for _ in range(each)} | {0, 2**64 - 1})


def signed(x):
    return x - 2**64 if x >> 63 else x


@pytest.mark.parametrize("seed", range(8))
def test_trie_join(seed):
    prints = near_prints(seed)
    assert trie_links(np.zeros(len(prints), np.int64), np.array(prints, np.uint64)).tolist() == brute_components(prints)


def test_trie_join_keeps_groups_apart():
    group = np.array([1, 1, 2, 2, 3])
    assert trie_links(group, np.array([0, 1, 0, 1, 0], np.uint64)).tolist() == [0, 0, 2, 2, 4]


@pytest.mark.parametrize("bucket", [1024, 6])
def test_links_have_all_components_at_any_bucket_size(spark, bucket):
    prints = near_prints(99)
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    root = {r.node: r.root for r in connected_components(near_links(df, bucket=bucket), "a", "b").collect()}
    got = [root.get(signed(p), signed(p)) for p in prints]
    want = brute_components(prints)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_a_dense_cloud_is_cut_again_and_stays_one_component(spark):
    r = random.Random(7)
    centre = r.getrandbits(64)
    cloud = {centre} | {centre ^ sum(1 << b for b in r.sample(range(64), k)) for k in (1, 2, 3) for _ in range(60)}
    far = {r.getrandbits(64) for _ in range(20)}
    df = spark.createDataFrame([(signed(p),) for p in cloud | far], "fp long")
    links = near_links(df, bucket=40).collect()  # every block of the cloud is above the bucket size
    root = {x.node: x.root for x in connected_components(spark.createDataFrame(links), "a", "b").collect()}
    assert len({root.get(signed(p), signed(p)) for p in cloud}) == 1
    assert not {signed(p) for p in far - cloud} & {x for link in links for x in link}
    assert len(links) < 64 * len(cloud)  # forests of the buckets, not all pairs


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5), (None, 3), (2, 1)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, **{k: 1000 for k in range(1001, 1200)}}


def test_fingerprints_and_groups_of_odd_documents(odd_docs):
    rows = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    prints = [brute_print(t) for _, t in rows]
    assert prints == [fingerprint(t.encode()) for _, t in rows]
    comp = brute_components(prints)
    least = {}
    for (i, _), c in zip(rows, comp):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    want = sorted(repr((i, signed(p), least[c])) for (i, _), p, c in zip(rows, prints, comp))
    assert sorted(repr((r.id, r.fp, r.component_id)) for r in near_duplicates(odd_docs).collect()) == want


def test_one_document_of_each_group_stays(odd_docs, docs):
    for df in (odd_docs, docs):
        groups = near_duplicates(df).select("root", "component_id").distinct().collect()
        kept = one_of_each(df)
        assert kept.columns == df.columns
        rows = kept.collect()
        assert len(rows) == len(groups)
        assert sorted(repr(r.doc_id) for r in rows) == sorted(repr(g.component_id) for g in groups)


def test_many_copies_are_one_group(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("the same text in all of these rows of the table").alias("text"))
    assert one_of_each(df).collect()[0].doc_id == 0 and one_of_each(df).count() == 1


def test_empty_table(no_docs):
    assert near_duplicates(no_docs).count() == 0 and one_of_each(no_docs).count() == 0
