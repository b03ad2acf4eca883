import zlib
from collections import Counter

from eventlens.llm.hilbert import op4_hilbert_shards

SF = "/root/testdata/sf0.001"


def test_the_whole_query(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = op4_hilbert_shards(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    n = Counter(r.shard for r in rows)
    assert set(n) == set(range(8)) and max(n.values()) - min(n.values()) <= 1
    for k in n:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(n[k]))
