"""The whole pipeline against a brute-force version of its five stages."""

import numpy as np

import corpus_pipeline
from eventlens.llm.decontam import WORDS, least_score, make_items, smith_waterman
from test_line_dedup import brute as brute_lines
from test_quality_rules import brute_kept
from test_simhash import brute_components, brute_print

SF = "/root/testdata/sf0.001"


def brute_leak(made, text):
    """Whether any item aligns well enough with the whole text."""
    words = np.array([made.number.get(w, 0) for w in WORDS.findall(text.lower())])
    for w in made.words:
        least = least_score(np.array([len(w)]))[0]
        if 2 * np.isin(words, w).sum() >= least and smith_waterman(w[None, :], words[None, :])[0][0] >= least:
            return True
    return False


def brute_pipeline(rows, bench):
    docs = {i: t or "" for i, t in rows if brute_kept(t)}
    clean = brute_lines([(i, 0, t) for i, t in docs.items()])
    docs = {i: clean[True, i, 0] for i in docs}
    ids = sorted(docs)
    groups = brute_components([brute_print(docs[i]) for i in ids])
    docs = {ids[k]: docs[ids[k]] for k in sorted(set(groups))}
    made = make_items(bench)
    return {i: t for i, t in docs.items() if not brute_leak(made, t)}


def test_pipeline_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert len({i for i, _ in rows}) == len(rows)
    want = brute_pipeline(rows, bench)
    out = corpus_pipeline.run(spark, SF).collect()
    assert len(out) == len(want) < len(rows) and {r.doc_id: r.text for r in out} == want
    assert all(r.lossless and len(r.pieces) for r in out if r.text)
