import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventlens.llm.decontam import leaks
from eventlens.llm.line_dedup import dedup_lines
from eventlens.llm.quality_rules import judge
from eventlens.llm.queries import LLM_ORACLE, LLM_QUERIES
from eventlens.llm.simhash import near_duplicates
from eventlens.session import scratch_path

SF = "/root/testdata/sf0.01"


def norm(v):
    return str(v).lower() if isinstance(v, bool) else repr(v)


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_query_matches_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(LLM_ORACLE[name])
    names = [d[0] for d in want.description]
    rows = sorted([norm(v) for v in r] for r in want.fetchall())
    df = LLM_QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted([norm(v) for v in r] for r in df.select(*names).collect()) == rows


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 14))


def test_stages_one_by_one(spark):
    """Each stage on what the one before kept, against its operator's own result."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = scratch_path(spark, f"test-stage-{k}")
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        n = {r.doc_id: r.text for r in docs.collect()}
        got = {r.doc_id: r.text for r in out.collect()}
        if k == 0:
            assert set(got) == {r.doc_id for r in judge(docs).where("quality_kept").collect()}
        if k == 1:
            assert got == {r.doc_id: r.text for r in dedup_lines(docs).collect()} and len(got) == len(n)
            assert out.where("n_chars <> length(text)").count() == docs.where("n_chars <> length(text)").count()
        if k == 2:
            assert set(got) == {r.component_id for r in near_duplicates(docs).collect()}
        if k == 3:
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            bad = {r.doc_id for r in leaks(docs, bench).collect()}
            assert bad and set(got) == set(n) - bad
        if k == 4:
            assert set(got) == set(n) and out.where(~F.col("lossless")).count() == 0
        if k < 4:
            assert out.columns == columns
        if k != 1:
            assert all(got[i] == n[i] for i in got)
        seen.append(len(got))
        docs = out
    assert sorted(seen, reverse=True) == seen
    assert corpus_pipeline.run(spark, SF).count() == seen[-1]


def test_stages_on_odd_and_empty_documents(spark, odd_docs, no_docs):
    odd = odd_docs
    for docs in (odd, no_docs):
        n = docs.count()
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = scratch_path(spark, f"test-odd-{k}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
            assert docs.count() <= n
    for _, stage in corpus_pipeline.STAGES:  # each alone bears them too
        assert stage(spark, odd, SF).count() <= odd.count()
