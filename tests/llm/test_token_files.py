import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventlens.llm.token_counts import PrefixCounter, cut_for_budget, default_tokenizer, op9_token_counts, pack, prefix_counts, truncated, unpack
from eventlens.llm.token_files import Segment, WordEncoder, bits_for, make_segment, pack_ids, read_token_files, unpack_ids, write_token_files
from eventlens.session import scratch_path
from llm_helpers import odd_texts


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(default_tokenizer())
    return lambda s: t.encode(s, add_special_tokens=False).ids


def strings(n, size):
    r = random.Random(1)
    parts = ["a", "b", " ", "e'r", "'re", "\n", "\t", "<|endoftext|>", "l", "sé", "!", "1", "\x1c", "\0", "  ", "漢", ".", ","]
    return ["".join(r.choice(parts) for _ in range(size)) for _ in range(n)]


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001, np.uint32, endpoint=False)
    assert (unpack_ids(pack_ids(ids, bits), 1001, bits) == ids).all()
    assert len(pack_ids(ids, bits)) == -(-1001 * bits // 8)


def test_segment_random_access():
    rng = np.random.default_rng(3)
    docs = [(k if k % 4 else None, rng.integers(0, 50257, n).astype(np.uint32)) for k, n in enumerate([0, 5, 900, 1, 77, 4000])]
    s, flat = Segment(make_segment(docs, bits_for(50257), 256)), np.concatenate([x for _, x in docs])
    for a, b in [(0, len(flat)), (0, 0), (255, 257), (4000, 4983), (4982, 4983)]:
        assert (s.read(a, b) == flat[a:b]).all()
    assert s.docs["n"].tolist() == [len(x) for _, x in docs]


def test_chunks_give_the_library_ids(library):
    texts = odd_texts() + strings(500, 25)
    r = random.Random(6)
    white = [chr(c) for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 32, 0x85, 0xA0, 0x1680, 0x2000, 0x2005, 0x200A, 0x200B,
                              0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    texts += ["".join(r.choice(white + ["a", "é", "漢", ".", "1", "\u2020", "\u30a0"]) for _ in range(9)) for _ in range(3000)]
    enc = WordEncoder(default_tokenizer())
    column = pa.array(["left out", *texts, "left out"], pa.string()).slice(1, len(texts))
    for _ in range(2):  # the second time from the table
        ids, ends = enc.encode(column)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [library(t or "") for t in texts]
    enc.WORDS = 10  # forgets after each batch
    for k in range(0, len(texts), 700):
        ids, ends = enc.encode(column.slice(k, 700))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [library(t or "") for t in texts[k:k + 700]]
    assert enc.encode(pa.array([], pa.string()))[1].tolist() == [0]
    assert enc.encode(pa.array([None, ""], pa.string()))[1].tolist() == [0, 0, 0]


def test_files_against_brute_force(spark, odd_docs, library):
    path = scratch_path(spark, "test-token-files")
    write_token_files(odd_docs, path)
    got = sorted(((r.start, r.doc_id, list(r.ids), r.n_tokens) for r in read_token_files(spark, path).collect()), key=lambda x: x[0])
    want = sorted((r.doc_id is not None, r.doc_id or 0, library(r.text or "") + [0]) for r in odd_docs.collect())
    assert [x[1] for x in got] == [d if some else None for some, d, _ in want]
    assert sorted(map(repr, ((x[1], x[2]) for x in got))) == sorted(repr((d if some else None, ids)) for some, d, ids in want)
    at = 0
    for start, _, ids, n in got:
        assert start == at and n == len(ids)
        at += n
    digests = {r.start: r.ids_crc32 for r in read_token_files(spark, path, digest=True).collect()}
    assert digests == {s: zlib.crc32(np.array(ids, "<u4").tobytes()) for s, _, ids, _ in got}


def test_no_documents(spark, no_docs):
    path = scratch_path(spark, "test-token-files")
    write_token_files(no_docs, path)
    assert read_token_files(spark, path).count() == 0
    assert prefix_counts(no_docs).count() == 0


def test_every_prefix_has_its_exact_count(library):
    counter = PrefixCounter(default_tokenizer())
    texts = [(t or "")[:150] for t in odd_texts()] + strings(150, 14) + ["don're 've'll 's'r", "a  b\n\n\nc \n d\t\te   ", "x<|endoftext|>y <|endo"]
    for t, d in zip(texts, counter.batch(texts)):
        assert unpack(pack(d)).tolist() == [len(library(t[:i])) for i in range(len(t) + 1)], t


def test_counts_of_whole_texts_and_budgets(odd_docs, library):
    rows = truncated(prefix_counts(odd_docs.withColumnRenamed("id", "tokens_n")), 5).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        text = r.text or ""
        assert r.tokens_n == len(library(text))
        cut = cut_for_budget(bytes(r.tokens_prefixes), 5)
        if len(text) < 400:
            assert cut == max(i for i in range(len(text) + 1) if len(library(text[:i])) <= 5)
            assert (r.truncated or "") == text[:cut]


def test_wide_differences_are_kept():
    assert unpack(pack(np.array([1, -300, 40_000]))).tolist() == [0, 1, -299, 39_701]


def test_cut_of_a_budget_is_the_longest_prefix_within_it(spark, library):
    texts = ["", None, "  \n\n  a", "it're 'r 're", "你好世界 😀😀", "x" * 90, "one two three four five six", "<|endoftext|> a<|endoftext|>"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for budget in (0, 1, 3, 1000):
        rows = prefix_counts(df.withColumn("tokens_cut", F.lit("x")), budget=budget).collect()
        for r in rows:
            t = r.text or ""
            assert r.tokens_cut == max(k for k in range(len(t) + 1) if len(library(t[:k])) <= budget), (t, budget)
            assert r.tokens_cut == cut_for_budget(bytes(r.tokens_prefixes), budget)
    with pytest.raises(ValueError):
        prefix_counts(df, budget=-1)


def test_op9_cuts_the_texts_over_the_limit(spark, library, tmp_path):
    texts = {1: "a short text", 2: "many words in a long text " * 400, 3: None, 4: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op9_token_counts(spark, str(tmp_path)).collect():
        t = texts[r.doc_id] or ""
        assert r.n_tokens == len(library(t)) and r.over_limit == (len(library(t)) > 1024)
        if r.over_limit:
            assert len(library(t[:r.cut_chars])) <= 1024 < len(library(t[:r.cut_chars + 1]))
        else:
            assert r.cut_chars == len(t)
