import random

from eventlens.llm.line_dedup import (BLOCK_WORDS, _blocks, _shared_lines, align, aligned_lines, dedup_lines, increasing,
                                      line_rows, removed_lines)


def brute_increasing(v):
    best = [1] * len(v)
    for i in range(len(v)):
        best[i] += max((best[j] for j in range(i) if v[j] < v[i]), default=0)
    return max(best, default=0)


def test_longest_increasing_run():
    r = random.Random(1)
    for _ in range(200):
        v = r.sample(range(50), r.randrange(12))
        got = increasing(v)
        assert [v[i] for i in got] == sorted(v[i] for i in got) and len(got) == brute_increasing(v)


def test_alignment_keeps_order_and_prefers_rare_anchors():
    assert align([0, 1, 2, 3], [True] * 4) == [0, 1, 2, 3]
    assert align([5, 0, 1, 2], [False, True, True, True]) == [1, 2, 3]
    # frequent lines go by the rare one, though alone they would make the longer run
    assert align([7, 8, 9, 1], [False, False, False, True]) == [3]
    r = random.Random(2)
    for _ in range(200):
        v = r.sample(range(20), r.randrange(12))
        got = align(v, [r.random() < 0.5 for _ in v])
        assert [v[i] for i in got] == sorted({v[i] for i in got})


def test_moved_lines_count_only_in_long_blocks():
    rows = [("a", k, k, 6, 2) for k in range(3)]
    assert removed_lines(rows) == {0, 1, 2}
    swapped = [("a", 5, 0, 30, 2), ("a", 0, 1, 6, 2), ("a", 1, 2, 6, 2)]
    assert removed_lines(swapped) == {0, 1, 2}  # the moved line is long enough
    swapped[0] = ("a", 5, 0, 10, 2)
    assert removed_lines(swapped) == {1, 2}
    assert removed_lines([("a", 0, 0, 4, 2)]) == set()  # a short block stays


def brute(rows):
    """The same rules on all documents in a driver loop, further partners included."""
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    docs, holders = {}, {}
    for i, h, t in rows:
        docs[key((i, h))] = t
        for k, *_ in line_rows(t or ""):
            holders[k] = holders.get(k, 0) + 1
    own = {d: {k: (n, pos, w) for k, pos, n, w in line_rows(t or "")} for d, t in docs.items()}
    first = {}
    for d in sorted(docs):
        for k in own[d]:
            first.setdefault(k, d)

    def hits(d, a, keys):
        n = aligned_lines([(a, own[a][k][0], own[d][k][0], own[d][k][2], holders[k]) for k in keys])
        return {k for k in keys if own[d][k][0] in n}

    aligned, left = {}, {}
    for d in docs:
        later = [k for k in own[d] if first[k] != d]
        aligned[d] = set()
        for a in {first[k] for k in later}:
            aligned[d] |= hits(d, a, [k for k in later if first[k] == a])
        left[d] = set(later) - aligned[d]
    while True:
        again = {}
        for d, keys in left.items():
            for k in keys:
                again.setdefault(k, []).append(d)
        partners = {}
        for k, ds in again.items():
            for d in ds:
                if d != min(ds):
                    partners.setdefault(d, {}).setdefault(min(ds), set()).add(k)
        if not partners:
            break
        now = {}
        for d, todo in partners.items():
            found = set().union(*[hits(d, a, [k for k in own[d] if k in own[a]]) for a in todo]) & left[d]
            aligned[d] |= found
            now[d] = set().union(*todo.values()) - found
        left = now
    out = {}
    for d, t in docs.items():
        gone = _blocks({own[d][k][0]: own[d][k][2] for k in aligned[d]}, BLOCK_WORDS)
        drop = {pos for n, pos, _ in own[d].values() if n in gone}
        out[d] = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in drop)
    return out


def check(spark, df, id_col="doc_id"):
    from pyspark.sql import functions as F
    rows = [(r[0], r[1], r[2]) for r in df.select(id_col, F.xxhash64("text"), "text").collect()]
    want = brute(rows)
    key = lambda i, h: (i is not None, i or 0, h)
    got = dedup_lines(df.withColumn("h0", F.xxhash64("text")), id_col).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == want[key(r[id_col], r.h0)]
    return got


def test_against_brute_force(spark, docs):
    got = check(spark, docs)
    assert sum(r.dedup.n_removed for r in got) > 0


def test_odd_documents(spark, odd_docs):
    got = check(spark, odd_docs)
    # a repeated row is no earlier document; another text of its id is
    assert {r.dedup.n_removed for r in got if r.doc_id == 7 and r.text} == {0}


def test_a_line_in_every_document_makes_one_link_each(spark):
    passage = "\n".join(f"shared line number {k} of a long passage" for k in range(8))
    df = spark.createDataFrame([(i, f"own words of document {i} stand here\n{passage}\nend {i}") for i in range(300)], "doc_id long, text string")
    got = {r.doc_id: r for r in check(spark, df)}
    assert got[0].dedup.n_removed == 0 and passage in got[0].text
    assert all(got[i].dedup.n_removed == 8 and list(got[i].dedup.partners) == [0] for i in range(1, 300))


def test_exact_copies_after_a_document_with_their_lines_in_reverse(spark):
    one, two, three = ("a first shared line of nine words stands here", "the second shared line has seven words", "a third line of six words")
    texts = [f"{two}\n{one}\nown words of the start", f"{one}\n{two}", f"{one}\n{two}", f"{two}\n{one}", f"{one}\n{two}\n{three}",
             f"{three}\n{two}\n{one}", f"{three}\n{two}\n{one}", f"{one}\n{two}\n{three}"]
    rows = [(None if i == 0 else i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text in (one, two)  # out of order against the only earlier document
    assert got[2].text == got[3].text == "" and got[2].dedup.n_removed == 2
    assert set(got[2].dedup.partners) == {1} and got[4].text == three
    assert got[6].text == got[7].text == ""  # copies of 5 and 4, whatever these kept


def test_further_partners_against_brute_force(spark):
    """Documents of shared lines in many orders, with copies and parts of them: several rounds."""
    r = random.Random(6)
    lines = [f"shared line {k} with " + " ".join("abcdefgh"[:2 + k % 7]) for k in range(9)]
    texts = []
    for i in range(60):
        some = r.sample(lines, r.randrange(2, 9))
        own = [f"line {j} of document {i} alone" for j in range(r.randrange(3))]
        texts.append(r.choice(texts) if texts and r.random() < 0.3 else "\n".join(own + some))
    got = check(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {len(x.dedup.partners) for x in got} > {0, 1, 2}


def test_pairs_are_met_from_the_shorter_document(spark):
    near = spark.createDataFrame([(1, 1, k, k, k, 5, 2) for k in range(200)] + [(2, 2, k, 9 - k, 9 - k, 5, 2) for k in (3, 5, 900)]
                                 + [(None, 3, 5, 0, 0, 5, 2)], "id long, th long, key long, pos int, k int, words int, n int")
    pairs = spark.createDataFrame([(2, 2, 1, 1), (1, 1, 2, 2), (1, 1, None, 3), (None, 3, 2, 2)], "id long, th long, a_id long, a_th long")
    got = sorted(repr((x.id, x.a_id, x.key, x.k, x.a_k)) for x in _shared_lines(near, pairs).collect())
    want = [(2, 1, 3, 6, 3), (2, 1, 5, 4, 5), (1, 2, 3, 3, 6), (1, 2, 5, 5, 4), (1, None, 5, 5, 0), (None, 2, 5, 0, 4)]
    assert got == sorted(map(repr, want))


def test_a_line_in_order_with_no_earlier_document_stays(spark):
    body = [f"line number {k} of a common body text" for k in range(6)]
    rows = [(i, "\n".join([*body[:i], "a line that is moved about", *body[i:]])) for i in (0, 2, 4, 6)]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame([*rows, (9, rows[2][1])], "doc_id long, text string")).collect()}
    assert [got[i] for i in (2, 4, 6)] == ["a line that is moved about"] * 3 and got[9] == ""


def test_empty_table(no_docs):
    assert dedup_lines(no_docs).count() == 0
