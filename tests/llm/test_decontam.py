import random

import numpy as np
import pyarrow as pa

from eventlens.llm.decontam import (WORDS, find, item_blocks, least_score, leaks, make_items, passage_words, smith_waterman,
                                    without_leaks)

BENCH = "item_id long, text string, part int"


def brute_score(item, passage):
    h = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i, a in enumerate(item):
        for j, b in enumerate(passage):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if a == b and a else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
            best = max(best, h[i + 1][j + 1])
    return best


def test_smith_waterman():
    r = np.random.default_rng(4)
    item, passage = r.integers(0, 5, (40, 9)), r.integers(0, 5, (40, 17))
    score, _, _ = smith_waterman(item, passage)
    assert score.tolist() == [brute_score(a.tolist(), b.tolist()) for a, b in zip(item, passage)]


def items(n=30, seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    return [(k, " ".join(r.choice(vocabulary) for _ in range(r.randrange(14, 50)))) for k in range(n)], vocabulary, r


def test_exact_and_edited_copies_are_found_and_others_not(spark):
    bench, vocabulary, r = items()
    noise = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows, want = [], set()
    for k, text in bench:
        words = text.split()
        edited = [r.choice(vocabulary) if r.random() < 0.1 else w for w in words]
        del edited[len(edited) // 2]
        rows += [(3 * k, f"{noise(40)}. {text.title()}! {noise(30)}"), (3 * k + 1, f"{noise(300)} {' '.join(edited)} {noise(9)}"), (3 * k + 2, noise(400))]
        want |= {(3 * k, k), (3 * k + 1, k)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame([(*b, 1) for b in bench], BENCH)
    got = leaks(df, table).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want
    texts = dict(rows)
    for x in got:
        if x.doc_id % 3 == 0:
            assert x.score == 1.0
            words = WORDS.findall(texts[x.doc_id].lower())[x.first_word:x.last_word + 1]
            assert words == dict(bench)[x.item_id].split()
    assert {x.doc_id for x in without_leaks(df, table).collect()} == {i for i, _ in rows if i % 3 == 2}


def test_scores_against_whole_alignments(docs, spark):
    bench = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    made = make_items(bench)
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    got = find(made, texts)
    number = made.number
    for t, found in zip(texts, got):
        words = [number.get(w, 0) for w in WORDS.findall((t or "").lower())]
        want = {}
        for i, w in zip(made.ids, made.words):
            if 2 * sum(x in set(w.tolist()) for x in words) < least_score(np.array([len(w)]))[0]:
                continue  # too few words of the item for the score
            s, _, _ = smith_waterman(w[None, :], np.array([words]))
            if s[0] >= least_score(np.array([len(w)]))[0]:
                want[i] = round(float(s[0]) / (2 * len(w)), 6)
        assert {i: s for i, s, *_ in found} == want


def test_an_item_in_a_third_of_all_documents_keeps_its_seeds(spark):
    bench, vocabulary, r = items(3)
    df = spark.createDataFrame([(i, bench[0][1] if i % 3 == 0 else " ".join(r.choice(vocabulary) for _ in range(60))) for i in range(300)], "doc_id long, text string")
    got = leaks(df, spark.createDataFrame([(*b, 1) for b in bench], BENCH)).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(i, 0) for i in range(0, 300, 3)}


def test_an_edited_item_in_a_third_of_all_documents_is_found(spark):
    r = random.Random(8)
    words = [f"q{k}" for k in range(37)]
    # every fifth word is changed: most 3-grams stand nowhere, all others in every copy
    edited = " ".join("changed" if k % 5 == 2 else w for k, w in enumerate(words))
    noise = lambda n: " ".join(f"w{r.randrange(400)}" for _ in range(n))
    rows = [(i, f"{noise(20)} {edited} {noise(20)}" if i % 3 == 0 else f"{noise(60)} {' '.join(words[3:7])}") for i in range(300)]
    df, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, " ".join(words), 1)], BENCH)
    got = leaks(df, table).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(i, 0) for i in range(0, 300, 3)}
    assert {x.score for x in got} == {round((2 * 30 - 7) / 74, 6)}
    assert {x.doc_id for x in without_leaks(df, table).collect()} == {i for i in range(300) if i % 3}


def test_many_seeds_are_looked_at_in_parts(monkeypatch):
    bench, _, r = items(8)
    made = make_items(bench)
    texts = [" ".join(t for _, t in r.sample(bench, 3)) for _ in range(20)] + [None, ""]
    whole = find(made, texts)
    monkeypatch.setattr("eventlens.llm.decontam.CELLS", 50)
    assert find(made, texts) == whole and all(len(x) >= 3 for x in whole[:20])


def test_blocks_of_items_give_the_same(spark, docs):
    table = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    blocks = list(item_blocks(table, block_bytes=500))
    assert len(blocks) > 3
    texts = [r.text for r in docs.select("text").collect()]
    apart = [sorted({i for b in blocks for i, *_ in find(b, [t])[0]}) for t in texts]
    whole = next(item_blocks(table))
    assert apart == [sorted(i for i, *_ in find(whole, [t])[0]) for t in texts]


def test_odd_documents_and_items(spark, odd_docs):
    bench = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "two words", 1), (None, "line one is here line one is here", 1),
                                   (4, "a document without an id a document", 1), (4, "a document without an id a document", 1)], BENCH)
    got = leaks(odd_docs, bench).collect()
    assert {x.item_id for x in got} <= {None, 4} and {x.doc_id for x in got if x.item_id == 4} == {None}
    left = without_leaks(odd_docs, bench)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count() - len({x.doc_id for x in got})


def test_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], BENCH)
    some = spark.createDataFrame([(1, "one two three four", 1)], BENCH)
    assert leaks(odd_docs, none).count() == 0 and leaks(no_docs, some).count() == 0
    assert without_leaks(odd_docs, none).count() == odd_docs.count() and without_leaks(no_docs, some).count() == 0


def edited(r, words, rate, kind):
    """Words with that share of edits: changed, left out, with others between, or all of these."""
    out = []
    for w in words:
        do = r.choice(("change", "drop", "insert")) if kind == "mixed" else kind
        if r.random() >= rate:
            out.append(w)
        elif do == "change":
            out.append(f"new{r.randrange(10**6)}")
        elif do == "insert":
            out += [w, f"new{r.randrange(10**6)}"]
    return out


def test_recall_at_each_edit_rate_is_that_of_whole_alignments():
    """Common and rare words; every alignment that scores enough is found, at all rates."""
    r = random.Random(12)
    common = [f"c{k}" for k in range(12)]
    word = lambda: r.choice(common) if r.random() < 0.5 else f"w{r.randrange(3000)}"
    bench = [(k, " ".join(word() for _ in range(r.choice((8, 15, 40, 60, 120, 200))))) for k in range(60)]
    made = make_items(bench)
    true = made.words
    by_id = dict(zip(made.ids, true))
    for kind in ("change", "drop", "insert", "mixed"):
        for rate in (0.05, 0.1, 0.2, 0.3, 0.33, 0.4, 0.6, 0.9):
            texts, own = [], []
            for k, text in bench:
                texts.append(" ".join([word() for _ in range(r.randrange(40))] + edited(r, text.split(), rate, kind) + [word() for _ in range(30)]))
                own.append(k)
            got = [{i: s for i, s, *_ in m} for m in find(made, texts)]
            for text, k, m in zip(texts, own, got):
                w = by_id[k]
                flat = np.array([made.number.get(x, 0) for x in WORDS.findall(text)])
                score = int(smith_waterman(w[None, :], flat[None, :])[0][0])
                if score >= min(0.9 * len(w), 2 * len(w)) and score >= 12:  # a share of 0.45
                    assert m[k] == round(score / (2 * len(w)), 6)
                elif len(w) >= 12 and score < least_score(np.array([len(w)]))[0]:
                    assert k not in m


def test_every_third_word_changed_is_found():
    item = [f"t{k}" for k in range(60)]
    text = " ".join("x" if k % 3 == 2 else w for k, w in enumerate(item))
    assert find(make_items([(7, " ".join(item))]), ["a b " + text + " c"])[0] == [(7, round((2 * 40 - 19) / 120, 6), 2, 60)]


def test_a_long_run_of_a_longer_item_is_found():
    item = [f"t{k}" for k in range(200)]
    made = make_items([(7, " ".join(item))])
    assert find(made, ["a b " + " ".join(item[50:130])])[0] == [(7, 0.4, 2, 81)]
    assert find(made, [" ".join(item[50:75])])[0] and not find(made, [" ".join(item[50:74])])[0]


def test_scripts_without_spaces():
    item = "机器学习是人工智能的一个分支，它研究如何让计算机从数据中学习。"
    made = make_items([(1, item), (2, "これはテストのための文です。")])
    got = find(made, ["前言。" + item + "后语", "漢字だけの別の文章である。", "x これはテストのための文です y", item.replace("人工", "新")])
    assert [[(i, s) for i, s, *_ in m] for m in got][:3] == [[(1, 1.0)], [], [(2, 1.0)]]
    assert got[3][0][0] == 1 and 0.8 < got[3][0][1] < 1


def test_short_items_need_all_their_words():
    made = make_items([(1, "one two three"), (2, "of the world we know")])
    assert [i for i, *_ in find(made, ["zero one two three four"])[0]] == [1]
    assert find(made, ["one two four of the world we saw"])[0] == []


def test_a_text_full_of_a_common_opening_has_bounded_arrays(monkeypatch):
    """One opening in 1,500 items, 800 times in a text: parts of bounded size, the same result."""
    r = random.Random(3)
    opening = "what is the answer to this".split()
    bench = [(k, " ".join(opening + [f"w{r.randrange(5000)}" for _ in range(30)])) for k in range(1500)]
    made = make_items(bench)
    text = " ".join(" ".join(opening) + f" n{r.randrange(10**6)}" for _ in range(800)) + " " + bench[77][1] + " end"
    sizes = []
    from eventlens.llm import decontam
    real = decontam._windows
    monkeypatch.setattr(decontam, "CELLS", 200_000)
    monkeypatch.setattr(decontam, "_windows", lambda items, at, pair, *a: sizes.append(
        int((items.starts[pair + 1] - items.starts[pair]).sum())) or real(items, at, pair, *a))
    assert [(i, s) for i, s, *_ in find(made, [text])[0]] == [(77, 1.0)]
    assert len(sizes) > 10 and max(sizes) < 2_500_000


def test_id_columns_of_one_name(spark):
    docs = spark.createDataFrame([(5, "a b c d e f g h")], "id long, text string")
    bench = spark.createDataFrame([(9, "A b c, d e f g h")], "id long, text string")
    got = leaks(docs, bench, id_col="id", item_col="id")
    assert got.columns[:2] == ["id", "id_item"] and [tuple(x)[:3] for x in got.collect()] == [(5, 9, 1.0)]


def test_blocks_of_several_passes(spark, monkeypatch):
    bench, _, r = items(24)
    rows = [(k, f"x {t} y" if k % 2 else "nothing here at all") for k, t in bench]
    df, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(*b, 1) for b in bench], BENCH)
    monkeypatch.setattr("eventlens.llm.decontam.BLOCKS", 2)
    monkeypatch.setattr("eventlens.llm.decontam.item_blocks", lambda b, *a, **k: item_blocks(b, block_bytes=700))
    assert {(x.doc_id, x.item_id) for x in leaks(df, table).collect()} == {(k, k) for k, _ in bench if k % 2}
    assert {x.doc_id for x in without_leaks(df, table).collect()} == {k for k, _ in bench if not k % 2}


def test_words_are_those_of_the_pattern():
    r = random.Random(2)
    parts = ["a", "Z", "é", "É", "_", "7", " ", ".", "\n", "—", "“", "\u00a0", "ß", "ñ", "¿", "×", "q"]
    texts = [None, ""] + ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(800)]
    w = passage_words(pa.array(["x", *texts], pa.string()).slice(1))
    got = [[w.data[a:b].tobytes().decode() for a, b in zip(w.start[x:y], w.stop[x:y])] for x, y in zip(w.first, w.first[1:])]
    assert got == [WORDS.findall((t or "").lower()) for t in texts]
