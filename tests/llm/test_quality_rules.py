import re

from pyspark.sql import functions as F

from eventlens.llm.quality_rules import RULES, STOP_WORDS, Rule, failed, judge, measure

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_metrics_against_brute_force(spark, odd_docs):
    more = ["a b c d e " * k for k in range(1, 5)] + ["x a b c d e y a b c d e a b c d e", "a a a a a", "a a a a a a", "a b c d e f a b c d e"]
    df = odd_docs.select("text").union(spark.createDataFrame([(t,) for t in more], "text string"))
    for r in measure(df).collect():
        assert tuple(r.quality[n] for n in NAMES) == brute(r.text), r.text


def test_verdicts_on_whole_documents(docs):
    for r in judge(docs).collect():
        n, *_, repeated = brute(r.text)
        assert r.quality_base_failed == (n < 10 or 100 * repeated > 20 * n)
        assert not (r.quality_base_failed and r.quality_kept)


def test_clashing_and_other_columns(odd_docs):
    out = judge(odd_docs.withColumn("quality", F.lit("old")).withColumn("n_words", F.lit(-1)))
    assert out.count() == odd_docs.count()
    assert {r.n_words for r in out.collect()} == {-1}
    assert "__quality_words" not in out.columns


def test_null_and_empty_texts_fail_on_length(odd_docs):
    for r in judge(odd_docs).where("coalesce(trim(text), '') = ''").collect():
        assert r.quality.n_words == 0 and r.quality_base_failed and not r.quality_kept


def brute_kept(text):
    """The verdict by a plain reading of the rules."""
    text = text or ""
    n, chars, symbols, dup, repeated = brute(text)
    if n < 10 or 100 * repeated > 20 * n:
        return False
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    stops = {x for w in STOP_WORDS for x in (w, w.capitalize(), w.upper())}
    share = sum(w in stops for w in words) / n
    bullets = sum(bool(re.match(r"[ \t\n\x0b\f\r]*([-*•]|[0-9]+[.)])[ \t\n\x0b\f\r]", x)) for x in lines)
    dots = sum(bool(re.search(r"(\.\.\.|…)[ \t\n\x0b\f\r]*$", x)) for x in lines)
    return not (chars < 2 * n or chars > 25 * n or symbols > n / 4 or text.count("!") > n / 4 or dup > len(lines) / 2
                or n >= 40 and (bullets > 0.9 * len(lines) or dots > len(lines) / 2)
                or n >= 40 and len(text.encode()) < 1.5 * len(text) and not 0.04 <= share <= 0.6)


def test_verdicts_against_brute_force(docs, odd_docs):
    for df in (docs, odd_docs):
        rows = judge(df).select("text", "quality_kept").collect()
        assert [r.quality_kept for r in rows] == [brute_kept(r.text) for r in rows]


def test_stop_words_count_by_their_ratio_in_any_spelling(spark):
    filler = [f"word{k}" for k in range(96)]
    texts = [" ".join(filler + ["the"] * 4), " ".join(filler + ["The", "THE", "tHe", "of"]), " ".join(filler + ["The", "OF", "and", "to"]),
             " ".join(["the", "of", "and"] * 40), " ".join(f"слово{k}" for k in range(100)), " ".join(filler[:39])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rule = tuple(r for r in RULES if r.name == "stop_words")
    got = {r.doc_id: (r.quality.n_stop_words, r.quality_kept) for r in judge(df, base=(), rules=rule).collect()}
    assert got == {0: (4, True), 1: (3, False), 2: (4, True), 3: (120, False), 4: (0, True), 5: (0, True)}
    assert judge(df, base=(), rules=rule, stop_words=("word1", "word2", "word3", "word4")).where("doc_id = 1 and quality_kept").count() == 1


def test_rule_tables_compile(spark):
    df = spark.createDataFrame([(5, 0.5), (50, 0.5), (50, 0.1)], "n long, x double").select(F.struct(F.col("n").alias("n_words"), "x").alias("quality"))
    assert [r[0] for r in df.select(failed((Rule("x", "x", high=0.2, min_words=10),))).collect()] == [False, True, False]
    assert [r[0] for r in df.select(failed(())).collect()] == [False] * 3


def test_one_projection_without_python_or_shuffle(docs):
    plan = judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange|Join", plan)
    assert len({r.name for r in RULES}) == len(RULES)


def test_empty_table(no_docs):
    assert judge(no_docs).count() == 0
