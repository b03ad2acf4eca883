from pyspark.sql import functions as F

from helpers import one_col
from eventlens.functions.text import (NA_CLEANED_EMPTY, clean_and_truncate, first_sentences,
                                      has_causal_keyword, remove_boilerplate, strip_tags,
                                      truncate_text)


def col_values(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_keyword_flag(spark):
    df = one_col(spark, ["Profit fell due to costs", "due\nto", "causeway", "Following the vote",
                         None, "  ", "the cause.", "because"])
    assert col_values(df, has_causal_keyword("t")) == [True, False, False, True, False, False,
                                                       True, True]


def test_keyword_unicode_word_boundary(spark):
    # a non-ASCII letter next to a phrase is part of the word: no match
    # Python's \w: letters, all numbers and "_" (not combining marks or joiners)
    df = one_col(spark, ["\u00e9since", "x since y", "since\u00e9", "\u00b2because", "e\u0301since",
                         "because\u200d", "_thus"])
    assert col_values(df, has_causal_keyword("t")) == [False, True, False, False, True, True, False]


def test_sentences(spark):
    df = one_col(spark, ["A b. C d! e f. G"])
    assert col_values(df, first_sentences("t", 1)) == ["A b."]
    assert col_values(df, first_sentences("t", 2)) == ["A b. C d! e f."]
    assert col_values(df, first_sentences("t", 9)) == ["A b. C d! e f. G"]


def test_truncate(spark):
    df = one_col(spark, ["aaaa bbbb cccc", "One. Two. Three", "short", "nospaceslongword"])
    assert col_values(df, truncate_text("t", 11)) == ["aaaa bbbb...", "One. Two.", "short",
                                                      "nospaceslon..."]


def test_truncate_expression_input(spark):
    df = one_col(spark, ["aaaa bbbb cccc"])
    assert col_values(df, truncate_text(F.upper("t"), 11)) == ["AAAA BBBB..."]


def test_clean_sentinels(spark):
    df = one_col(spark, [None, "N/A", "  ", "SIGNATURES x", "Hello world. Bye."])
    assert col_values(df, clean_and_truncate("t")) == ["N/A", "N/A", "  ", NA_CLEANED_EMPTY,
                                                      "Hello world. Bye."]


def test_boilerplate(spark):
    text = ("Intro. The information contained in this Current Report shall not be deemed "
            "filed here. Body.\nExhibit 99.1 Press release\nExhibits 1.1 stay\nSIGNATURES tail")
    df = one_col(spark, [text])
    assert col_values(df, remove_boilerplate("t")) == ["Intro.  Body.\n\nExhibits 1.1 stay"]


def test_unicode_trim_and_tags(spark):
    df = one_col(spark, ["  <b>x</b>\n<i\nclass='a'>y</i>  ", None])
    assert col_values(df, strip_tags("t")) == ["x\ny", ""]


def test_factored_keyword_pattern_matches_flat_alternation(spark):
    import random

    from eventlens.functions.text import CAUSAL_PHRASES, keyword_pattern
    flat = r"(?<![\p{L}\p{N}_])(?:" + "|".join(CAUSAL_PHRASES) + r")(?![\p{L}\p{N}_])"
    rnd = random.Random(7)
    vocab = list(CAUSAL_PHRASES) + ["causeway", "caus", "due", "to", "result", "effects", "sinced",
                                    "thusly", "é", "x", "spurr", "factor", "in"]
    texts = []
    for _ in range(3000):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(1, 4))]
        texts.append(rnd.choice(["", "é", "a", "-"]) + rnd.choice([" ", "", "\n"]).join(words)
                     + rnd.choice(["", "s", ".", "é"]))
    df = one_col(spark, texts)
    diff = df.where(F.col("t").rlike(flat) != F.col("t").rlike(keyword_pattern())).count()
    assert diff == 0
