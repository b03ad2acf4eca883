"""Randomised cross-engine checks of the text operators on generated inputs
(sentence ends, Unicode whitespace, accents, combining marks, emoji,
boilerplate, item headings, tags, entities): the Spark forms (Java regex with
look-around) against the SQL twins (RE2, none), against Python's own ``re``,
``str`` and ``json`` (the reference's semantics), and the HTML job against
the page-text twin."""
import random

import duckdb
import pytest

from helpers import one_col
from eventlens.functions.text import clean_and_truncate, has_causal_keyword, remove_boilerplate
from eventlens.plans import oracle as O

FRAGMENTS = [
    "Sales rose", "due to demand", "Profit fell.", "The company said", "résumé élan", "Zürich",
    "A.", "B!", "c?", "Item 2.02 Results.", "Exhibit 99.1 Press release", "Exhibits 1.1",
    "SIGNATURES", "signatures", "The information contained in this Current Report",
    "shall not be deemed", "filed", "Pursuant to the requirements of the Securities Exchange Act of 1934",
    "because", "causeway", "thus", "x", "Q", "...", "!", "?", ".",
]
SPACES = [" ", "  ", "\n", "\t", " \n ", "", ". ", "! ", "? ", "\r\n", "\x0b", "\xa0", "\u3000",
          "\x1c", "\n \u2009\n"]


def _texts(n, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randint(1, 30)):
            parts.append(rnd.choice(FRAGMENTS))
            parts.append(rnd.choice(SPACES))
        out.append(rnd.choice(["", " ", "\n"]) + "".join(parts))
    return out + ["", "   ", "N/A", "SIGNATURES only"]


@pytest.mark.parametrize("limits", [(1500, 7), (40, 3), (12, 1)])
def test_clean_chain_matches_sql_twin(spark, limits):
    texts = _texts(400, hash(limits) % 1000)
    got = [r[0] for r in one_col(spark, texts).select(clean_and_truncate("t", *limits)).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE src(i INTEGER, t VARCHAR)")
    con.executemany("INSERT INTO src VALUES (?, ?)", list(enumerate(texts)))
    ctes, last = O.clean_ctes("src", "t", "z", limits)
    want = [r[0] for r in con.execute(O.w(*ctes) + f"SELECT z_clean FROM {last} ORDER BY i").fetchall()]
    bad = [(t, g, w) for t, g, w in zip(texts, got, want) if g != w]
    assert not bad, bad[:3]


def test_boilerplate_and_keywords_match_sql_twin(spark):
    texts = _texts(400, 11)
    df = one_col(spark, texts).select(remove_boilerplate("t").alias("b"), has_causal_keyword("t").alias("k"))
    got = [(r.b, r.k) for r in df.collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE src(i INTEGER, t VARCHAR)")
    con.executemany("INSERT INTO src VALUES (?, ?)", list(enumerate(texts)))
    ctes, last = O.boilerplate_ctes("src", "t", "y")
    want = con.execute(O.w(*ctes) + f"SELECT y_b, {O.keyword('t')} FROM {last} ORDER BY i").fetchall()
    bad = [(t, g, tuple(w)) for t, g, w in zip(texts, got, want) if g != tuple(w)]
    assert not bad, bad[:3]


ITEM_BITS = ["Item\xa02.02", "ITEM\x1c1.01", "Item\u30007.", "Item 2.02", "ITEM 1.01", "item 5.02", "Item 8.01", "Item 5.07", "ITEM 3.03", "Item 9.01",
             "Item  7.", "Item 7 Management's Discussion and Analysis", "Item 7A.", "Item 8.",
             "Item 10.", "Item", "Results", "text", "Other Events", "\n", " ", ".", "2.02"]


def test_sections_match_sql_twin(spark):
    from pyspark.sql import functions as F

    from eventlens.functions.sections import item_8k, mdna
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(ITEM_BITS) for _ in range(rnd.randint(1, 14))) for _ in range(500)]
    df = one_col(spark, texts).select(item_8k("t").alias("a"), mdna("t").alias("b"))
    got = [(r.a, r.b) for r in df.collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE src(i INTEGER, t VARCHAR)")
    con.executemany("INSERT INTO src VALUES (?, ?)", list(enumerate(texts)))
    want = con.execute(f"SELECT {O.items_8k('t')}, coalesce({O.mdna_expr('t')}, t) FROM src ORDER BY i").fetchall()
    bad = [(t, g, tuple(w)) for t, g, w in zip(texts, got, want) if g != tuple(w)]
    assert not bad, bad[:3]


def test_json_quote_matches_python_json(spark):
    import json

    from eventlens.functions.answers import json_quote
    rnd = random.Random(9)
    alphabet = ['a', 'é', '"', '\\', '/', '\n', '\t', '\r', '\x01', '\x1f', '\x7f', ' ', '😀', ' ', '<', '&']
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12))) for _ in range(400)] + [None]
    got = [r[0] for r in one_col(spark, texts).select(json_quote("t")).collect()]
    want = [json.dumps(t, ensure_ascii=False) for t in texts]
    bad = [(t, g, w) for t, g, w in zip(texts, got, want) if g != w]
    assert not bad, bad[:3]


def test_tags_and_blank_lines_match_sql_twin(spark):
    from eventlens.functions.text import drop_blank_lines, strip_tags
    rnd = random.Random(13)
    bits = ["<b>", "</b>", "<p class='x'>", "<br/>", "<a\nhref=1>", "text", "é", "\n", " \n", "\t\n",
            "\xa0\n", "\x1c", "  ", "<", ">", "a > b"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 15))) for _ in range(400)]
    got = [(r.a, r.b) for r in one_col(spark, texts)
           .select(strip_tags("t").alias("a"), drop_blank_lines("t").alias("b")).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE src(i INTEGER, t VARCHAR)")
    con.executemany("INSERT INTO src VALUES (?, ?)", list(enumerate(texts)))
    want = con.execute(f"SELECT {O.strip_tags('t')}, {O.drop_blank_lines('t')} FROM src ORDER BY i").fetchall()
    bad = [(t, g, tuple(w)) for t, g, w in zip(texts, got, want) if g != tuple(w)]
    assert not bad, bad[:3]


def test_json_object_acceptance_matches_python(spark):
    """A ``{...}`` candidate counts as valid exactly when Python's json.loads
    accepts it (the answer parser relies on this). Candidates come from the
    non-greedy ``\\{...?\\}`` search, so they hold no inner ``}`` (Spark
    would ignore text after a complete object; such text cannot occur)."""
    import json

    from pyspark.sql import functions as F
    rnd = random.Random(21)
    toks = ['"causal"', '"assoc"', ':', ',', ' ', '"Yes"', "'Yes'", 'true', 'null', 'NaN', '1', '01',
            '1e5', '-0', '[1, 2]', '{"a": 1', '"a\\nb"', '"bad \\q"', '"\t"', 'yes', '"\\u00e9"', '{']
    cands = ["{" + "".join(rnd.choice(toks) for _ in range(rnd.randint(0, 7))) + "}" for _ in range(600)]
    cands += ['{"causal": "Yes"}', '{"a": 1,}', '{"a": NaN}', '{"a": 01}', "{'a': 1}", '{"a":1 "b":2}']
    parsed = F.from_json("t", "map<string,string>", {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
    got = [r[0] for r in one_col(spark, cands).select(parsed.isNotNull()).collect()]

    def py_ok(x):
        try:
            return isinstance(json.loads(x), dict)
        except ValueError:
            return False
    bad = [(c, g, py_ok(c)) for c, g in zip(cands, got) if g != py_ok(c)]
    assert not bad, bad[:5]


def test_keyword_flag_matches_python_re(spark):
    """Whole-word semantics of Python's re (\\b over str) on tricky neighbours."""
    import re

    from eventlens.functions.text import CAUSAL_PHRASES
    rnd = random.Random(31)
    py = re.compile(r"\b(?:" + "|".join(map(re.escape, CAUSAL_PHRASES)) + r")\b")
    near = ["", " ", "_", "²", "́", "‍", "é", "-", ".", "9", "٣", "Ⅷ", "x"]
    words = list(CAUSAL_PHRASES) + ["causeway", "Because", "DUE TO", "due  to"]
    texts = ["".join(rnd.choice(near) + rnd.choice(words) + rnd.choice(near) for _ in range(rnd.randint(1, 3)))
             for _ in range(800)]
    got = [r[0] for r in one_col(spark, texts).select(has_causal_keyword("t")).collect()]
    bad = [(t, g) for t, g in zip(texts, got) if g != (py.search(t.lower()) is not None)]
    assert not bad, bad[:5]


def test_string_primitives_count_code_points_like_python(spark):
    from pyspark.sql import functions as F
    rnd = random.Random(41)
    alphabet = ["a", ".", " ", "é", "😀", "👍🏽", "𝔸", "中", "́"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12))) for _ in range(300)]
    df = one_col(spark, texts).select(
        F.length("t").alias("n"), F.col("t").substr(1, 5).alias("head"), F.reverse("t").alias("rev"),
        F.instr("t", ".").alias("dot"))
    for t, r in zip(texts, df.collect()):
        assert (r.n, r.head, r.rev, r.dot) == (len(t), t[:5], t[::-1], t.find(".") + 1), t


def test_html_text_matches_sql_twin_on_random_bodies():
    from eventlens.operators.html import extract_text
    rnd = random.Random(51)
    bits = ["<p>", "</p>", "<b>", "</b>", "<br>", "<div class='a'>", "</div>", "<!-- c -->", "word",
            "élan", " ", "\n", "  \n  ", "&amp;", "&amp", "&copy;", "&middot;", "&quot;", "x.y", "<li>",
            "</li>", "<a href='/x'>", "</a>"]
    pages = ["<html><head><title>T</title><style>p{}</style></head><body>"
             + "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) + "</body></html>"
             for _ in range(300)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id INTEGER, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(pages)))
    want = [r[0] for r in con.execute("WITH " + O.PAGE_TEXT + "\nSELECT text FROM page_text ORDER BY page_id").fetchall()]
    got = [extract_text(h) for h in pages]
    bad = [(h, g, w) for h, g, w in zip(pages, got, want) if g != w]
    assert not bad, bad[:3]
