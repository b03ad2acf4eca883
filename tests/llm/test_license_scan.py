import random
import re

import duckdb
import pyarrow as pa
import pytest

from eventlens.llm.license_scan import (PHRASES, compile_templates, find_templates, license_sql, scan, scan_licenses,
                                        template_regex)
from eventlens.llm.license_templates import TEMPLATES
from llm_helpers import brute_words


def brute(text, templates=TEMPLATES, phrases=PHRASES):
    """Labels and phrase places by regular expressions and plain loops."""
    w = brute_words(text)
    s = " " + "".join(x + " " for x in w)
    base = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
    own = [label for label, markup in templates if re.search(" " + template_regex(markup), s)]
    places = [k for k, _ in base]
    return (len(w), len(base), min(places, default=None), max(places, default=None), sorted({x for _, x in base}),
            sorted({x for _, x in base} | set(own)))


def got(text, auto=None):
    r = scan(auto or compile_templates(), pa.array([text], pa.string()))[0]
    return tuple(r[k] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels"))


MIT = """The MIT License (MIT)

Copyright (c) 2019 Some Holder and Others

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


def test_a_whole_license_and_what_may_vary():
    auto = compile_templates()
    r = scan(auto, pa.array([MIT]))[0]
    assert r["labels"] == ["mit"] and r["score"] > 0.95
    longest = max(r["found"], key=lambda f: f["last_word"] - f["first_word"])
    assert (longest["first_word"], longest["last_word"]) == (0, r["n_words"] - 1)
    body = MIT[MIT.index("Permission"):]
    assert got(body, auto)[5] == ["mit"]  # the optional head left out
    assert got(body.replace("notice shall", "notice (including the next paragraph) shall").upper(), auto)[5] == ["mit"]
    assert got("Some other text. " * 50 + MIT + " more text" * 50, auto)[5] == ["mit"]


@pytest.mark.parametrize("old, new", [("free of charge", "free of a charge"), ("merge, ", ""), ("publish", "print"),
                                      ("substantial portions", "portions substantial")])
def test_mandatory_wording_has_to_match(old, new):
    body = MIT[MIT.index("Permission"):]
    assert old in body and got(body.replace(old, new))[5] == []


def test_replaceable_regions_have_bounds():
    auto = compile_templates([("x", "alpha {{1-3}} omega"), ("y", "one [[two [[three]]]] {{four|five six|}} seven")], {})
    label = lambda t: got(t, auto)[5]
    assert label("alpha omega") == [] and label("alpha b c d e omega") == []
    assert label("alpha b omega") == label("Alpha, b; c d OMEGA.") == ["x"]
    assert label("alpha alpha omega omega") == ["x"]
    for t in ("one seven", "one two seven", "one two three four seven", "one five six seven", "zero one two five six seven eight"):
        assert label(t) == ["y"]
    for t in ("one three seven", "one five seven", "one six seven", "one two two seven", "one", "seven"):
        assert label(t) == []


def test_matches_do_not_cross_texts():
    auto = compile_templates()
    rows = scan(auto, pa.array(["released under the mit", "license and the general", "public license"]))
    assert all(r["labels"] == [] and r["n_base"] == 0 for r in rows)


def test_same_as_regular_expressions_on_random_texts():
    r = random.Random(4)
    words = "a b c d".split()
    for _ in range(150):
        markup = []
        for _ in range(r.randrange(1, 5)):
            markup.append(r.choice([r.choice(words), f"[[{r.choice(words)}]]", "{{0-2}}", "{{1-2}}", "{{a|b c|}}", "[[a [[b]] {{c|d}}]]"]))
        templates = [("t", "a " + " ".join(markup)), ("u", " ".join(markup) + " d b")]
        auto = compile_templates(templates, {"a b": "p", "d": "q", "c c c": "r"})
        for _ in range(20):
            text = " ".join(r.choice(words) for _ in range(r.randrange(9)))
            assert got(text, auto) == brute(text, templates, {"a b": "p", "d": "q", "c c c": "r"})


def test_marks_are_checked():
    for bad in ("a [[b", "a]] b", "[[a]]", "{{0-4}}"):
        with pytest.raises(ValueError):
            compile_templates([("x", bad)], {})


def test_odd_and_empty_documents(spark, odd_docs, no_docs):
    rows = scan_licenses(odd_docs, out="license").collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        x = r["license"]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels, x.labels) == brute(r.text)
        assert x.score == 0.0
    assert scan_licenses(no_docs).collect() == []
    again = scan_licenses(odd_docs, out="label")  # a column of that name is replaced
    assert again.columns == odd_docs.columns and dict(again.dtypes)["label"].startswith("struct")


def test_repeats_long_and_hot_texts(spark):
    texts = [MIT * 40, "released under the mit license " * 3000, "x " * 30_000 + "Apache License", MIT, MIT,
             "Permission is hereby granted, free of charge, to any person " * 2000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r["license"] for r in scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        x = rows[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels, x.labels) == brute(t)
    assert rows[3] == rows[4] and sum(f.label == "mit" for f in rows[1].found) == 3000


def test_sql_twin_on_planted_texts():
    texts = [MIT, MIT.replace("merge", "merges"), "Licensed under the Apache License, Version 2.0.", None, "", "mit license mit license",
             "GNU GENERAL PUBLIC LICENSE", "licensed under a Creative Commons Attribution-NonCommercial 4.0 license"]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    rows = sorted(c.execute(license_sql()).fetchall())
    for r, x in zip(rows, scan(compile_templates(), pa.array(texts, pa.string()))):
        assert r[1:] == (x["n_words"], x["n_base"], x["first_word"], x["last_word"], ",".join(x["base_labels"]),
                         ",".join(x["labels"]), x["score"])


def test_the_automaton_ends_and_one_word_is_one_look_up():
    auto = compile_templates()
    assert len(auto.table) < 20_000 and not auto.accepts[[0, 1]].any()
    assert find_templates(auto, scan_flat(auto, "no license here")) == []


def scan_flat(auto, text):
    from eventlens.llm.license_scan import _numbers
    from eventlens.llm.words import split_words
    return _numbers(auto, split_words(pa.array([text])))[0]
