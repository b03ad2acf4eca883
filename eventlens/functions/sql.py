"""SQL surface (G2): the row functions registered as SQL functions.

They are SQL-bodied temporary functions (``CREATE TEMPORARY FUNCTION ...
RETURN <expr>``), so Catalyst inlines them like any built-in expression: no
Python worker is involved when SQL users call them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from eventlens.functions.returns import CATEGORIZE_SQL
from eventlens.functions.text import (BOILERPLATE_PATTERNS, CAUSAL_PHRASES, NA, NA_CLEANED_EMPTY,
                                      SENTENCE_BOUNDARY, TAG_PATTERN, WHITESPACE, keyword_pattern)


def _raw(s: str) -> str:
    if "'" in s:
        raise ValueError("pattern must not contain a single quote")
    return "r'" + s + "'"


def _escaped(s: str) -> str:
    """A SQL string literal with every character as a \\uXXXX escape."""
    return "'" + "".join(f"\\u{ord(ch):04x}" for ch in s) + "'"


def _trim(x: str) -> str:
    return f"btrim({x}, {_escaped(WHITESPACE)})"


def _clean_text_body() -> str:
    """F6 in SQL over parameters ``t, max_chars, max_sents``; intermediate
    values are bound once with one-element ``transform`` lambdas."""
    b = "t"
    for p in BOILERPLATE_PATTERNS:
        b = _trim(f"regexp_replace({b}, {_raw(p)}, '')")
    parts = "if(max_sents < 2147483647, max_sents + 1, -1)"  # the rest of the text stays one part
    sent = _trim(f"array_join(slice(split({b}, {_raw(SENTENCE_BOUNDARY)}, {parts}), 1, max_sents), ' ')")
    h = "substr(s, 1, max_chars)"
    cut = (f"CASE WHEN instr({h}, '.') > 0 "
           f"THEN concat(substr({h}, 1, length({h}) - instr(reverse({h}), '.')), '.') "
           f"ELSE concat(CASE WHEN instr({h}, ' ') > 0 "
           f"THEN substr({h}, 1, length({h}) - instr(reverse({h}), ' ')) ELSE {h} END, '...') END")
    trunc = f"CASE WHEN length(s) > max_chars THEN {cut} ELSE s END"
    body = (f"element_at(transform(array({sent}), s -> element_at(transform(array({trunc}), "
            f"x -> CASE WHEN x = '' THEN '{NA_CLEANED_EMPTY}' ELSE x END), 1)), 1)")
    return (f"CASE WHEN t IS NULL THEN '{NA}' WHEN t = '{NA}' OR {_trim('t')} = '' THEN t "
            f"ELSE {body} END")


def register_sql_functions(spark: SparkSession, phrases=CAUSAL_PHRASES) -> list[str]:
    """Register ``categorize_return``, ``has_causal_keyword``, ``strip_tags``
    and ``clean_text`` for ``spark.sql``; returns the registered names."""
    stmts = {
        "categorize_return": f"(x DOUBLE) RETURNS STRING RETURN {CATEGORIZE_SQL}",
        "has_causal_keyword": (
            "(t STRING) RETURNS BOOLEAN RETURN "
            f"coalesce(lower(t) RLIKE {_raw(keyword_pattern(phrases))}, false)"),
        "strip_tags": (
            "(t STRING) RETURNS STRING RETURN "
            f"coalesce(btrim(regexp_replace(t, {_raw(TAG_PATTERN)}, ''), {_escaped(WHITESPACE)}), '')"),
        "clean_text": ("(t STRING, max_chars INT, max_sents INT) RETURNS STRING RETURN "
                       + _clean_text_body()),
    }
    for name, body in stmts.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(stmts)
