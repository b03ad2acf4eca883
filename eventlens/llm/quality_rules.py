"""Quality rules: a threshold table compiled into one Spark projection.

All metrics are built-in expressions over the text (no user functions, no
shuffle): the scan feeds a few staged projections and the rules are one more.
Words are maximal runs without space and ``\\t``..``\\r``; lines are cut at
``\\n``.

Defined results: a null text counts as an empty one (no words, so the base
length rule fails); an empty table gives an empty result; repeated rows are
judged one by one; stop words are found in lower case, in capitals and with one
capital, by the words as they stand, and their rule does not speak of texts in
other than Latin letters; other columns of the input pass through untouched, and the
metric columns come in one struct; a column of the struct's name (``out``
chooses it) is replaced, and names that begin with two underscores are taken.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.common import WORD_PATTERN, let, read_table


class Rule(NamedTuple):
    """A document fails when ``metric`` is outside ``low``..``high``; the rule
    speaks only about documents of at least ``min_words`` words and, with
    ``max_char_bytes``, of fewer UTF-8 bytes a character than that (texts in
    Latin letters have fewer than 1.5, other scripts more)."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0
    max_char_bytes: float | None = None


# Frequent function words, a line or two for each language (fixed values).
STOP_WORDS = (
    "the", "of", "and", "to", "in", "that", "is", "it", "for", "was", "with", "as", "are", "this",
    "der", "die", "und", "das", "den", "von", "mit", "ist", "nicht", "ein", "zu", "sich", "auf", "des",
    "le", "la", "les", "de", "et", "un", "une", "que", "est", "en", "du", "par", "pour", "qui", "dans",
    "el", "los", "las", "y", "por", "con", "para", "se", "no", "del",
    "il", "di", "che", "non", "per", "una", "sono", "della",
    "os", "da", "do", "em", "um", "uma", "com", "não",
    "het", "een", "van", "dat", "niet", "op", "te", "zijn",
    "och", "att", "det", "som", "på", "är", "av", "inte",
    "og", "til", "er", "ikke", "på", "af",
    "się", "nie", "na", "jest", "że", "w", "z", "i",
    "je", "že", "ve", "si", "pro",
    "și", "cu", "nu", "care", "din", "este",
    "bir", "bu", "için", "ile", "olarak",
    "yang", "dan", "dengan", "untuk", "ini",
    "ja", "ei", "oli", "että", "hän",
    "és", "hogy", "nem", "egy", "az",
)


def _spellings(words: tuple[str, ...]) -> list[str]:
    """The words as they stand, at the start of a sentence, and in capitals."""
    return list(dict.fromkeys(x for w in words for x in (w, w.capitalize(), w.upper())))


#: Base rules: length, and words in repeated 5-word windows (in percent).
BASE_RULES = (
    Rule("base_length", "n_words", low=10),
    Rule("base_repeats", "repeat_percent", high=20),
)

#: The method's own table. Ratios are per word or per line with a word.
RULES = (
    Rule("mean_word_length", "mean_word_length", low=2.0, high=25.0),
    Rule("symbols_per_word", "symbols_per_word", high=0.25),
    Rule("exclamations_per_word", "exclamations_per_word", high=0.25),
    Rule("stop_words", "stop_word_ratio", low=0.04, high=0.6, min_words=40, max_char_bytes=1.5),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
    Rule("bullet_lines", "bullet_line_ratio", high=0.9, min_words=40),
    Rule("ellipsis_lines", "ellipsis_line_ratio", high=0.5, min_words=40),
)

WINDOW = 5  # words in a window of the repetition metric


def _count(text: Column, chars: str) -> Column:
    """Characters of ``text`` in the class ``chars`` (code points)."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words covered by a ``WINDOW``-word window found twice or more.

    Windows are compared by the 64-bit hash of their words; a text without an
    equal pair (nearly all) stops at the distinct count. Otherwise windows are
    sorted by (hash, position), neighbours of equal hash are kept, and their
    spans are added up in position order without counting overlaps twice."""
    n = F.size(words)

    def spans(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            same = lambda x, i, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            return F.filter(s, lambda x, i: same(x, i, i - 1) | same(x, i, i + 1))

        starts = F.sort_array(F.transform(let(ordered, repeated), lambda x: x["i"]))
        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("total"))
        step = lambda a, x: F.struct(x.alias("last"),
                                     (a["total"] + F.least(x - a["last"], F.lit(WINDOW))).alias("total"))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")) \
            .otherwise(F.aggregate(starts, zero, step, lambda a: a["total"]))

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    return F.when(n <= WINDOW, F.lit(0).cast("long")) \
        .otherwise(let(let(words, windows), spans))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def measure(df: DataFrame, text_col: str = "text", out: str = "quality",
            stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """``df`` with a struct column ``out`` of all metrics of the rule tables.

    The staged columns carry the prefix of ``out``, and are gone at the end."""
    p = f"__{out}_"
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    staged = df.withColumns({
        f"{p}words": F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0)),
        f"{p}lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        f"{p}symbols": _count(text, r"#*$%&|<>"),
        f"{p}bangs": _count(text, "!"),
    })
    words, lines = F.col(f"{p}words"), F.col(f"{p}lines")
    stops = _spellings(stop_words)
    staged = staged.withColumns({
        f"{p}n": F.size(words).cast("long"),
        f"{p}chars": F.length(F.array_join(words, "")).cast("long"),
        f"{p}n_lines": F.size(lines).cast("long"),
        f"{p}uniq": F.size(F.array_distinct(lines)).cast("long"),
        f"{p}stops": F.size(F.filter(words, lambda w: w.isin(stops))).cast("long"),
        f"{p}repeat": _repeat_words(words),
        f"{p}bullets": F.size(F.filter(lines, lambda x: x.rlike(r"^\s*([-*•]|\d+[.)])\s"))).cast("long"),
        f"{p}dots": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).cast("long"),
    })
    c = lambda k: F.col(f"{p}{k}")
    metrics = F.struct(
        c("n").alias("n_words"), c("chars").alias("word_chars"), c("symbols").alias("n_symbols"),
        (c("n_lines") - c("uniq")).alias("n_dup_lines"), c("repeat").alias("n_repeat_words"),
        c("n_lines").alias("n_lines"), c("stops").alias("n_stop_words"),
        _ratio(c("repeat") * 100, c("n")).alias("repeat_percent"),
        _ratio(c("stops"), c("n")).alias("stop_word_ratio"),
        _ratio(F.octet_length(text), F.length(text)).alias("char_bytes"),
        _ratio(c("chars"), c("n")).alias("mean_word_length"),
        _ratio(c("symbols"), c("n")).alias("symbols_per_word"),
        _ratio(c("bangs"), c("n")).alias("exclamations_per_word"),
        _ratio(c("n_lines") - c("uniq"), c("n_lines")).alias("dup_line_ratio"),
        _ratio(c("bullets"), c("n_lines")).alias("bullet_line_ratio"),
        _ratio(c("dots"), c("n_lines")).alias("ellipsis_line_ratio"),
    )
    return staged.withColumn(out, metrics).drop(*[x for x in staged.columns if x.startswith(p)])


def failed(rules: tuple[Rule, ...], metrics: str = "quality") -> Column:
    """Compile a rule table into one boolean: true if any rule fails."""
    m = lambda k: F.col(f"`{metrics}`.`{k}`")

    def one(r: Rule) -> Column:
        out = F.lit(False)
        if r.low is not None:
            out = out | (m(r.metric) < F.lit(r.low))
        if r.high is not None:
            out = out | (m(r.metric) > F.lit(r.high))
        if r.min_words:
            out = out & (m("n_words") >= r.min_words)
        return out if r.max_char_bytes is None else out & (m("char_bytes") < F.lit(r.max_char_bytes))

    return reduce(lambda a, b: a | b, [one(r) for r in rules], F.lit(False))


def judge(df: DataFrame, text_col: str = "text", out: str = "quality",
          base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = RULES,
          stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """``measure`` plus ``<out>_base_failed`` and ``<out>_kept``."""
    return measure(df, text_col, out, stop_words).withColumns({
        f"{out}_base_failed": failed(base, out),
        f"{out}_kept": ~(failed(base, out) | failed(rules, out))})


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = judge(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    m = [F.col(f"quality.{k}").alias(k) for k in
         ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return q.select("doc_id", *m, F.col("quality_base_failed").alias("base_failed"),
                    F.col("quality_kept").alias("kept"))


def _sql_list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in _spellings(words)) + "]"


#: DuckDB twin of the query, written from the metric definitions.
OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, ws[i:i + 4] AS k, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 6)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM dup) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n, length(array_to_string(ws, '')) AS chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS sym, length(regexp_replace(t, '[^!]+', '', 'g')) AS bang,
             len(ls) AS nl, len(ls) - len(list_distinct(ls)) AS dl, coalesce(r, 0) AS r,
             len(list_filter(ws, lambda x: x IN {_sql_list(STOP_WORDS)})) AS st, strlen(t) < 1.5 * length(t) AS latin,
             len(list_filter(ls, lambda x: regexp_matches(x, '^\s*([-*•]|\d+[.)])\s'))) AS bl,
             len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS el
      FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n < 10 OR 100 * r > 20 * n AS bf FROM m)
SELECT doc_id, n::BIGINT AS n_words, chars::BIGINT AS word_chars, sym::BIGINT AS n_symbols,
       dl::BIGINT AS n_dup_lines, r::BIGINT AS n_repeat_words, bf AS base_failed,
       NOT bf AND chars >= 2 * n AND chars <= 25 * n AND 4 * sym <= n AND 4 * bang <= n
       AND NOT (n >= 40 AND latin AND (st / n < 0.04 OR st / n > 0.6)) AND 2 * dl <= nl
       AND NOT (n >= 40 AND bl > 0.9 * nl) AND NOT (n >= 40 AND 2 * el > nl) AS kept
FROM b
"""
