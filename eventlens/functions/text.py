"""Text column operators: tag stripping, causal-keyword flag, boilerplate
removal, sentence selection and truncation.

Every function maps ``Column -> Column`` and is built from built-in
Catalyst expressions only (``regexp_replace``, ``split``, ``slice``,
``btrim``, ...); no Python runs per row. An expression that needs its input
several times binds it once with :func:`let` (a one-element ``transform``)
instead of copying the input's expression tree. Regexes are Java patterns;
the inline flags reproduce Python ``re`` semantics for ``str`` patterns:

* ``U`` Unicode ``\\s``/``\\w``/``\\b`` (Python's are Unicode, Java's ASCII),
* ``d`` only ``\\n`` ends a line for ``.``/``$`` (as in Python),
* ``iu`` Unicode case folding where Python uses ``re.IGNORECASE``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's ``\s`` for ``str`` patterns in Java form: Java's Unicode ``\s``
# (with the ``U`` flag) plus the four separators U+001C-U+001F, which Python
# also counts as whitespace.
SPACE = r"[\s\x1c-\x1f]"
SPACE_NOT_NL = r"[[\s\x1c-\x1f]&&[^\n]]"

# ---------------------------------------------------------------------------
# These must equal the reference's for identical results.
# Default causal phrases, in the reference's order.
CAUSAL_PHRASES = (
    "because", "due to", "as a result", "led to", "cause", "caused by", "causes",
    "trigger", "triggered", "triggers", "consequently", "therefore", "thus",
    "attributed to", "impact", "impacted by", "impacts", "following", "since",
    "affect", "affected by", "affects", "influence", "influenced by", "influences",
    "spur", "spurred by", "spurs", "stemmed from", "derive from", "responsible for",
    "explain", "explains", "explained by", "reason for", "rationale for", "driven by",
    "owe to", "owing to", "thanks to", "on account of", "resulting from", "outcome of",
    "prompted", "effect of", "consequence of", "factor in", "source of",
)
# Boilerplate patterns, applied in this order, each followed by a trim.
BOILERPLATE_PATTERNS = (
    r"(?dUiu)(?s)The information contained in this Current Report.*?shall not be deemed.*?filed.*?\.",
    r"(?dUiu)(?s)Pursuant to the requirements of the Securities Exchange Act of 1934.*?\.",
    r"(?dUiu)(?s)SIGNATURES.*$",
    r"(?dUiu)(?m)Exhibit" + SPACE + r"*\d+\.\d+.*$",
)
# Sentence boundary: whitespace after . ! ? and before an ASCII capital.
SENTENCE_BOUNDARY = r"(?dU)(?<=[.!?])" + SPACE + r"+(?=[A-Z])"
# HTML tag, spanning newlines.
TAG_PATTERN = r"<[^>]+>"
# Sentinels that are visible output.
NA = "N/A"
NA_CLEANED_EMPTY = "N/A (Cleaned to empty)"
# News and filing limits: (max_chars, max_sentences).
NEWS_LIMITS = (1500, 7)
FILING_LIMITS = (3000, 15)
# ---------------------------------------------------------------------------

# Characters Python's str.strip() removes (str.isspace()), derived by rule.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _bind(c: Column | str, body) -> Column:
    """``body(c)``; a column *name* is cheap to repeat, any other expression
    is bound once with :func:`let`."""
    return body(F.col(c)) if isinstance(c, str) else let(c, body)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable,
    so an expression that uses its input several times does not copy the
    input's expression tree (which can overflow generated-code limits)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def utrim(c: Column | str) -> Column:
    """Python's ``str.strip()``: trims every Unicode whitespace character
    (Spark's ``trim`` only removes spaces). ``btrim`` with a character set
    only looks at the ends of the text, unlike a regex, which scans it all."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def is_blank(c: Column | str) -> Column:
    """True for null or whitespace-only text."""
    c = _col(c)
    return c.isNull() | (utrim(c) == "")


def strip_tags(c: Column | str) -> Column:
    """delete every ``<...>`` span, then trim; null becomes ``''``."""
    return F.coalesce(utrim(F.regexp_replace(_col(c), TAG_PATTERN, "")), F.lit(""))


def _prefix_tree(phrases: list[str]) -> str:
    """Alternation of ``phrases`` factored by common prefixes. Java's regex
    engine tries alternatives one after another at every position, so the
    factored form (same set of matches) does far less work per position."""
    root: dict = {}
    for p in phrases:
        node = root
        for ch in p:
            node = node.setdefault(ch, {})
        node[""] = {}

    def emit(node: dict) -> str:
        kids = sorted(k for k in node if k)
        if not kids:
            return ""
        alts = [k + emit(node[k]) for k in kids]
        body = alts[0] if len(alts) == 1 else "(?:" + "|".join(alts) + ")"
        return "(?:" + body + ")?" if "" in node else body

    return emit(root)


# Python's \w for str (letters, all numbers, underscore); Java's Unicode \w
# differs (it counts combining marks and joiners, not superscript digits).
WORD_CHAR = r"[\p{L}\p{N}_]"


def keyword_pattern(phrases: Iterable[str] = CAUSAL_PHRASES) -> str:
    """Whole-word match of any phrase, one pass over the text: a first-letter
    check, then the phrases factored by common prefixes, bounded on both
    sides by a non-word character (Python's ``\b`` for phrases that start
    and end with a word character)."""
    phrases = list(phrases)
    for p in phrases:
        if not p or not p[0].isalnum() or not p[-1].isalnum() \
                or not all(ch.isalnum() or ch == " " for ch in p):
            raise ValueError(f"phrase must be letters, digits and inner spaces: {p!r}")
    first = "".join(sorted({p[0] for p in phrases}))
    return (r"(?=[" + first + r"])(?<!" + WORD_CHAR + ")" + _prefix_tree(phrases)
            + r"(?!" + WORD_CHAR + ")")


def has_causal_keyword(c: Column | str, phrases: Iterable[str] = CAUSAL_PHRASES) -> Column:
    """any phrase as a whole word in the lower-cased text; blank/null -> false."""
    return F.coalesce(F.lower(_col(c)).rlike(keyword_pattern(phrases)), F.lit(False))


def remove_boilerplate(c: Column | str) -> Column:
    """the four boilerplate patterns in order, trimming after each."""
    out = _col(c)
    for p in BOILERPLATE_PATTERNS:
        out = utrim(F.regexp_replace(out, p, ""))
    return out


def first_sentences(c: Column | str, max_sents: int) -> Column:
    """split at sentence boundaries, keep the first ``max_sents``, join by
    one space, trim."""
    parts = F.split(_col(c), SENTENCE_BOUNDARY, max_sents + 1)  # the rest of the text stays one part
    return utrim(F.array_join(F.slice(parts, 1, max_sents), " "))


def _before_last(head: Column, ch: str) -> Column:
    """Text of ``head`` before the last ``ch`` (``head`` must contain it)."""
    return head.substr(F.lit(1), F.length(head) - F.instr(F.reverse(head), ch))


def _truncate(c: Column, max_chars: int) -> Column:
    head = c.substr(1, max_chars)
    by_dot = F.concat(_before_last(head, "."), F.lit("."))
    by_space = F.concat(
        F.when(F.instr(head, " ") > 0, _before_last(head, " ")).otherwise(head),
        F.lit("..."))
    cut = F.when(F.instr(head, ".") > 0, by_dot).otherwise(by_space)
    return F.when(F.length(c) > max_chars, cut).otherwise(c)


def truncate_text(c: Column | str, max_chars: int) -> Column:
    """if longer than ``max_chars``, cut, then back off to the last ``.``
    (kept); with no dot, back off to the last space and append ``...``."""
    return _bind(c, lambda v: _truncate(v, max_chars))


def clean_and_truncate(c: Column | str, max_chars: int = 3000, max_sents: int = 15) -> Column:
    """boilerplate -> sentences -> truncation, with the reference's guards:
    null -> ``N/A``; ``N/A`` or blank text returned unchanged; an empty result
    becomes ``N/A (Cleaned to empty)``."""
    def guard(src: Column) -> Column:
        body = truncate_text(first_sentences(remove_boilerplate(src), max_sents), max_chars)
        return let(body, lambda b: F.when(src.isNull(), F.lit(NA))
                   .when((src == NA) | is_blank(src), src)
                   .when(b == "", F.lit(NA_CLEANED_EMPTY))
                   .otherwise(b))
    return _bind(c, guard)


def drop_blank_lines(c: Column | str) -> Column:
    """Trim, then remove whitespace-only lines (the text form of the HTML
    job's output when the input holds no markup)."""
    return F.regexp_replace(utrim(c), r"(?U)\n(?:" + SPACE_NOT_NL + r"*\n)+", "\n")


def with_clean_text(df, src: str, dst: str, max_chars: int = 3000, max_sents: int = 15):
    """F6 as staged columns of ``df``: the sentence selection and the
    truncation become intermediate columns, referenced by name, so each is
    computed once and the whole chain stays in whole-stage codegen (the
    :func:`clean_and_truncate` column form binds them with lambdas instead)."""
    sent, trunc = f"_{dst}_sent", f"_{dst}_trunc"
    c, t = F.col(src), F.col(trunc)
    return (df.withColumn(sent, first_sentences(remove_boilerplate(src), max_sents))
            .withColumn(trunc, _truncate(F.col(sent), max_chars))
            .withColumn(dst, F.when(c.isNull(), F.lit(NA))
                        .when((c == NA) | is_blank(c), c)
                        .when(t == "", F.lit(NA_CLEANED_EMPTY))
                        .otherwise(t))
            .drop(sent, trunc))
