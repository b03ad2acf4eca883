"""Filing section extraction (F10, F11, F12) as Catalyst expressions.

All item headings of a filing are found in one pass; the priority list is a
choice among their codes, and the text is cut before each of them. (A pattern
per item would scan a text without items six times.)
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.text import SPACE, _bind

# ---------------------------------------------------------------------------
# These must equal the reference's for identical results.
# 8-K items tried in this priority (not by position in the text).
PRIORITY_8K_ITEMS = ("2.02", "1.01", "5.02", "8.01", "5.07")
# Java forms of the reference patterns (case-insensitive, dot matches newline).
# (``SPACE`` is Python's ``\s`` in Java form)
ITEM_8K_PATTERN = (r"(?dUiu)(?s)Item" + SPACE + r"+{code}[\s\S]+?(?=Item" + SPACE + r"+\d\.|$)")
ANY_ITEM_8K_PATTERN = (r"(?dUiu)(?s)(ITEM" + SPACE + r"*\d+\.\d+[\s\S]+?)(?=ITEM" + SPACE
                       + r"*\d+\.\d+|$)")
MDNA_PATTERN = (r"(?dUiu)(?s)Item" + SPACE + r"+7\.?" + SPACE + r"*Management's Discussion and Analysis"
                r"[\s\S]+?(?=Item" + SPACE + r"+[78]\.|Item" + SPACE + r"+\d{2}\.)")
FORM_8K = "8-K"
FORMS_MDNA = ("10-K", "10-Q")
# ---------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


_BARE = r"(?dUiu)^Item" + SPACE + r"+\d\.\d{2}"


def _by_pattern(c: Column, items=PRIORITY_8K_ITEMS) -> Column:
    """F10 read literally: a scan of the text per item, in priority."""
    tries = [F.regexp_substr(c, F.lit(ITEM_8K_PATTERN.format(code=code.replace(".", r"\."))))
             for code in items]
    tries.append(F.regexp_substr(c, F.lit(ANY_ITEM_8K_PATTERN)))
    return F.coalesce(*tries, c)


def heading_codes(c: Column) -> Column:
    """Codes (``2.02``) of all item headings of a text, in order."""
    return F.regexp_extract_all(c, F.lit(r"(?dUiu)Item" + SPACE + r"+(\d\.\d{0,2})"), F.lit(1))


def heading_pieces(c: Column) -> Column:
    """The text cut before each item heading."""
    return F.split(c, r"(?dUiu)(?=Item" + SPACE + r"+\d\.)", -1)


def _section_of(c: Column, codes: Column, pieces: Column, items=PRIORITY_8K_ITEMS) -> Column:
    """F10 by the headings: the item is chosen on their codes, its section is
    the piece that begins there."""
    at = F.coalesce(*[F.nullif(F.array_position(codes, F.lit(code)), F.lit(0)) for code in items])
    # a piece in front of the first heading, unless the text begins with it
    piece = F.get(pieces, (F.size(pieces) - F.size(codes) + at - 1).cast("int"))
    last = (at == F.size(codes)) & piece.endswith("\n") & ~piece.rlike(_BARE + r"\n\z")  # "$" stands before it
    section = F.when(last, F.substr(piece, F.lit(1), F.length(piece) - 1)).otherwise(piece)
    other = F.coalesce(F.regexp_substr(c, F.lit(ANY_ITEM_8K_PATTERN)), c)
    # nothing between an item's heading and the next: the pattern goes on to the one after
    return F.when(piece.isNull(), other).when(piece.rlike(_BARE + r"\z"), _by_pattern(c, items)).otherwise(section)


def _item_8k_expr(c: Column, items=PRIORITY_8K_ITEMS) -> Column:
    if not all(re.fullmatch(r"[0-9]\.[0-9]{2}", code) for code in items):
        return _by_pattern(c, items)  # codes of another form are not told apart by their headings
    return _bind(heading_codes(c), lambda codes: _bind(heading_pieces(c), lambda pieces: _section_of(c, codes, pieces, items)))


def with_relevant_section(df: DataFrame, text: str, form: str, out: str) -> DataFrame:
    """:func:`relevant_section` as a column, with headings and pieces staged as
    columns, so that each is made once and the work stays in generated code."""
    is_8k = F.upper(F.col(form)) == FORM_8K
    staged = df.withColumns({"_codes": F.when(is_8k, heading_codes(F.col(text))), "_pieces": F.when(is_8k, heading_pieces(F.col(text)))})
    section = (F.when(is_8k, _section_of(F.col(text), F.col("_codes"), F.col("_pieces")))
               .when(F.upper(F.col(form)).isin(*FORMS_MDNA), _mdna_expr(F.col(text))).otherwise(F.col(text)))
    return staged.withColumn(out, section).drop("_codes", "_pieces")


def _mdna_expr(c: Column) -> Column:
    return F.coalesce(F.regexp_substr(c, F.lit(MDNA_PATTERN)), c)


def item_8k(c: Column | str, items=PRIORITY_8K_ITEMS) -> Column:
    """first priority item that occurs, up to the next ``Item <d>.`` or
    the end; else the first ``ITEM n.n`` section; else the whole text."""
    return _bind(c, lambda v: _item_8k_expr(v, items))


def mdna(c: Column | str) -> Column:
    """the MD&A section of a 10-K; there is no end-of-text alternative,
    so a trailing MD&A (or none) gives the whole text."""
    return _bind(c, _mdna_expr)


def relevant_section(text: Column | str, form: Column | str) -> Column:
    """dispatch on the (per-row) form type, case-insensitively. Pass
    column *names* to keep the expression free of lambda bindings."""
    f = F.upper(_col(form))
    return _bind(text, lambda t: F.when(f == FORM_8K, _item_8k_expr(t))
                 .when(f.isin(*FORMS_MDNA), _mdna_expr(t))
                 .otherwise(t))
