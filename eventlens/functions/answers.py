"""Prompt building (F17) and free-form answer parsing.

Both are Catalyst expressions: the prompt is a ``concat`` of fixed text and
JSON-quoted values; the answer parser extracts ``{...}`` candidates with a
regex, parses each with ``from_json`` into a map, takes the first that parses
and falls back to per-key regexes when none does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference's for identical results.
SYSTEM_PROMPT = (
    "You are a meticulous financial analyst.\n"
    "Given an event summary and the next-day move, decide assoc & causal.\n"
    'Return exactly one JSON: {"assoc":"Yes|No","causal":"Yes|No","cause":"…","effect":"…"}'
)
FEW_SHOT_EXAMPLES = (
    'User: {"event":"X beats earnings","reaction":"Significant Up"}\n'
    'Assistant: {"assoc":"Yes","causal":"Yes","cause":"X beats earnings","effect":"Stock up significantly"}\n'
    "\n"
    'User: {"event":"Routine filing","reaction":"Flat"}\n'
    'Assistant: {"assoc":"No","causal":"No","cause":"Routine filing","effect":"Stock flat"}'
)
EVENT_PROMPT_CHARS = 1024
RAW_ANSWER_CHARS = 300
PARSE_ERR_CAUSAL = "ParseErr_Causal"
PARSE_ERR_ASSOC = "ParseErr_Assoc"
NO_TEXT = "N/A"
YES_WORDS = ("yes", "true", "y", "是")
FENCE_PATTERN = r"```(?:json)?[\s\S]*?```"
OBJECT_PATTERN = r"\{[\s\S]*?\}"
# ---------------------------------------------------------------------------

PROMPT_PREFIX = f"System: {SYSTEM_PROMPT}\n\n{FEW_SHOT_EXAMPLES}\n\nUser: "
PROMPT_SUFFIX = "\nAssistant:"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# JSON string escapes as Python's json.dumps(ensure_ascii=False) writes them:
# backslash and quote, five short forms, \u00xx (lower-case hex) for the other
# control characters; every other character is kept as is.
_SHORT_ESCAPES = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def json_quote(c: Column | str) -> Column:
    """A value as a JSON literal (``"..."`` with escapes, or ``null``). The
    rare control characters are only searched for when one is present."""
    from eventlens.functions.text import let

    x = _col(c).cast("string")
    x = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    x = F.replace(x, F.lit('"'), F.lit('\\"'))
    for ch, esc in _SHORT_ESCAPES.items():
        x = F.replace(x, F.lit(ch), F.lit(esc))

    def rare(v: Column) -> Column:
        out = v
        for code in range(0x20):
            if chr(code) not in _SHORT_ESCAPES:
                out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
        return F.when(v.rlike("[\\x00-\\x1f]"), out).otherwise(v)

    return F.coalesce(F.concat(F.lit('"'), let(x, rare), F.lit('"')), F.lit("null"))


def build_prompt(event_text: Column | str, reaction: Column | str) -> Column:
    """system text + worked examples + ``{"event": ..., "reaction": ...}``
    with the event cut to 1,024 characters. Python's ``json.dumps`` writes
    ``", "`` and ``": "`` separators, so the payload is assembled by hand."""
    payload = F.concat(
        F.lit('{"event": '), json_quote(_col(event_text).substr(1, EVENT_PROMPT_CHARS)),
        F.lit(', "reaction": '), json_quote(reaction), F.lit("}"))
    return F.concat(F.lit(PROMPT_PREFIX), payload, F.lit(PROMPT_SUFFIX))


def _yes_no(v: Column) -> Column:
    return F.when(F.lower(F.coalesce(v, F.lit("None"))).isin(*YES_WORDS), F.lit("Yes")).otherwise(F.lit("No"))


def _last_value(m: Column, key: str) -> Column:
    """Value of the last ``key`` entry (Python's dict keeps the last duplicate)."""
    entries = F.filter(F.map_entries(m), lambda e: e["key"] == F.lit(key))
    return F.element_at(entries, -1)["value"]


def _answer_text(raw: Column | str, unwrap_fences: bool) -> Column:
    """The trimmed answer without its fenced blocks (or with their content only)."""
    from eventlens.functions.text import utrim

    t = utrim(F.coalesce(_col(raw), F.lit("")))
    if unwrap_fences:
        return F.regexp_replace(t, r"```(?:json)?([\s\S]*?)```", "$1")
    return F.regexp_replace(t, FENCE_PATTERN, "")


def _first_object(t: Column) -> Column:
    """The first ``{...}`` candidate that is valid JSON, as a map."""
    cands = F.regexp_extract_all(t, F.lit(OBJECT_PATTERN), F.lit(0))
    maps = F.transform(cands, lambda x: F.from_json(
        x, "map<string,string>", {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}))
    return F.get(F.filter(maps, lambda m: m.isNotNull()), 0)


def _answer_fields(t: Column, obj: Column) -> list[Column]:
    """``causal, assoc, cause, effect`` from the answer text and its first object."""
    from eventlens.functions.text import SPACE, utrim

    def from_obj(key: str, default: str, kind: str) -> Column:
        v = _last_value(obj, key)
        val = _yes_no(v) if kind == "label" else utrim(F.coalesce(v, F.lit("None")))
        return F.when(F.map_contains_key(obj, key), val).otherwise(F.lit(default))

    def from_regex(key: str, default: str, kind: str) -> Column:
        g = F.regexp_extract(t, rf'(?iuU)"{key}"{SPACE}*:{SPACE}*"([^"]+)"', 1)
        val = _yes_no(g) if kind == "label" else utrim(g)
        return F.when(g != "", val).otherwise(F.lit(default))

    return [F.when(t == "", F.lit(default))
            .when(obj.isNotNull(), from_obj(key, default, kind))
            .otherwise(from_regex(key, default, kind)).alias(key)
            for key, default, kind in (("causal", PARSE_ERR_CAUSAL, "label"),
                                       ("assoc", PARSE_ERR_ASSOC, "label"),
                                       ("cause", NO_TEXT, "text"),
                                       ("effect", NO_TEXT, "text"))]


def parse_answer(raw: Column | str, unwrap_fences: bool = False) -> Column:
    """struct<causal, assoc, cause, effect> parsed from a model answer.

    * blank/null -> defaults (``ParseErr_*``, ``N/A``);
    * fenced blocks are removed *with their content* (reference behaviour;
      ``unwrap_fences=True`` keeps the content instead);
    * the first ``{...}`` candidate (non-greedy) that is valid JSON wins,
      even without any of the keys; ``causal``/``assoc`` map to Yes/No,
      ``cause``/``effect`` to trimmed text;
    * if none parses, per-key regexes on quoted string values, any case.

    Every extraction from this column parses again (Spark resolves its lambdas
    anew each time); for several fields use :func:`with_parsed_answer`.
    """
    from eventlens.functions.text import let

    # the stripped text and the first valid object are each computed once per
    # row and shared by the four fields
    return let(_answer_text(raw, unwrap_fences),
               lambda t: let(_first_object(t), lambda obj: F.struct(*_answer_fields(t, obj))))


def with_parsed_answer(df: DataFrame, raw: str, prefix: str = "", suffix: str = "",
                       unwrap_fences: bool = False) -> DataFrame:
    """F18 staged: ``df`` plus one column ``<prefix><field><suffix>`` for each
    of the four fields of :func:`parse_answer`. The text and its first object
    are columns of their own, so an answer is parsed once for all fields, and
    a field that nobody reads is pruned."""
    staged = df.withColumn("_answer", _answer_text(raw, unwrap_fences))
    staged = staged.withColumn("_object", _first_object(F.col("_answer")))
    names = [f"{prefix}{k}{suffix}" for k in ("causal", "assoc", "cause", "effect")]
    fields = _answer_fields(F.col("_answer"), F.col("_object"))
    return staged.withColumns(dict(zip(names, fields))).drop("_answer", "_object")


def keep_raw(raw: Column | str) -> Column:
    """first 300 characters of the raw answer."""
    return _col(raw).substr(1, RAW_ANSWER_CHARS)
