"""Date/number coercion and formatting column operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISO_TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Date texts accepted after ISO 8601, with the shape of each (month before
#: day); a clock time ``HH:mm:ss`` may follow. No text has two of these shapes.
DATE_SHAPES = (
    ("MMM d, yyyy", r"[A-Za-z]{3} \d{1,2}, \d{4}"), ("MMMM d, yyyy", r"[A-Za-z]{4,} \d{1,2}, \d{4}"),
    ("d MMM yyyy", r"\d{1,2} [A-Za-z]{3} \d{4}"), ("d MMMM yyyy", r"\d{1,2} [A-Za-z]{4,} \d{4}"),
    ("M/d/yyyy", r"\d{1,2}/\d{1,2}/\d{4}"), ("yyyy/M/d", r"\d{4}/\d{1,2}/\d{1,2}"), ("yyyyMMdd", r"\d{8}"))
DATE_FORMATS = tuple(f for f, _ in DATE_SHAPES)
_TIME = r" \d{2}:\d{2}:\d{2}"
_CLOCK = r"^\s*T?\d{1,2}:\d{2}"  # a time without a date would mean today


def _format_of(text: Column) -> Column:
    """The date format whose shape the text has, or null."""
    day = F.when(F.lit(False), F.lit(None).cast("string"))
    for f, shape in DATE_SHAPES:
        day = day.when(text.rlike(f"^{shape}(?:{_TIME})?$"), F.lit(f))
    return F.concat(day, F.when(text.rlike(f"{_TIME}$"), F.lit(" HH:mm:ss")).otherwise(F.lit("")))


def _try_timestamp(text: Column) -> Column:
    """One parse as ISO 8601 and, where that fails, one in the format of the text's shape."""
    return F.when(~text.rlike(_CLOCK), F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, _format_of(text))))


def parsed(name: str, value: Column, df: DataFrame) -> DataFrame:
    """``df`` with the rows whose ``value`` is not null, and the value as
    ``name``. A filter on the value would be pushed below its projection and
    compute it twice; here each row's value is computed once."""
    return df.select("*", F.explode(F.array_compact(F.array(value))).alias(name))


def published_at_utc(c: Column | str) -> Column:
    """text before the first ``.``, ``Z`` -> ``+00:00``, parsed as a UTC
    timestamp (session time zone UTC): ISO 8601 or one of ``DATE_FORMATS``;
    anything else, a time without a date included -> null.
    An offset after the fraction is lost with the fraction, as in the
    reference, so such a time is read as UTC."""
    head = F.split_part(_col(c), F.lit("."), F.lit(1))
    return _try_timestamp(F.replace(head, F.lit("Z"), F.lit("+00:00")))


def to_date_or_null(c: Column | str) -> Column:
    """date coercion, bad -> null (accepts dates, timestamps and text in
    ISO 8601 or one of ``DATE_FORMATS``)."""
    text = F.trim(_col(c).cast("string"))
    other = F.try_to_timestamp(text, _format_of(text)).cast("date")
    return F.when(~text.rlike(_CLOCK), F.coalesce(F.try_to_date(text), other))


def to_double_or_null(c: Column | str) -> Column:
    """F16: numeric coercion, bad -> null; NaN is normalised to null."""
    d = _col(c).cast("string").try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def iso_date(c: Column | str) -> Column:
    """ISO-8601 date text."""
    return F.date_format(_col(c), "yyyy-MM-dd")


def iso_timestamp(c: Column | str) -> Column:
    """ISO-8601 timestamp text (UTC session)."""
    return F.date_format(_col(c), ISO_TIMESTAMP)
