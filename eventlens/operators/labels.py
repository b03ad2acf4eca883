"""Labelling sheets and benchmark event tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.operators.align import reference_name

REFERENCE_NAME = re.compile(r"(ret_pct|cat)_D\+?(\d+)")


def snake_name(col: str) -> str:
    """``ret_pct_D+1`` -> ``ret_pct_d1``, ``cat_D0`` -> ``cat_d0``; others as they are
    (the inverse of :func:`eventlens.operators.align.reference_name`)."""
    m = REFERENCE_NAME.fullmatch(col)
    return f"{m[1]}_d{int(m[2])}" if m else col


LABEL_COLUMNS = ("causal_label", "assoc_label")


def annotation_sheet(aligned: DataFrame) -> DataFrame:
    """P10/T5: the aligned table plus empty label columns for annotators."""
    return aligned.withColumns({c: F.lit("") for c in LABEL_COLUMNS})


def standardise(df: DataFrame, ticker: str, id_col: str, text_col: str) -> DataFrame:
    """P5: add the ticker, rename id/text to ``event_id``/``event_text`` and
    un-prefix ``{ticker}_*`` columns (every occurrence of the prefix in a
    matching name is removed, as the reference does). Return and category
    columns get this package's names, so the benchmark finds the reaction."""
    pre = f"{ticker}_"
    cols = []
    for c in df.columns:
        if c == id_col:
            name = "event_id"
        elif c == text_col:
            name = "event_text"
        elif c.startswith(pre):
            name = c.replace(pre, "")
        else:
            name = c
        cols.append(F.col(f"`{c}`").alias(snake_name(name)))
    return df.select(F.lit(ticker).alias("ticker"), *[c for c in cols])


def standardise_files(lines: DataFrame, types: T.StructType, id_col: str, text_col: str) -> DataFrame:
    """P5 for all tickers at once: ``lines`` has a ``ticker`` and a JSON object
    in ``value``, whose members may have the ticker in their names. Gives
    ``ticker``, ``event_id``, ``event_text`` and the other columns of ``types``
    (this package's names), without a job or a plan branch per ticker."""
    m = F.col("_m")
    cols = []
    for f in types.fields:
        own = F.concat(F.col("ticker"), F.lit(f"_{reference_name(f.name)}"))
        value = F.coalesce(F.try_element_at(m, own), F.try_element_at(m, F.lit(f.name)))
        name = {id_col: "event_id", text_col: "event_text"}.get(f.name, f.name)
        cols.append((value if isinstance(f.dataType, T.StringType) else value.try_cast(f.dataType)).alias(name))
    return lines.select("ticker", F.from_json("value", "map<string,string>").alias("_m")).select("ticker", *cols)


#: Number types, each of which holds all values of those before it (a double
#: only up to 53 bits of a whole number, as in pandas).
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.FloatType, T.DoubleType)


def common_type(types: Sequence[T.DataType]) -> T.DataType:
    """The type that a column of these types in different tables gets: null
    gives way to any, numbers widen, dates widen to timestamps, and whatever
    has no common type but text is text."""
    kinds = [t for t in dict.fromkeys(types) if not isinstance(t, T.NullType)]
    if len(kinds) <= 1:
        return kinds[0] if kinds else T.NullType()
    if all(isinstance(t, T.DecimalType) for t in kinds):
        scale = max(t.scale for t in kinds)
        whole = max(t.precision - t.scale for t in kinds)
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.DoubleType()
    if all(isinstance(t, _NUMBERS) for t in kinds):
        if any(isinstance(t, (T.DecimalType, T.FloatType, T.DoubleType)) for t in kinds):
            return T.DoubleType()
        return max(kinds, key=lambda t: [isinstance(t, n) for n in _NUMBERS].index(True))
    if all(isinstance(t, (T.DateType, T.TimestampType)) for t in kinds):
        return T.TimestampType()
    return T.StringType()


def _as_type(c: Column, own: T.DataType, wanted: T.DataType) -> Column:
    if own == wanted:
        return c
    if isinstance(wanted, T.StringType) and isinstance(own, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast(wanted)


def union_events(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate event tables with differing columns (missing -> null).
    A column whose type differs between tables gets their common type
    (:func:`common_type`), so text beside numbers loses nothing; nested values
    become JSON text there. Only casts are added: no pass over the data."""
    names = list(dict.fromkeys(f.name for df in frames for f in df.schema.fields))
    own = [{f.name: f.dataType for f in df.schema.fields} for df in frames]
    wanted = {n: common_type([t[n] for t in own if n in t]) for n in names}
    same = [df.select(*[_as_type(F.col(f"`{c}`"), t[c], wanted[c]).alias(c) for c in df.columns]) for df, t in zip(frames, own)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), same)
