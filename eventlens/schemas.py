"""Declared schemas for every table this package reads or writes (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampType(),
          "double": T.DoubleType(), "bigint": T.LongType(), "int": T.IntegerType(),
          "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType())}


def _struct(spec: str) -> T.StructType:
    """``"a string, b date"`` -> StructType (flat fields of the types above)."""
    fields = []
    for part in spec.split(","):
        name, typ = part.split()
        fields.append(T.StructField(name, _TYPES[typ]))
    return T.StructType(fields)


RAW_FILINGS = _struct(
    "id string, filing_date string, html_url string, text_preview_from_api string, "
    "full_filing_text string")
RAW_NEWS = T.StructType([
    T.StructField("articlesId", T.StringType()),
    T.StructField("publishedAt", T.StructType([T.StructField("date", T.StringType())])),
    T.StructField("articlesName", T.StringType()),
    T.StructField("articlesDescription", T.StringType()),
])
NEWS_PAGE = T.StructType([
    T.StructField("articles", T.ArrayType(RAW_NEWS)),
    T.StructField("allPages", T.IntegerType()),
])
PAGE_NUMBERS = _struct("page int, allPages int")  # of pages that carry their number
FILING_INDEX = T.StructType([T.StructField("cik", T.StringType())] + [
    T.StructField(c, T.ArrayType(T.StringType()))
    for c in ("accessionNumber", "form", "filingDate", "primaryDocument")])
NEWS_EVENTS = _struct(
    "news_id string, published_datetime_utc timestamp, published_date_utc date, "
    "title string, summary string, has_causal_keyword boolean")
FILING_EVENTS = _struct(
    "filing_id string, filing_date date, item_text string, has_causal_keyword boolean")
RESULTS = _struct(
    "model string, event_id string, ticker string, ground_causal string, ground_assoc string, "
    "causal_llm_pred string, assoc_llm_pred string, cause_llm_pred string, "
    "effect_llm_pred string, raw_llm string")
MACRO = _struct("date date, CPIAUCSL double")

NEWS_REQUIRED = ("articlesId", "publishedAt", "articlesName", "articlesDescription")
FILINGS_REQUIRED = ("id", "filing_date", "full_filing_text")
# Price file headers as the download writes them -> our snake-case names.
PRICE_RENAMES = {"Date": "trade_date", "Open": "open", "High": "high", "Low": "low",
                 "Close": "close", "Adj Close": "adj_close", "Volume": "volume"}
