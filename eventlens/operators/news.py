"""News preprocessing (T1, F7, F8): landed articles -> dated, cleaned events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.dates import parsed, published_at_utc
from eventlens.functions.text import (NEWS_LIMITS, CAUSAL_PHRASES, has_causal_keyword,
                                      strip_tags, with_clean_text)
from eventlens.operators.guards import require_columns
from eventlens.schemas import NEWS_EVENTS, NEWS_REQUIRED


def summary_from_description(c: Column | str) -> Column:
    """F8: a JSON list of objects -> the ``content`` of the items that have
    one, joined by a space; any other text -> itself. Then tags stripped."""
    c = F.col(c) if isinstance(c, str) else c
    opts = {"allowSingleQuotes": "false"}
    # any JSON array parses as array<string> (objects kept as their JSON text);
    # each item is then read as an object: non-objects and objects without
    # ``content`` give null, which array_join skips
    items = F.from_json(c, "array<string>", opts)
    contents = F.transform(items, lambda x: F.from_json(x, "struct<content:string>", opts)["content"])
    return strip_tags(F.coalesce(F.array_join(contents, " "), c))


def _published_date(published_at: Column) -> Column:
    return published_at.getField("date")


def preprocess_news(df: DataFrame, max_chars: int = NEWS_LIMITS[0],
                    max_sents: int = NEWS_LIMITS[1], phrases=CAUSAL_PHRASES) -> DataFrame:
    """``news_id, published_datetime_utc, published_date_utc, title,
    summary, has_causal_keyword`` (+ ``ticker`` when the input has it).
    Rows whose publication time does not parse are dropped."""
    extra = [c for c in ("ticker",) if c in df.columns]
    checked = require_columns(df, NEWS_REQUIRED, NEWS_EVENTS, extra)
    if checked is not df:
        return checked
    d = parsed("published_datetime_utc", published_at_utc(_published_date(F.col("publishedAt"))),
               df.select(*extra, F.col("articlesId").cast("string").alias("news_id"), "publishedAt",
                         "articlesName", "articlesDescription"))
    d = d.select(*extra, "news_id", "published_datetime_utc",
                 F.to_date("published_datetime_utc").alias("published_date_utc"),
                 strip_tags("articlesName").alias("title"),
                 summary_from_description("articlesDescription").alias("_summary_raw"))
    d = with_clean_text(d, "_summary_raw", "summary", max_chars, max_sents).drop("_summary_raw")
    return d.withColumn("has_causal_keyword", has_causal_keyword("summary", phrases))
