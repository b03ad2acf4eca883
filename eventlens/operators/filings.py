"""Regulatory filings: preprocessing (T2), filing index (S5, W3, F14) and the
index-to-text job (T9)."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.functions.dates import parsed, to_date_or_null
from eventlens.functions.ids import document_url
from eventlens.functions.sections import with_relevant_section
from eventlens.functions.text import (CAUSAL_PHRASES, FILING_LIMITS, drop_blank_lines,
                                      has_causal_keyword, is_blank, with_clean_text)
from eventlens.operators.guards import require_columns
from eventlens.operators.html import CLEANING_DROP, EMPTY_INPUT, LANDING_DROP, html_to_text
from eventlens.plans.sizing import sized_side
from eventlens.schemas import FILING_EVENTS, FILINGS_REQUIRED
from eventlens.session import materialize

DEFAULT_FORM = "8-K"
FILINGS_PER_COMPANY = 5  # fixed value: latest filings kept per company


def preprocess_filings(df: DataFrame, form: str | Column = DEFAULT_FORM,
                       text_mode: str = "html", max_chars: int = FILING_LIMITS[0],
                       max_sents: int = FILING_LIMITS[1], phrases=CAUSAL_PHRASES) -> DataFrame:
    """``filing_id, filing_date, item_text, has_causal_keyword``
    (+ ``ticker``/``form`` when present).

    ``form`` is one form type for the table or a per-row Column (F12), so
    mixed forms run in one job. ``text_mode='html'`` parses the filing as
    HTML in Python (F9, cleaning variant); ``'plain'`` keeps the work in
    Catalyst for text that holds no markup (trim + blank-line removal, what
    the parser yields for such text)."""
    extra = [c for c in ("ticker", "form") if c in df.columns]
    checked = require_columns(df, FILINGS_REQUIRED, FILING_EVENTS, extra)
    if checked is not df:
        return checked
    form_col = form if isinstance(form, Column) else F.lit(form)
    d = parsed("filing_date", to_date_or_null("_date"),
               df.select(*extra, F.col("id").cast("string").alias("filing_id"), F.col("filing_date").alias("_date"),
                         form_col.alias("_form"), F.col("full_filing_text").alias("_raw"))).drop("_date")
    if text_mode == "html":
        d = html_to_text(d, "_raw", "_text", CLEANING_DROP, EMPTY_INPUT)
        empty = F.col("_text") == EMPTY_INPUT
    elif text_mode == "plain":
        d = d.withColumn("_text", drop_blank_lines("_raw"))
        empty = is_blank("_raw")
    else:
        raise ValueError("text_mode must be 'html' or 'plain'")
    d = with_relevant_section(d.withColumn("_empty", empty), "_text", "_form", "_section")
    d = with_clean_text(d, "_section", "_item", max_chars, max_sents)
    d = d.select(*extra, "filing_id", "filing_date",
                 F.when(F.col("_empty"), F.lit(EMPTY_INPUT)).otherwise(F.col("_item")).alias("item_text"))
    return d.withColumn("has_causal_keyword", has_causal_keyword("item_text", phrases))


def explode_index(index: DataFrame) -> DataFrame:
    """S5 input: the struct-of-arrays index (one row per company) -> one row
    per filing with its position. Per-row array work, no shuffle."""
    z = F.arrays_zip("accessionNumber", "form", "filingDate", "primaryDocument")
    return (index.select("cik", F.posexplode(z).alias("pos", "f"))
            .select("cik", "pos", F.col("f.accessionNumber").alias("accession"),
                    F.col("f.form").alias("form"), F.col("f.filingDate").alias("filing_date"),
                    F.col("f.primaryDocument").alias("primary_document")))


def latest_from_index(index: DataFrame, form: str = DEFAULT_FORM,
                      n: int = FILINGS_PER_COMPANY) -> DataFrame:
    """S5/W3/P8 on the landed index: keep ``form``, first ``n`` in source
    order, derive the document URL. Each company's arrays are one row, so
    ``filter`` + ``slice`` on the arrays does it without any shuffle."""
    z = F.arrays_zip("accessionNumber", "form", "filingDate", "primaryDocument")
    picked = F.slice(F.filter(z, lambda e: e["form"] == F.lit(form)), 1, n)
    rows = index.select("cik", F.explode(picked).alias("f"))
    return rows.select(F.col("f.accessionNumber").alias("id"),
                       F.col("f.filingDate").alias("filing_date"),
                       document_url("cik", "f.accessionNumber", "f.primaryDocument").alias("html_url"),
                       "cik")


def latest_filings(filings: DataFrame, form: str = DEFAULT_FORM, n: int = FILINGS_PER_COMPANY,
                   order_by: tuple[str, ...] = ("pos",)) -> DataFrame:
    """S5/W3/P8 on a long index (one row per filing: ``cik, accession, form,
    filing_date, primary_document`` and ordering columns): first ``n`` of
    ``form`` per company. ``row_number() <= n`` lets Spark insert a partial
    per-key limit before the shuffle (WindowGroupLimit), so a company with a
    huge share of filings sends at most ``n`` rows per map task."""
    w = Window.partitionBy("cik").orderBy(*order_by)
    ranked = (filings.where(F.col("form") == form)
              .withColumn("_rn", F.row_number().over(w))
              .where(F.col("_rn") <= n))
    return ranked.select(F.col("accession").alias("id"), "filing_date",
                         document_url("cik", "accession", "primary_document").alias("html_url"),
                         "cik", F.col("_rn").cast("long").alias("rank"))


def _place() -> list[Column]:
    return [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "row_index")]


def page_places(spark: SparkSession, path: str, url: str | Column = "url") -> DataFrame:
    """``html_url, file_path, row_index``: where each page of a landed Parquet
    table stands. The scan reads the columns of the URL only, not the pages."""
    u = F.col(url) if isinstance(url, str) else url
    return spark.read.parquet(path).select(u.alias("html_url"), *_place())


FETCH_ROWS = 1_000_000  # places (some 100 bytes each) that are sent to the tasks at a time
FETCH_FILES = 10_000  # paths in one scan


def _file_groups(files: list[tuple[str, int]], max_rows: int) -> list[list[str]]:
    """Files in groups of at most ``max_rows`` wanted rows; a file with more is one alone."""
    groups: list[list[str]] = []
    held = 0
    for path, n in files:
        if not groups or held + n > max_rows or len(groups[-1]) == FETCH_FILES:
            groups.append([])
            held = 0
        groups[-1].append(path)
        held += n
    return groups


def fetch_pages(places: DataFrame, html_col: str = "html", max_rows: int = FETCH_ROWS) -> DataFrame:
    """``places`` (``file_path, row_index`` and keys) with the page at each place.

    Late fetch: only files that hold a wanted page are scanned, each once, and
    the places are sent to that scan, never the pages to the places: no exchange
    carries a page, however many are wanted. The driver sees one row per file; the places
    go out in groups of files of at most ``max_rows`` places, so what is
    broadcast is bounded (a file with more has its places split by row)."""
    spark = places.sparkSession
    held = materialize(places)
    files = sorted((r.file_path, r.n) for r in held.groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).collect())
    wanted = dict(files)
    parts = []
    for group in _file_groups(files, max_rows):
        pages = spark.read.parquet(*[unquote(f) for f in group]).select(F.col(f"`{html_col}`"), *_place())
        own = held.where(F.col("file_path").isin(group))
        pieces = -(-wanted[group[0]] // max_rows) if len(group) == 1 else 1
        for k in range(pieces):
            some = own.where(F.pmod("row_index", F.lit(pieces)) == k) if pieces > 1 else own
            parts.append(pages.join(F.broadcast(some), ["file_path", "row_index"]))
    if not parts:
        kind = T.StructType(held.schema.fields + [T.StructField(html_col, T.StringType())])
        return spark.createDataFrame([], kind)
    return reduce(DataFrame.unionByName, parts)


def filings_with_text(index_rows: DataFrame, places: DataFrame, strategy: str = "auto",
                      html_col: str = "html", max_rows: int = FETCH_ROWS) -> DataFrame:
    """Latest-filing rows with the text of their landed page (F9, landing
    variant); a filing without a landed page keeps a null text.

    ``places`` says where each landed page stands (:func:`page_places`). Keys
    and places meet first, then only the matched pages are read
    (:func:`fetch_pages`) and parsed, and their texts (one per index row at
    most) are attached to the index."""
    wanted = index_rows.select("html_url").distinct()
    matched = places.join(sized_side(wanted, strategy=strategy), "html_url", "left_semi")
    matched = matched.groupBy("html_url").agg(F.min(F.struct("file_path", "row_index")).alias("p")).select("html_url", "p.*")
    pages = fetch_pages(matched, html_col, max_rows).select("html_url", html_col)
    texts = html_to_text(pages, html_col, "full_filing_text", LANDING_DROP, empty_value=None).drop(html_col)
    return index_rows.join(sized_side(texts, strategy=strategy), "html_url", "left")
