"""Driver queries: one per operator group of the survey, each over the given
tables (through :mod:`eventlens.plans.bindings`), returning a DataFrame.

Computed doubles are rounded to 6 places on both sides (exact sums are used
where a mean is needed), dates kept as DATE and timestamps written as ISO
text, so results compare exactly with the SQL twins in
:mod:`eventlens.plans.oracle`.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.functions.answers import build_prompt
from eventlens.functions.dates import iso_date, iso_timestamp
from eventlens.functions.sections import item_8k, mdna, relevant_section
from eventlens.functions.sql import register_sql_functions
from eventlens.functions.text import (NEWS_LIMITS, drop_blank_lines, first_sentences,
                                      remove_boilerplate, strip_tags, truncate_text,
                                      with_clean_text)
from eventlens.operators.align import align_events, empty_returns, to_wide
from eventlens.operators.calendar import align_next_trading_day
from eventlens.operators.filings import filings_with_text as t9_filings_with_text
from eventlens.operators.filings import latest_filings as s5_latest_filings
from eventlens.operators.filings import preprocess_filings
from eventlens.operators.guards import nan_to_null, optional_col
from eventlens.operators.html import html_to_text
from eventlens.operators.labels import LABEL_COLUMNS, standardise_files, union_events
from eventlens.operators.labels import annotation_sheet as t5_annotation_sheet
from eventlens.operators.metrics import report, score
from eventlens.operators.news import preprocess_news
from eventlens.operators.predict import keyword_predictor
from eventlens.operators.returns import prune_prices, returns_table
from eventlens.plans import bindings as B
from eventlens.plans.pipeline import (align_and_save, align_pipeline, annotate, benchmark_events,
                                      convert, results_from_answers, run_benchmark)
from eventlens.plans.sizing import sized_side
from eventlens.session import scratch_path
from eventlens.sources import readers, writers
from eventlens.schemas import PAGE_NUMBERS, RAW_NEWS
from eventlens.sources.landing import missing_pages, to_pages

RETURN_OUT = ("adj_close", "ret_pct_d0", "cat_d0", "ret_pct_d1", "cat_d1", "ret_pct_d2", "cat_d2")


def r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 places (same rule in the SQL twins)."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), 6).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


# ---------------------------------------------------------------- building blocks
def _returns(spark: SparkSession, d: str) -> DataFrame:
    return returns_table(B.bars(spark, d))


def _news(spark: SparkSession, d: str) -> DataFrame:
    return preprocess_news(B.news_raw(spark, d))


def _filings(spark: SparkSession, d: str) -> DataFrame:
    return preprocess_filings(B.filings_raw(spark, d), F.col("form"), text_mode="plain")


def _aligned_news(spark: SparkSession, d: str) -> DataFrame:
    news = _news(spark, d).withColumnRenamed("published_date_utc", "event_date")
    # only the columns used below are materialised with the returns side
    return align_events(news, returns_table(B.bars(spark, d), keep_bars=False), "event_date")


# ---------------------------------------------------------------- returns
def daily_returns(spark, d):
    return r6(_returns(spark, d))


def returns_from_price_table(spark, d):
    """T3 from a price table bucketed by ticker: no exchange and no sort before the window."""
    name = f"prices_{uuid.uuid4().hex}"
    path = scratch_path(spark, "price-table")
    writers.write_price_table(B.bars(spark, d), name, path, 8)
    return r6(returns_table(spark.table(name)))


def return_categories(spark, d):
    r = _returns(spark, d)
    long = r.select("ticker", F.expr(
        "stack(3, 'D0', cat_d0, 'D+1', cat_d1, 'D+2', cat_d2) as (horizon, category)"))
    return long.groupBy("ticker", "horizon", "category").agg(F.count(F.lit(1)).alias("n_days"))


def price_range_prune(spark, d):
    """A1: daily prices over all shipping days, kept around the days of all orders."""
    return r6(prune_prices(B.ship_bars(spark, d), B.order_events(spark, d), "event_date")
              .select("ticker", "trade_date", "adj_close"))


def returns_from_raw_bars(spark, d):
    """S7/T3 from a landed price CSV with download headers and some bad values."""
    b = B.bars(spark, d)
    bad_day = F.dayofmonth("trade_date") == 15
    raw = b.select(
        F.col("ticker"),
        F.when(bad_day & (F.col("ticker") == "ERROR"), F.lit("2024-13-45"))
        .otherwise(F.col("trade_date").cast("string")).alias("Date"),
        *[F.col(c).cast("string").alias(h) for c, h in
          (("open", "Open"), ("high", "High"), ("low", "Low"), ("close", "Close"))],
        F.when(F.dayofmonth("trade_date") == 10, F.lit("n/a"))
        .otherwise(F.col("adj_close").cast("string")).alias("Adj Close"),
        F.col("volume").cast("string").alias("Volume"))
    path = scratch_path(spark, "prices")
    writers.write_csv(raw, path)
    return r6(returns_table(readers.read_prices(spark, path, "csv")))


# ---------------------------------------------------------------- alignment
def align_events_q(spark, d):
    a = _aligned_news(spark, d)
    return r6(a.select("news_id", "ticker", "event_date", "has_causal_keyword", *RETURN_OUT))


def align_empty_prices(spark, d):
    news = _news(spark, d).withColumnRenamed("published_date_utc", "event_date")
    a = align_events(news, empty_returns(spark, keep_bars=False), "event_date")
    return a.select("news_id", "ticker", "event_date", *RETURN_OUT)


def align_next_day(spark, d):
    """J1 as of the next trading day, on bars of weekdays (weekend trades count to Monday)."""
    news = _news(spark, d).withColumnRenamed("published_date_utc", "event_date")
    returns = returns_table(B.bars(spark, d, weekdays=True), keep_bars=False)
    a = align_next_trading_day(news.select("news_id", "ticker", "event_date"), returns, max_gap_days=5)
    return r6(a.select("news_id", "ticker", "event_date", "trade_date", *RETURN_OUT))


def align_wide_prefixed(spark, d):
    a = _aligned_news(spark, d).select("news_id", "ticker", "event_date", *RETURN_OUT)
    return r6(to_wide(a, B.TICKERS, RETURN_OUT))


def _aligned_sources(spark, d):
    """T8 over the bindings: news + filings (per-row form, markup-free text)."""
    return align_pipeline(B.news_raw(spark, d), B.filings_raw(spark, d), B.bars(spark, d),
                          filing_form=F.col("form"), filing_text_mode="plain")


def align_all_tickers(spark, d):
    aligned = _aligned_sources(spark, d)
    n = aligned["news"].select(
        F.lit("news").alias("source"), F.col("news_id").alias("event_id"), "ticker", "event_date",
        "has_causal_keyword", "cat_d0", "cat_d1", "cat_d2")
    f = aligned["filings"].select(
        F.lit("filings").alias("source"), F.col("filing_id").alias("event_id"), "ticker",
        "event_date", "has_causal_keyword", "cat_d0", "cat_d1", "cat_d2")
    return n.unionByName(f).withColumn("event_date", iso_date("event_date"))


# ---------------------------------------------------------------- text
def strip_tags_q(spark, d):
    p = B.table(spark, d, "pages", ("page_id", "html"))
    return p.select("page_id", strip_tags("html").alias("text"))


def keyword_screen(spark, d):
    n = _news(spark, d)
    return n.groupBy("ticker").agg(F.count_if("has_causal_keyword").alias("n_keyword"),
                                   F.count(F.lit(1)).alias("n_events"))


def clean_boilerplate(spark, d):
    f = B.filings_raw(spark, d)
    return f.select("id", remove_boilerplate("full_filing_text").alias("cleaned"))


def first_sentences_q(spark, d):
    t = B.table(spark, d, "documents", ("doc_id", "text"))
    return t.select("doc_id", first_sentences("text", NEWS_LIMITS[1]).alias("sentences"))


def truncate_text_q(spark, d):
    t = B.table(spark, d, "documents", ("doc_id", "text"))
    return t.select("doc_id", truncate_text("text", 300).alias("truncated"))


def clean_text(spark, d):
    t = B.table(spark, d, "documents", ("doc_id", "text"))
    return with_clean_text(t, "text", "cleaned", *NEWS_LIMITS).select("doc_id", "cleaned")


# ---------------------------------------------------------------- news
def publish_time(spark, d):
    n = _news(spark, d)
    return n.select("news_id", iso_timestamp("published_datetime_utc").alias("published_datetime_utc"),
                    "published_date_utc")


def news_events(spark, d):
    n = _news(spark, d)
    return n.select("news_id", "ticker", iso_timestamp("published_datetime_utc").alias("published_datetime_utc"),
                    "published_date_utc", "title", "summary", "has_causal_keyword")


# ---------------------------------------------------------------- filings
def filing_sections(spark, d):
    f = B.filings_raw(spark, d)
    text = drop_blank_lines("full_filing_text")
    return f.select("id", "form", relevant_section(text, "form").alias("section"))


def mdna_sections(spark, d):
    f = B.filings_raw(spark, d)
    return f.select("id", mdna(drop_blank_lines("full_filing_text")).alias("section"))


def item_sections(spark, d):
    f = B.filings_raw(spark, d)
    return f.select("id", item_8k(drop_blank_lines("full_filing_text")).alias("section"))


def filing_events(spark, d):
    return _filings(spark, d).select("filing_id", "ticker", "filing_date", "item_text",
                                     "has_causal_keyword")


def html_text(spark, d):
    p = B.table(spark, d, "pages", ("page_id", "html"))
    return html_to_text(p, "html", "text").drop("html")


def latest_filings_q(spark, d):
    idx = B.filing_index(spark, d)
    return s5_latest_filings(idx, "1-URGENT", 5, ("o_orderdate", "o_orderkey"))


def filings_with_text(spark, d):
    idx = s5_latest_filings(B.filing_index(spark, d), "1-URGENT", 5, ("o_orderdate", "o_orderkey"))
    return t9_filings_with_text(idx, B.landed_page_places(spark, d))


def filing_events_html(spark, d):
    """T2 with the HTML parser: the composed filings inside a document root,
    beside a title, a script and a table that the parser must drop."""
    plain = F.col("full_filing_text")
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        plain = F.replace(plain, F.lit(c), F.lit(entity))
    page = F.concat(F.lit("<html><head><title>Item 2.02 title</title></head><body><p>outside</p><document>"
                          "<script>Item 5.02 code</script><table><tr><td>Item 2.02 due to cells</td></tr></table><p>"),
                    plain, F.lit("</p></document></body></html>"))
    f = preprocess_filings(B.filings_raw(spark, d).withColumn("full_filing_text", page), F.col("form"), text_mode="html")
    return f.select("filing_id", "ticker", "filing_date", "item_text", "has_causal_keyword")


# ---------------------------------------------------------------- labelling
def annotation_sheet(spark, d):
    a = _aligned_news(spark, d).select("news_id", "ticker", "event_date", "cat_d1")
    return t5_annotation_sheet(a)


def standardise_union(spark, d):
    aligned = _aligned_sources(spark, d)
    return benchmark_events({
        "news": aligned["news"].select("news_id", "ticker", "event_date", "summary", "title", "cat_d1"),
        "filings": aligned["filings"].select("filing_id", "ticker", "event_date", "item_text", "cat_d1")})


# ---------------------------------------------------------------- answers and scoring
def prompts(spark, d):
    a = _aligned_news(spark, d)
    return a.select(F.col("news_id").alias("event_id"),
                    build_prompt("summary", "cat_d1").alias("prompt"))


def parse_answers(spark, d):
    return results_from_answers(B.answers(spark, d))


def predict_keyword(spark, d):
    a = _aligned_news(spark, d).select(F.col("news_id").alias("event_id"), "ticker",
                                       F.col("summary").alias("event_text"), "cat_d1")
    res = run_benchmark(a, {"keyword": keyword_predictor()})
    return res.select("model", "event_id", "causal_llm_pred", "assoc_llm_pred",
                      "cause_llm_pred", "effect_llm_pred")


def predict_batched(spark, d):
    """G1 in batches of like prompts under a token budget; the answers are those of the plain form."""
    a = _aligned_news(spark, d).select(F.col("news_id").alias("event_id"), "ticker",
                                       F.col("summary").alias("event_text"), "cat_d1")
    res = run_benchmark(a, {"keyword": keyword_predictor()}, token_budget=4096)
    return res.select("model", "event_id", "causal_llm_pred", "assoc_llm_pred",
                      "cause_llm_pred", "effect_llm_pred")


def score_models(spark, d):
    return r6(score(results_from_answers(B.answers(spark, d))))


def _bench_results(spark, d):
    a = _aligned_news(spark, d)
    lab = B.table(spark, d, "labels").select(
        F.col("doc_id").cast("string").alias("news_id"),
        F.when(F.col("quality") == 1, "Yes").when(F.col("quality") == 0, "No").alias("causal_label"),
        F.when(F.col("toxic") == 1, "Yes").when(F.col("toxic") == 0, "No").alias("assoc_label"))
    # labels are sized before they may be broadcast, so the event side
    # (which carries the texts) is not shuffled to meet them
    ev = a.join(sized_side(lab), "news_id", "left").select(
        F.col("news_id").alias("event_id"), "ticker", F.col("summary").alias("event_text"),
        "cat_d1", F.coalesce("causal_label", F.lit("")).alias("causal_label"),
        F.coalesce("assoc_label", F.lit("")).alias("assoc_label"))
    return run_benchmark(ev, {"keyword": keyword_predictor()})


def benchmark_end_to_end(spark, d):
    return _bench_results(spark, d).select("model", "event_id", "ticker", "ground_causal",
                                           "ground_assoc", "causal_llm_pred", "assoc_llm_pred",
                                           "raw_llm")


def benchmark_labelled(spark, d):
    """P5/T6 as the benchmark is run: labelled JSON Lines per ticker with
    ticker-prefixed columns, written once, read back once, standardised and predicted."""
    lab = B.table(spark, d, "labels").select(
        F.col("doc_id").cast("string").alias("news_id"),
        F.when(F.col("quality") == 1, "Yes").when(F.col("quality") == 0, "No").alias("causal_label"),
        F.when(F.col("toxic") == 1, "Yes").when(F.col("toxic") == 0, "No").alias("assoc_label"))
    a = _aligned_news(spark, d).join(sized_side(lab), "news_id", "left").select(
        "news_id", "ticker", "event_date", "summary", *RETURN_OUT,
        F.coalesce("causal_label", F.lit("")).alias("causal_label"),
        F.coalesce("assoc_label", F.lit("")).alias("assoc_label"))
    path = scratch_path(spark, "labelled")
    writers.write_ticker_files(a, path, RETURN_OUT)
    types = T.StructType([f for f in a.schema.fields if f.name != "ticker"])
    events = standardise_files(readers.read_ticker_lines(spark, path), types, "news_id", "summary")
    res = run_benchmark(events, {"keyword": keyword_predictor()})
    return res.select("model", "event_id", "ticker", "ground_causal", "ground_assoc", "causal_llm_pred",
                      "assoc_llm_pred", "effect_llm_pred")


def annotate_job(spark, d):
    """T5 whole: aligned JSON Lines in, annotation sheet out as CSV, read back."""
    a = _aligned_news(spark, d).select("news_id", "ticker", "event_date", "cat_d1", "summary")
    src, out = scratch_path(spark, "annotate-in"), scratch_path(spark, "annotate-out")
    writers.write_jsonl(a, src)
    annotate(spark, src, a.schema, out)
    sheet = T.StructType(a.schema.fields + [T.StructField(c, T.StringType()) for c in LABEL_COLUMNS])
    return readers.read_csv(spark, out, sheet)


def convert_job(spark, d):
    """K4 whole: annotated CSV in, JSON Lines with the mapped columns out, read back."""
    res = results_from_answers(B.answers(spark, d)).select("model", "event_id", "raw_llm", "ground_causal",
                                                           "cause_llm_pred", "effect_llm_pred")
    src, out = scratch_path(spark, "convert-in"), scratch_path(spark, "convert-out")
    writers.write_csv(res, src)
    names = {"model": "model", "event_id": "event_id", "raw_llm": "event", "ground_causal": "ground_causal",
             "cause_llm_pred": "ground_cause", "effect_llm_pred": "ground_effect"}
    convert(spark, src, res.schema, out, names)
    return readers.read_jsonl(spark, out, T.StructType([T.StructField(k, T.StringType()) for k in names.values()]))


def align_job(spark, d):
    """T8 to its save step (K1): align every ticker, save each source as JSON
    Lines, and read both back."""
    out = scratch_path(spark, "align-job")
    aligned = align_and_save(B.news_raw(spark, d), B.filings_raw(spark, d), B.bars(spark, d), out,
                             filing_form=F.col("form"), filing_text_mode="plain")
    parts = []
    for source, key in (("news", "news_id"), ("filings", "filing_id")):
        back = readers.read_jsonl(spark, f"{out}/{source}", aligned[source].schema)
        parts.append(back.select(F.lit(source).alias("source"), F.col(key).alias("event_id"), "ticker",
                                 iso_date("event_date").alias("event_date"), "has_causal_keyword",
                                 "cat_d0", "cat_d1", "cat_d2"))
    return parts[0].unionByName(parts[1])


def saved_counts(spark, d):
    """A3: rows loaded and saved by the align job, counted by its writes themselves."""
    counts: dict[str, int] = {}
    align_and_save(B.news_raw(spark, d), B.filings_raw(spark, d), B.bars(spark, d), scratch_path(spark, "align-counts"),
                   counts=counts, filing_form=F.col("form"), filing_text_mode="plain")
    return spark.createDataFrame(sorted(counts.items()), "step string, n_rows long")


def score_from_files(spark, d):
    """K5 -> S4 -> T7: results written by model, read back, scored."""
    path = scratch_path(spark, "results")
    writers.write_results(results_from_answers(B.answers(spark, d)), path)
    return r6(score(readers.read_results(spark, path)))


def landed_quarantine(spark, d):
    """S1 with a quarantine: every 31st landed article was cut off while it was
    written; the others are read, and what broke is counted by the same pass."""
    raw = B.news_raw(spark, d)
    n = F.col("articlesId").cast("long")
    whole = F.to_json(F.array(F.struct("articlesId", "publishedAt", "articlesName", "articlesDescription")))
    line = F.when(F.pmod(n, F.lit(31)) == 0, F.concat(F.lit("["), F.substr(whole, F.lit(1), F.lit(12)))).otherwise(whole)
    path = scratch_path(spark, "landing-broken")
    raw.select(line.alias("value")).write.text(path)
    got = readers.load_json_array(spark, path, RAW_NEWS, scratch_path(spark, "quarantine"), multi_line=False)
    read = got.good.agg(F.count_distinct("articlesId").alias("n")).select(F.lit("read").alias("kind"), "n")
    broken = got.broken.agg(F.coalesce(F.sum("n_broken"), F.lit(0)).alias("n")).select(F.lit("broken").alias("kind"), "n")
    seen = spark.createDataFrame([("counted good", got.n_good), ("counted broken", got.n_broken)], "kind string, n long")
    return read.unionByName(broken).unionByName(seen)


def landed_pages_check(spark, d):
    """K3 + S6: news landed in pages of 20, one page lost; which one is found by
    its number, and all other articles are read from whole pages."""
    path = scratch_path(spark, "landing")
    pages = to_pages(B.news_raw(spark, d))
    pages_path = scratch_path(spark, "pages-numbered")
    pages.write.parquet(pages_path)
    pages = spark.read.parquet(pages_path)
    writers.write_landing(pages.where("page <> 2"), path)
    numbers = spark.read.schema(PAGE_NUMBERS).json(path)
    lost = missing_pages(numbers).join(pages, "page").select("page", F.explode("articles").alias("a"))
    read = readers.read_news_pages(spark, path, multi_line=False)
    return (read.select(F.col("articlesId").alias("news_id"))
            .unionByName(lost.where("page = 2").select(F.col("a.articlesId").alias("news_id"))))


def landed_articles(spark, d):
    """Landed JSON-array files of articles, where every 29th article has a
    plain string as its publication time; only that article loses its time."""
    raw = B.news_raw(spark, d)
    odd = F.pmod(F.col("articlesId").cast("long"), F.lit(29)) == 0
    rest = F.to_json(F.struct("articlesId", "articlesName", "articlesDescription", "ticker"))
    time = F.when(odd, F.to_json(F.struct(F.col("publishedAt.date").alias("publishedAt")))) \
        .otherwise(F.to_json(F.struct("publishedAt")))
    # one array per article: joined objects, as the landing step writes them
    line = F.concat(F.lit("["), F.regexp_replace(time, r"\}$", ","), F.substr(rest, F.lit(2)), F.lit("]"))
    path = scratch_path(spark, "landing-arrays")
    raw.select(line.alias("value")).write.text(path)
    schema = T.StructType(RAW_NEWS.fields + [T.StructField("ticker", T.StringType())])
    back = readers.read_json_array(spark, path, schema, multi_line=False)
    return back.select(F.col("articlesId").alias("news_id"), "ticker", F.col("articlesName").alias("title"),
                       F.col("publishedAt.date").alias("published"))


def score_report(spark, d):
    return report(score(results_from_answers(B.answers(spark, d))))


# ---------------------------------------------------------------- sinks and scans
def convert_columns(spark, d):
    res = results_from_answers(B.answers(spark, d))
    return writers.convert_columns(res, {"model": "model", "event_id": "event_id",
                                         "raw_llm": "event", "ground_causal": "ground_causal",
                                         "cause_llm_pred": "ground_cause",
                                         "effect_llm_pred": "ground_effect"})


def jsonl_roundtrip(spark, d):
    a = _aligned_news(spark, d).select("news_id", "ticker", "event_date", "has_causal_keyword",
                                       *RETURN_OUT)
    a = a.withColumn("ret_pct_d2", F.coalesce("ret_pct_d2", F.lit(float("nan"))))  # P12: written as null
    path = scratch_path(spark, "jsonl")
    writers.write_jsonl(a, path)
    back = readers.read_jsonl(spark, path, a.schema)
    return r6(back)


def csv_roundtrip(spark, d):
    sheet = t5_annotation_sheet(_aligned_news(spark, d).select(
        "news_id", "ticker", "event_date", "cat_d1", "summary"))
    path = scratch_path(spark, "csv")
    writers.write_csv(sheet, path)
    return readers.read_csv(spark, path, sheet.schema)


def results_glob(spark, d):
    res = results_from_answers(B.answers(spark, d))
    path = scratch_path(spark, "results")
    writers.write_results(res, path)
    return readers.read_results(spark, path).select("model", "event_id", "ground_causal", "causal_llm_pred", "assoc_llm_pred",
                       "raw_llm")


def results_rerun(spark, d):
    """K5 twice: all models' results, then m1's again, which replaces m1's and no others."""
    res = results_from_answers(B.answers(spark, d))
    path = scratch_path(spark, "results")
    writers.write_results(res.withColumn("raw_llm", F.when(F.col("model") == "m1", F.lit("first run")).otherwise(F.col("raw_llm"))), path)
    writers.write_results(res.where(F.col("model") == "m1"), path)
    return readers.read_results(spark, path).select("model", "event_id", "ground_causal", "causal_llm_pred", "assoc_llm_pred",
                                                    "raw_llm")


def union_mixed_types(spark, d):
    """U1 where a column's type differs: order numbers and totals beside text
    and whole numbers, dates beside timestamps."""
    o, p = B.table(spark, d, "orders"), B.table(spark, d, "part")
    orders = o.select(F.col("o_orderkey").alias("event_id"), F.lit("orders").alias("source"), F.col("o_orderkey").alias("code"),
                      F.col("o_custkey").cast("int").alias("size"), F.to_date("o_orderdate").alias("at"))
    parts = p.select(F.col("p_partkey").alias("event_id"), F.lit("part").alias("source"), F.col("p_name").alias("code"),
                     F.col("p_retailprice").cast("double").alias("size"), F.lit(None).alias("at"))
    ev = B.table(spark, d, "events").select("event_id", F.lit("events").alias("source"), (F.col("user_id") % 2 == 0).alias("code"),
                                           F.col("ts").cast("timestamp").alias("at"))
    u = union_events([orders, parts, ev])
    return r6(u.withColumn("at", iso_timestamp("at")))


def landing_roundtrip(spark, d):
    """K3 + S6/U2: land the news as pages, scan all pages back
    in one read, preprocess (T1)."""
    from eventlens.sources.landing import land_news
    path = scratch_path(spark, "landing")
    land_news(B.news_raw(spark, d), path)
    back = readers.read_news_pages(spark, path, multi_line=False)
    n = preprocess_news(back)
    return n.select("news_id", iso_timestamp("published_datetime_utc").alias("published_datetime_utc"),
                    "published_date_utc", "title", "summary", "has_causal_keyword")


def stream_news_events(spark, d):
    """Structured Streaming: landed pages -> T1 -> J1 as a stream-static left
    join with the materialised returns -> parquet sink, run to completion
    (``availableNow``) and read back."""
    from eventlens.sources.landing import land_news
    from eventlens.streaming.news import aligned_news_stream, start
    landing, out = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    land_news(B.news_raw(spark, d), landing)
    returns = sized_side(_returns(spark, d))
    start(aligned_news_stream(spark, landing, returns, strategy="prepared"), out).awaitTermination()
    a = spark.read.parquet(out)
    return r6(a.select("news_id", "ticker", "event_date", "has_causal_keyword", *RETURN_OUT))


def macro_series(spark, d):
    o = B.table(spark, d, "orders").select("o_orderdate", "o_totalprice")
    # money: exact decimal sum, then one division (independent of summation order)
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    series = (o.groupBy(F.to_date("o_orderdate").alias("date"))
              .agg((total / F.count(F.lit(1))).alias("CPIAUCSL")))
    path = scratch_path(spark, "macro")
    writers.write_csv(series, path)
    # exact inputs and one division: the same double on any engine, so no rounding
    return readers.read_macro(spark, path)


# ---------------------------------------------------------------- misc
def row_counts(spark, d):
    parts = [B.table(spark, d, t).agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(t).alias("table_name"), "n_rows") for t in B.TABLES]
    return reduce(DataFrame.unionByName, parts)


def first_rows(spark, d):
    return (B.table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
            .orderBy("doc_id").limit(10))


def schema_guard(spark, d):
    a = _aligned_news(spark, d).withColumn("ret_pct_d1", F.coalesce("ret_pct_d1", F.lit(float("nan"))))
    a = nan_to_null(a)
    good = a.select(F.col("news_id").alias("event_id"), F.round("ret_pct_d1", 6).alias("ret_pct_d1"),
                    optional_col(a, "cat_d1", "N/A").alias("reaction"),
                    optional_col(a, "causal_label", "").alias("ground_causal"))
    # A table without a required column gives no rows, in the full schema
    bad = preprocess_news(B.news_raw(spark, d).drop("articlesName"))
    return good.unionByName(bad.select(F.col("news_id").alias("event_id"), F.lit(0.0).alias("ret_pct_d1"),
                                       F.col("title").alias("reaction"), F.col("summary").alias("ground_causal")))


def sql_functions(spark, d):
    register_sql_functions(spark)
    name = f"el_returns_{abs(hash(d)) % 10**8}"
    _returns(spark, d).createOrReplaceTempView(name)
    return spark.sql(f"""
        SELECT ticker, trade_date,
               categorize_return(ret_pct_d1) AS cat_d1,
               strip_tags(concat('<i>', ticker, '</i> ', cast(trade_date AS string))) AS label,
               has_causal_keyword(concat('moved ', if(dayofmonth(trade_date) % 2 = 0, 'due to ', 'with '), ticker)) AS flagged
        FROM {name}""")


def sql_clean_text(spark, d):
    """G2 for F6: the cleaning chain called from SQL text."""
    register_sql_functions(spark)
    name = f"el_documents_{abs(hash(d)) % 10**8}"
    B.table(spark, d, "documents", ("doc_id", "text")).createOrReplaceTempView(name)
    return spark.sql(f"SELECT doc_id, clean_text(text, {NEWS_LIMITS[0]}, {NEWS_LIMITS[1]}) AS cleaned FROM {name}")


QUERIES = {
    "daily_returns": daily_returns,
    "returns_from_price_table": returns_from_price_table,
    "return_categories": return_categories,
    "price_range_prune": price_range_prune,
    "returns_from_raw_bars": returns_from_raw_bars,
    "align_events": align_events_q,
    "align_empty_prices": align_empty_prices,
    "align_wide_prefixed": align_wide_prefixed,
    "align_all_tickers": align_all_tickers,
    "align_next_day": align_next_day,
    "strip_tags": strip_tags_q,
    "keyword_screen": keyword_screen,
    "clean_boilerplate": clean_boilerplate,
    "first_sentences": first_sentences_q,
    "truncate_text": truncate_text_q,
    "clean_text": clean_text,
    "publish_time": publish_time,
    "news_events": news_events,
    "filing_sections": filing_sections,
    "mdna_sections": mdna_sections,
    "item_sections": item_sections,
    "filing_events": filing_events,
    "filing_events_html": filing_events_html,
    "html_text": html_text,
    "latest_filings": latest_filings_q,
    "filings_with_text": filings_with_text,
    "annotation_sheet": annotation_sheet,
    "standardise_union": standardise_union,
    "prompts": prompts,
    "parse_answers": parse_answers,
    "predict_keyword": predict_keyword,
    "predict_batched": predict_batched,
    "score_models": score_models,
    "benchmark_end_to_end": benchmark_end_to_end,
    "score_report": score_report,
    "benchmark_labelled": benchmark_labelled,
    "annotate_job": annotate_job,
    "convert_job": convert_job,
    "align_job": align_job,
    "score_from_files": score_from_files,
    "landed_articles": landed_articles,
    "landed_quarantine": landed_quarantine,
    "landed_pages_check": landed_pages_check,
    "convert_columns": convert_columns,
    "jsonl_roundtrip": jsonl_roundtrip,
    "csv_roundtrip": csv_roundtrip,
    "results_glob": results_glob,
    "results_rerun": results_rerun,
    "union_mixed_types": union_mixed_types,
    "saved_counts": saved_counts,
    "macro_series": macro_series,
    "landing_roundtrip": landing_roundtrip,
    "stream_news_events": stream_news_events,
    "row_counts": row_counts,
    "first_rows": first_rows,
    "schema_guard": schema_guard,
    "sql_functions": sql_functions,
    "sql_clean_text": sql_clean_text,
}
