"""Bindings from the driver's test tables to the reference's input shapes.

The reference lands news articles, filings, daily prices, web pages, model
answers and a filing index. The test warehouse holds none of these directly,
so each binding derives one of them from a given table with plain column
expressions (no filtering, no sampling: every input row flows through):

* **bars** (daily prices) from ``events``: ticker = event type, one bar per
  (ticker, day); open/close = first/last value by ``(ts, event_id)``,
  high/low = max/min, volume = count; news and filings reach past the last
  day, which has no bar.
* **news** from ``documents``: a dated article per document whose
  description is a JSON list of ``{content}`` objects (every third gets a
  lead sentence with a causal phrase; every eleventh is plain text), and
  whose publication time is sometimes malformed.
* **filings** from ``documents``: an 8-K/10-K text around each document
  with items, boilerplate, exhibits and signatures in eight shapes.
* **answers** from ``labels``: three models' raw answers in six shapes
  (valid JSON, prose + JSON, fenced, single-quoted, truncated, booleans).
* **filing index** from ``orders``: one filing per order, form = priority.
* **landed pages** from ``pages``: each page stored under the archive URL
  of the order whose key equals the page id.

Every binding has an SQL twin in :mod:`eventlens.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.functions.ids import document_url, zero_padded
from eventlens.operators.filings import page_places
from eventlens.plans.sizing import balance

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Tickers: the five event types of ``events``, upper-cased, in this order.
TICKERS = ("CLICK", "ERROR", "PURCHASE", "SIGNUP", "VIEW")
NEWS_EPOCH = "2024-01-01"
NEWS_DAYS = 40
FILING_DAYS = 45
CAUSAL_LEAD = "<p>Sales rose due to demand.</p>"
FILING_8K_CODES = ("2.02", "1.01", "5.02", "8.01", "5.07")
MODELS = ("m1", "m2", "m3")  # m3 answers only in a shape that cannot be parsed


# Text-heavy tables and their keys: scans of these are balanced over the
# cluster before per-row text work (see :func:`eventlens.plans.sizing.balance`).
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """Scan one test table (optionally projected before balancing, so only
    the needed columns are read and moved)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    if name in TEXT_TABLES and (not columns or TEXT_TABLES[name] in columns):
        df = balance(df, TEXT_TABLES[name])
    return df


def _ticker_of(doc_id: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TICKERS]), F.pmod(doc_id, F.lit(5)).cast("int") + 1)


def bars(spark: SparkSession, sf_dir: str, weekdays: bool = False) -> DataFrame:
    """Daily bars ``ticker, trade_date, open, high, low, close, adj_close, volume``;
    with ``weekdays`` trades of a weekend count to the Monday after it.
    Map-side partial aggregation keeps the shuffle at one row per
    (ticker, day) per task, however skewed the event types are."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    day = F.to_date("ts")
    if weekdays:
        day = F.date_add(day, F.when(F.dayofweek(day) == 7, 2).when(F.dayofweek(day) == 1, 1).otherwise(0))
    # (ts, event_id) as one fixed-width number: the aggregation stays a hash aggregation
    order = F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(38,0)") * F.lit(10**18).cast("decimal(19,0)") + F.col("event_id")
    order = order.cast("decimal(38,0)")
    return (ev.groupBy(F.upper("event_type").alias("ticker"), day.alias("trade_date"))
            .agg(F.min_by("value", order).alias("open"),
                 F.max("value").alias("high"),
                 F.min("value").alias("low"),
                 F.max_by("value", order).alias("close"),
                 F.count(F.lit(1)).alias("volume"))
            .withColumn("adj_close", F.col("close")))


def news_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed news articles (raw shape) with a ``ticker`` column."""
    d = table(spark, sf_dir, "documents", ("doc_id", "text", "source"))
    day = F.date_add(F.lit(NEWS_EPOCH).cast("date"), F.pmod("doc_id", F.lit(NEWS_DAYS)).cast("int"))
    stamp = (F.when(F.pmod("doc_id", F.lit(37)) == 36, F.lit("not a date"))
             .when(F.pmod("doc_id", F.lit(2)) == 0, F.concat(day.cast("string"), F.lit("T10:00:00.000Z")))
             .otherwise(F.concat(day.cast("string"), F.lit("T10:00:00Z"))))
    content = lambda v: F.create_map(F.lit("content"), v)
    desc = (F.when(F.pmod("doc_id", F.lit(11)) == 10, F.col("text"))
            .when(F.pmod("doc_id", F.lit(3)) == 0,
                  F.to_json(F.array(content(F.lit(CAUSAL_LEAD)), F.create_map(F.lit("k"), F.lit("1")),
                                    content(F.col("text")))))
            .otherwise(F.to_json(F.array(content(F.col("text"))))))
    return d.select(
        _ticker_of(F.col("doc_id")).alias("ticker"),
        F.col("doc_id").cast("string").alias("articlesId"),
        F.struct(stamp.alias("date")).alias("publishedAt"),
        F.concat(F.lit("<b>"), F.col("source"), F.lit("</b> report "), F.col("doc_id").cast("string"))
        .alias("articlesName"),
        desc.alias("articlesDescription"))


def filing_text(doc_id: Column, text: Column) -> Column:
    """Composed filing body in eight shapes by ``doc_id % 8``."""
    k = F.pmod(doc_id, F.lit(8))
    tail = F.lit("\nThe information contained in this Current Report shall not be deemed filed "
                 "for any purpose.\nItem 9.01 Financial Statements and Exhibits.\n"
                 "Exhibit 99.1 Press release of the company\n"
                 "Pursuant to the requirements of the Securities Exchange Act of 1934, the "
                 "registrant has duly signed this report.\nSIGNATURES\nBy: Officer")
    code = F.element_at(F.array(*[F.lit(c) for c in FILING_8K_CODES]), k.cast("int") + 1)
    return (F.when(k < 5, F.concat(F.lit("Cover page.\nItem 8.01 Other Events. Notice given.\nItem "),
                                   code, F.lit(" Results. "), text, tail))
            .when(k == 5, F.concat(F.lit("Cover page.\nITEM 3.03 Rights. "), text, tail))
            .when(k == 6, F.concat(F.lit("Cover page. "), text, tail))
            .otherwise(F.concat(F.lit("Annual report.\nItem 7. Management's Discussion and Analysis "
                                      "of Results. "), text,
                                F.lit("\nItem 8. Financial Statements.\nSIGNATURES\nBy: Officer"))))


def filings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed filings ``id, filing_date, full_filing_text`` + ``ticker, form``."""
    d = table(spark, sf_dir, "documents", ("doc_id", "text"))
    day = F.date_add(F.lit(NEWS_EPOCH).cast("date"),
                     F.pmod(F.col("doc_id") * 7, F.lit(FILING_DAYS)).cast("int"))
    date_text = F.when(F.pmod("doc_id", F.lit(41)) == 40, F.lit("n/a")).otherwise(day.cast("string"))
    form = F.when(F.pmod("doc_id", F.lit(8)) == 7, F.lit("10-K")).otherwise(F.lit("8-K"))
    return d.select(
        _ticker_of(F.col("doc_id")).alias("ticker"),
        F.concat(F.lit("0000000000-24-"), zero_padded("doc_id", 6)).alias("id"),
        date_text.alias("filing_date"), form.alias("form"),
        filing_text(F.col("doc_id"), F.col("text")).alias("full_filing_text"))


def answer_text(doc_id: Column, shape: Column, causal: Column, assoc: Column) -> Column:
    """A raw model answer in one of six shapes (``causal``/``assoc`` are 0/1)."""
    yn = lambda v: F.when(v == 1, F.lit("Yes")).otherwise(F.lit("No"))
    tf = lambda v: F.when(v == 1, F.lit("true")).otherwise(F.lit("false"))
    obj = F.concat(F.lit('{"causal": "'), yn(causal), F.lit('", "assoc": "'), yn(assoc),
                   F.lit('", "cause": " demand '), doc_id.cast("string"), F.lit(' ", "effect": "price"}'))
    return (F.when(shape == 0, obj)
            .when(shape == 1, F.concat(F.lit('Sure. {"a" oops} Here: {"causal": '), tf(causal),
                                       F.lit(', "assoc": "'), F.lower(yn(assoc)),
                                       F.lit('", "cause": "x"} done'), F.lit("z" * 300)))
            .when(shape == 2, F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
            .when(shape == 3, F.concat(F.lit("{'causal': '"), yn(causal), F.lit("', 'assoc': '"),
                                       yn(assoc), F.lit("'}")))
            .when(shape == 4, F.concat(F.lit('{"causal": "'), F.upper(yn(causal)),
                                       F.lit('", "assoc" : "'), F.lower(yn(assoc)),
                                       F.lit('", "cause": "trunc')))
            .otherwise(F.concat(F.lit('{"causal": '), tf(causal), F.lit(', "assoc": '), tf(assoc),
                                F.lit(', "cause": null}'))))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw answers of three models for every labelled document:
    ``model, event_id, ticker, ground_causal, ground_assoc, raw_answer``."""
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    yn = lambda v: F.when(v == 1, F.lit("Yes")).when(v == 0, F.lit("No")).otherwise(F.lit(""))
    x = lab.withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS])))
    shift = F.when(F.col("model") == MODELS[0], F.lit(0)).otherwise(F.lit(3))
    shape = F.when(F.col("model") == MODELS[2], F.lit(3)).otherwise(F.pmod(F.col("doc_id") + shift, F.lit(6)))
    pc = F.when(F.pmod("doc_id", F.lit(4)) == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    pa = F.when(F.pmod("doc_id", F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    return x.select("model", F.col("doc_id").cast("string").alias("event_id"),
                    _ticker_of(F.col("doc_id")).alias("ticker"),
                    yn(F.col("quality")).alias("ground_causal"),
                    yn(F.col("toxic")).alias("ground_assoc"),
                    answer_text(F.col("doc_id"), shape, pc, pa).alias("raw_answer"))


def filing_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long filing index: one filing per order ``cik, accession, form,
    filing_date, primary_document, o_orderdate, o_orderkey``."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate",
                                             "o_orderpriority")
    return o.select(
        F.col("o_custkey").cast("string").alias("cik"),
        accession(F.col("o_custkey"), F.col("o_orderdate"), F.col("o_orderkey")).alias("accession"),
        F.col("o_orderpriority").alias("form"),
        F.to_date("o_orderdate").cast("string").alias("filing_date"),
        F.concat(F.lit("doc"), F.col("o_orderkey").cast("string"), F.lit(".htm")).alias("primary_document"),
        "o_orderdate", "o_orderkey")


def accession(custkey: Column, orderdate: Column, orderkey: Column) -> Column:
    return F.concat(zero_padded(custkey, 10), F.lit("-"),
                    F.date_format(orderdate, "yy"), F.lit("-"),
                    zero_padded(orderkey, 6))


def landed_page_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each page stands, under the archive URL of the order whose key is
    the page id (null for a page without such an order). Only keys meet here;
    the pages themselves are not read."""
    p = page_places(spark, f"{sf_dir.rstrip('/')}/pages.parquet", "page_id").withColumnRenamed("html_url", "page_id")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    url = document_url(F.col("o_custkey"), accession(F.col("o_custkey"), F.col("o_orderdate"),
                                                     F.col("o_orderkey")),
                       F.concat(F.lit("doc"), F.col("o_orderkey").cast("string"), F.lit(".htm")))
    return (p.join(o, p.page_id == o.o_orderkey, "left")
            .select(url.alias("html_url"), "file_path", "row_index"))


def ship_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily prices ``ticker, trade_date, adj_close`` over all shipping days,
    which reach beyond the days of the orders: ticker by supplier, price = the
    day's largest item."""
    o = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice")
    return (o.groupBy(_ticker_of(F.col("l_suppkey")).alias("ticker"), F.to_date("l_shipdate").alias("trade_date"))
            .agg(F.max("l_extendedprice").alias("adj_close")))


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event days ``ticker, event_date`` of all orders."""
    o = table(spark, sf_dir, "orders")
    return o.select(_ticker_of(F.col("o_custkey")).alias("ticker"), F.to_date("o_orderdate").alias("event_date"))
