"""A hot key holding a third of all rows: results stay whole and exact, and
the plans pre-aggregate before any shuffle."""
import datetime as dt

from pyspark.sql import functions as F

from eventlens.operators.align import align_events
from eventlens.operators.filings import latest_filings
from eventlens.operators.returns import price_window, returns_table


def _events(spark, n=30000):
    # ticker HOT gets a third of the rows, on a single day; others spread out
    return (spark.range(n)
            .withColumn("ticker", F.when(F.col("id") % 3 == 0, F.lit("HOT"))
                        .otherwise(F.concat(F.lit("T"), (F.col("id") % 97).cast("string"))))
            .withColumn("event_date", F.when(F.col("ticker") == "HOT", F.lit(dt.date(2024, 1, 3)))
                        .otherwise(F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 5).cast("int"))))
            .withColumn("event_id", F.col("id").cast("string")).drop("id"))


def _prices(spark):
    rows = [(t, dt.date(2024, 1, d), 100.0 + d) for t in ["HOT"] + [f"T{i}" for i in range(97)]
            for d in range(1, 8)]
    return spark.createDataFrame(rows, "ticker string, trade_date date, adj_close double")


def test_hot_key_alignment_is_whole_under_both_strategies(spark):
    ev, ret = _events(spark), returns_table(_prices(spark), keep_bars=False)
    for strategy in ("auto", "shuffle"):
        a = align_events(ev, ret, strategy=strategy)
        assert a.count() == 30000
        hot = a.where("ticker = 'HOT'").agg(F.count("*"), F.countDistinct("adj_close")).first()
        assert tuple(hot) == (10000, 1)


def test_hot_ticker_window_is_partial_before_shuffle(spark):
    out = price_window(_events(spark))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "partial_min" in plan
    hot = out.where("ticker = 'HOT'").first()
    assert hot.price_from == dt.date(2023, 12, 4) and hot.price_until == dt.date(2024, 2, 2)


def test_hot_company_top_n_is_exact(spark):
    filings = (spark.range(20000)
               .select(F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise((F.col("id") % 50).cast("string")).alias("cik"),
                       F.col("id").alias("pos"), F.lit("8-K").alias("form"),
                       F.col("id").cast("string").alias("accession"), F.lit("2024-01-01").alias("filing_date"),
                       F.lit("d.htm").alias("primary_document")))
    out = latest_filings(filings, "8-K", 5)
    hot = sorted(int(r.id) for r in out.where("cik = 'HOT'").collect())
    assert hot == [0, 3, 6, 9, 12]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
