"""Invariants on the generated tables."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import SF_SMALL
from eventlens.functions.text import FILING_LIMITS, NEWS_LIMITS, clean_and_truncate
from eventlens.operators.returns import returns_table
from eventlens.plans import bindings as B
from eventlens.plans.queries import QUERIES


def test_alignment_keeps_every_event(spark):
    news = QUERIES["news_events"](spark, SF_SMALL)
    aligned = QUERIES["align_events"](spark, SF_SMALL)
    assert aligned.count() == news.count()
    assert aligned.select("news_id").distinct().count() == news.count()


def test_next_day_return_is_next_rows_same_day_return(spark):
    r = returns_table(B.bars(spark, SF_SMALL))
    w = Window.partitionBy("ticker").orderBy("trade_date")
    bad = (r.withColumn("next_d0", F.lead("ret_pct_d0").over(w))
           .where(F.col("next_d0").isNotNull() & (F.col("next_d0") != F.col("ret_pct_d1"))))
    assert bad.count() == 0


def test_cleaned_text_respects_limits(spark):
    docs = B.table(spark, SF_SMALL, "documents", ("doc_id", "text"))
    for m, n in (NEWS_LIMITS, FILING_LIMITS, (300, 3)):
        longest = docs.select(F.max(F.length(clean_and_truncate("text", m, n)))).first()[0]
        assert longest <= m + 3


def test_category_counts_cover_every_trading_day(spark):
    cats = QUERIES["return_categories"](spark, SF_SMALL)
    days = B.bars(spark, SF_SMALL).count()
    per_horizon = {r.horizon: r.n for r in cats.groupBy("horizon").agg(F.sum("n_days").alias("n")).collect()}
    assert per_horizon == {"D0": days, "D+1": days, "D+2": days}
