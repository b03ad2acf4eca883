"""As-of alignment through a trading calendar (J1, the next-trading-day form).

The plain alignment joins on the exact date, so an event on a weekend or
holiday finds no returns. Here each calendar day is first mapped to its next
trading day, per ticker; the mapped returns are still keyed by (ticker, day), so
events meet them by the same sized equi-join, without a range join and
without shuffling events below the broadcast bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.operators.align import align_events
from eventlens.plans.sizing import DEFAULT_MAX_BROADCAST_ROWS

MAX_GAP_DAYS = 10  # calendar days that an event may wait for a trading day


def next_trading_days(returns: DataFrame, max_gap_days: int = MAX_GAP_DAYS, day_col: str = "event_date") -> DataFrame:
    """``returns`` with a row for each calendar day whose next trading day it is
    (``day_col``; the trading day itself included), at most ``max_gap_days``
    before it. A day after a ticker's last trading day has no row.

    The gap before a trading day comes from ``lag`` over the ticker's daily
    series (the window that the returns use) and is filled by ``sequence``, so a
    ticker's rows are bounded by its calendar."""
    w = Window.partitionBy("ticker").orderBy("trade_date")
    first = F.greatest(F.date_add(F.lag("trade_date").over(w), 1), F.date_sub("trade_date", max_gap_days))
    return (returns.withColumn("_first", first)
            .withColumn(day_col, F.explode(F.sequence("_first", "trade_date"))).drop("_first"))


def align_next_trading_day(events: DataFrame, returns: DataFrame, date_col: str = "event_date",
                           max_gap_days: int = MAX_GAP_DAYS, strategy: str = "auto",
                           max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """J1 as of the next trading day: ``events`` with the returns of the first
    trading day on or after their date, and that day as ``trade_date``. Every
    event stays one row; without a trading day in reach, and for a null date or
    ticker, the added columns are null."""
    days = next_trading_days(returns, max_gap_days, date_col)
    kept = days.withColumnRenamed("trade_date", "_traded")  # the join's own name for the day is taken
    return align_events(events, kept, date_col, strategy, max_broadcast_rows).withColumnRenamed("_traded", "trade_date")
