"""Daily returns per ticker (W1, W2, F13, T3) and event-driven price pruning (A1).

One window ``partitionBy(ticker).orderBy(trade_date)`` serves the lag and all
leads, so the plan has a single exchange on ``ticker`` and a single Window
node. A window group is one ticker's *daily* series, bounded by the number
of trading days, not by the data volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.returns import categorize_return
from eventlens.plans.sizing import DEFAULT_MAX_BROADCAST_ROWS, sized_side

PRICE_COLUMNS = ("open", "high", "low", "close", "adj_close", "volume")
DEFAULT_HORIZONS = (1, 2)
PRICE_MARGIN_DAYS = 30  # fixed value: calendar days around the events


def return_columns(horizons: Sequence[int] = DEFAULT_HORIZONS) -> list[str]:
    cols = ["ret_pct_d0", "cat_d0"]
    for i in horizons:
        cols += [f"ret_pct_d{i}", f"cat_d{i}"]
    return cols


def daily_returns(prices: DataFrame, horizons: Sequence[int] = DEFAULT_HORIZONS,
                  price_col: str = "adj_close", fill: str | None = None) -> DataFrame:
    """T3 core: add ``ret_pct_d0`` (vs previous trading day) and
    ``ret_pct_d{i}`` (cumulative from day D to D+i), in percent, and their
    categories. Offsets are rows (trading days). A zero price gives null
    (``N/A``) where pandas would give infinity. ``fill='pad'`` carries the
    last known price forward for D0, like older pandas ``pct_change``."""
    w = Window.partitionBy("ticker").orderBy("trade_date")
    p = F.col(price_col)
    base = p
    if fill == "pad":
        base = F.last(p, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    elif fill is not None:
        raise ValueError("fill must be None or 'pad'")
    cols = {"ret_pct_d0": (F.try_divide(base, F.lag(base, 1).over(w)) - 1) * 100}
    for i in horizons:
        cols[f"ret_pct_d{i}"] = (F.try_divide(F.lead(p, i).over(w), p) - 1) * 100
    out = prices.withColumns(cols)
    return out.withColumns({
        f"cat_d{k[len('ret_pct_d'):]}": categorize_return(k) for k in cols})


def price_window(events: DataFrame, date_col: str = "event_date",
                 margin_days: int = PRICE_MARGIN_DAYS) -> DataFrame:
    """A1: per ticker, [min event date - margin, max event date + margin)."""
    d = F.col(date_col).cast("date")
    return (events.where(d.isNotNull())
            .groupBy("ticker")
            .agg(F.date_sub(F.min(d), margin_days).alias("price_from"),
                 F.date_add(F.max(d), margin_days).alias("price_until")))


def prune_prices(prices: DataFrame, events: DataFrame, date_col: str = "event_date",
                 margin_days: int = PRICE_MARGIN_DAYS, strategy: str = "auto",
                 max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Keep only each ticker's bars inside its event window (end
    exclusive). The bounds table has one row per ticker, sized before it is
    broadcast; the earliest and latest of its days also go to the price scan
    as literals, which push down below any aggregation by day."""
    bounds = sized_side(price_window(events, date_col, margin_days),
                        max_broadcast_rows, strategy)
    first, last = bounds.agg(F.min("price_from"), F.max("price_until")).first()
    if first is not None:
        prices = prices.where((F.col("trade_date") >= F.lit(first)) & (F.col("trade_date") < F.lit(last)))
    return (prices.join(bounds, "ticker")
            .where((F.col("trade_date") >= F.col("price_from"))
                   & (F.col("trade_date") < F.col("price_until")))
            .drop("price_from", "price_until"))


def returns_table(prices: DataFrame, horizons: Sequence[int] = DEFAULT_HORIZONS,
                  fill: str | None = None, keep_bars: bool = True) -> DataFrame:
    """Returns table ``ticker, trade_date, [bars], ret_pct_d*, cat_d*``."""
    keep = [c for c in PRICE_COLUMNS if c in prices.columns] if keep_bars else ["adj_close"]
    out = daily_returns(prices.select("ticker", "trade_date", *keep), horizons, fill=fill)
    return out.select("ticker", "trade_date", *keep, *return_columns(horizons))
