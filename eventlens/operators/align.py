"""Event/returns alignment (J1, J2, T4) and the ticker-prefixed wide form.

Events keep one row each (left join on the exact date); an event on a
non-trading day gets null returns *and* a null category, unlike a trading day
at the edge of the price range, whose category is ``N/A``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.operators.returns import DEFAULT_HORIZONS, PRICE_COLUMNS, return_columns
from eventlens.plans.sizing import DEFAULT_MAX_BROADCAST_ROWS, sized_side


def align_events(events: DataFrame, returns: DataFrame, date_col: str = "event_date",
                 strategy: str = "auto",
                 max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """``events LEFT JOIN returns ON ticker AND date``.

    The event side is never shuffled when the returns side fits the
    broadcast bound (checked, see :mod:`eventlens.plans.sizing`); otherwise a
    shuffle join on (ticker, date), where AQE splits skewed partitions."""
    ev = events.withColumn(date_col, F.col(date_col).cast("date"))
    r = returns.withColumnRenamed("trade_date", date_col)
    return ev.join(sized_side(r, max_broadcast_rows, strategy), ["ticker", date_col], "left")


def empty_returns(spark, horizons: Sequence[int] = DEFAULT_HORIZONS,
                  keep_bars: bool = True) -> DataFrame:
    """An empty returns table with the full schema (typed null columns
    after the join: doubles stay doubles, categories stay strings)."""
    fields = [T.StructField("ticker", T.StringType()), T.StructField("trade_date", T.DateType())]
    bars = PRICE_COLUMNS if keep_bars else ("adj_close",)
    for c in bars:
        fields.append(T.StructField(c, T.LongType() if c == "volume" else T.DoubleType()))
    for c in return_columns(horizons):
        fields.append(T.StructField(c, T.StringType() if c.startswith("cat_") else T.DoubleType()))
    return spark.createDataFrame([], T.StructType(fields))


def reference_name(col: str) -> str:
    """``ret_pct_d1`` -> ``ret_pct_D+1``, ``cat_d0`` -> ``cat_D0``."""
    for stem in ("ret_pct_d", "cat_d"):
        if col.startswith(stem) and col[len(stem):].isdigit():
            i = int(col[len(stem):])
            return f"{stem[:-1]}D{i}" if i == 0 else f"{stem[:-1]}D+{i}"
    return col


def prefix_columns(df: DataFrame, ticker: str, columns: Sequence[str]) -> DataFrame:
    """P4 for one ticker: rename each price column to ``{T}_{name}`` using
    the reference's names (``AAPL_ret_pct_D+1``)."""
    return df.select(*[F.col(f"`{c}`").alias(f"{ticker}_{reference_name(c)}") if c in columns
                       else F.col(f"`{c}`") for c in df.columns])


def to_wide(aligned: DataFrame, tickers: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """P4 for many tickers in one pass: ``{T}_{name}`` holds the value only on
    that ticker's rows (a projection, no pivot aggregation or shuffle)."""
    keep = [F.col(f"`{c}`") for c in aligned.columns if c not in columns]
    wide = [F.when(F.col("ticker") == t, F.col(c)).alias(f"{t}_{reference_name(c)}")
            for t in tickers for c in columns]
    return aligned.select(*keep, *wide)
