import datetime as dt
import math

from pyspark.sql import functions as F

from helpers import one_col
from eventlens.functions.returns import categorize_return
from eventlens.operators.align import align_events, empty_returns, prefix_columns, reference_name
from eventlens.operators.returns import daily_returns, prune_prices, returns_table

D = dt.date


def bars(spark, rows):
    return spark.createDataFrame(rows, "ticker string, trade_date date, adj_close double")


def test_categories(spark):
    df = one_col(spark, [-2.0, -1.99, -0.5, -0.49, 0.49, 0.5, 1.99, 2.0, float("nan"), None],
                 ddl="double")
    got = [r[0] for r in df.select(categorize_return("t")).collect()]
    assert got == ["Significant Down", "Small Down", "Small Down", "Flat", "Flat", "Small Up",
                   "Small Up", "Significant Up", "N/A", "N/A"]


def test_returns_hand_rows_two_tickers(spark):
    rows = []
    for i, (a, b) in enumerate(zip([100, 102, 101, 101], [50, 50, 50, 50])):
        rows += [("A", D(2024, 1, 1 + i), float(a)), ("B", D(2024, 1, 1 + i), float(b))]
    out = {(r.ticker, r.trade_date.day): r for r in daily_returns(bars(spark, rows)).collect()}
    a = [out[("A", d)] for d in range(1, 5)]
    close = lambda x, y: math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12)
    assert a[0].ret_pct_d0 is None and close(a[1].ret_pct_d0, 2.0)
    assert close(a[2].ret_pct_d0, -0.98039215686) and close(a[3].ret_pct_d0, 0.0)
    assert close(a[0].ret_pct_d1, 2.0) and a[3].ret_pct_d1 is None
    assert close(a[0].ret_pct_d2, 1.0) and a[2].ret_pct_d2 is None
    assert [x.cat_d0 for x in a] == ["N/A", "Significant Up", "Small Down", "Flat"]
    assert all(out[("B", d)].cat_d0 in ("N/A", "Flat") for d in range(1, 5))


def test_zero_price_gives_null(spark):
    r = daily_returns(bars(spark, [("A", D(2024, 1, 1), 0.0), ("A", D(2024, 1, 2), 1.0)])).collect()
    assert r[1].ret_pct_d0 is None and r[1].cat_d0 == "N/A"


def test_single_window_in_plan(spark):
    plan = daily_returns(bars(spark, [("A", D(2024, 1, 1), 1.0)]))._jdf.queryExecution() \
        .executedPlan().toString()
    assert plan.count("Window [") == 1


def test_alignment_cases(spark):
    prices = bars(spark, [("A", D(2024, 1, 5), 10.0), ("A", D(2024, 1, 8), 11.0)])
    ret = returns_table(prices, keep_bars=False)
    ev = spark.createDataFrame(
        [("e1", "A", D(2024, 1, 6)), ("e2", "A", D(2024, 1, 8)), ("e3", "A", D(2024, 1, 8))],
        "event_id string, ticker string, event_date date")
    out = {r.event_id: r for r in align_events(ev, ret, strategy="auto").collect()}
    assert len(out) == 3
    assert out["e1"].adj_close is None and out["e1"].cat_d0 is None      # Saturday: null
    assert out["e2"].cat_d1 == "N/A" and out["e3"].adj_close == 11.0     # edge: N/A; duplicates kept
    empty = align_events(ev, empty_returns(spark, keep_bars=False), strategy="auto")
    assert empty.count() == 3
    assert dict(empty.dtypes)["cat_d1"] == "string" and dict(empty.dtypes)["ret_pct_d1"] == "double"


def test_auto_join_broadcasts_small_side(spark):
    prices = bars(spark, [("A", D(2024, 1, 5), 10.0)])
    ev = spark.createDataFrame([("e", "A", D(2024, 1, 5))], "event_id string, ticker string, event_date date")
    df = align_events(ev, returns_table(prices, keep_bars=False), strategy="auto")
    assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()
    big = align_events(ev, returns_table(prices, keep_bars=False), strategy="auto", max_broadcast_rows=0)
    assert big.count() == 1


def test_prune_prices(spark):
    prices = bars(spark, [("A", D(2024, 1, 1), 1.0), ("A", D(2024, 3, 1), 1.0),
                          ("A", D(2024, 3, 2), 1.0), ("B", D(2024, 1, 1), 1.0)])
    ev = spark.createDataFrame([("A", D(2024, 1, 31))], "ticker string, event_date date")
    kept = sorted(r.trade_date for r in prune_prices(prices, ev).collect())
    assert kept == [D(2024, 1, 1)]  # [Jan 1, Mar 1): end exclusive; B has no events


def test_prefix_names(spark):
    assert reference_name("ret_pct_d1") == "ret_pct_D+1" and reference_name("cat_d0") == "cat_D0"
    df = spark.createDataFrame([(1.0, "x")], "adj_close double, cat_d1 string")
    assert prefix_columns(df, "AAPL", ["adj_close", "cat_d1"]).columns == ["AAPL_adj_close",
                                                                          "AAPL_cat_D+1"]


def test_pad_fill_and_more_horizons(spark):
    rows = [("A", D(2024, 1, d), p) for d, p in ((1, 100.0), (2, None), (3, 110.0), (4, 121.0))]
    df = spark.createDataFrame(rows, "ticker string, trade_date date, adj_close double")
    plain = {r.trade_date.day: r for r in daily_returns(df).collect()}
    padded = {r.trade_date.day: r for r in daily_returns(df, fill="pad").collect()}
    assert plain[3].ret_pct_d0 is None                      # previous price missing
    assert math.isclose(padded[3].ret_pct_d0, 10.0)          # 110 vs carried 100
    assert padded[2].ret_pct_d0 == 0.0 and padded[2].cat_d0 == "Flat"
    many = daily_returns(df, horizons=(1, 3)).where("trade_date = '2024-01-01'").first()
    assert math.isclose(many.ret_pct_d3, 21.0) and many.cat_d3 == "Significant Up"
    assert "ret_pct_d2" not in daily_returns(df, horizons=(1, 3)).columns


def test_returns_match_pandas_on_random_series(spark):
    import random

    import pandas as pd
    rnd = random.Random(17)
    rows = []
    for t in ("A", "B", "C"):
        for d in range(40):
            price = None if rnd.random() < 0.1 else round(rnd.uniform(1, 500), 2)
            rows.append((t, dt.date(2024, 1, 1) + dt.timedelta(days=d), price))
    got = {(r.ticker, r.trade_date): r for r in daily_returns(bars(spark, rows)).collect()}
    pdf = pd.DataFrame(rows, columns=["ticker", "trade_date", "adj_close"]).sort_values(["ticker", "trade_date"])
    for t, g in pdf.groupby("ticker"):
        p = g["adj_close"].astype(float)
        exp = {"ret_pct_d0": p.pct_change(fill_method=None) * 100,
               "ret_pct_d1": (p.shift(-1) / p - 1) * 100,
               "ret_pct_d2": (p.shift(-2) / p - 1) * 100}
        for i, day in enumerate(g["trade_date"]):
            for col, series in exp.items():
                e, v = series.iloc[i], got[(t, day)][col]
                assert (v is None and pd.isna(e)) or v == e, (t, day, col, v, e)
