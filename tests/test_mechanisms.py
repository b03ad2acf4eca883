"""Mechanisms of the sources, sinks and joins: results per model, counts that
ride on a write, as-of alignment, types of a union, dates parsed once."""
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.functions.dates import DATE_FORMATS, published_at_utc, to_date_or_null
from eventlens.operators.calendar import align_next_trading_day, next_trading_days
from eventlens.operators.labels import common_type, union_events
from eventlens.operators.news import preprocess_news
from eventlens.plans import bindings as B
from eventlens.session import scratch_path
from eventlens.sources import readers, writers
from helpers import SF_SMALL, one_col


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def results(spark, rows):
    cols = "model string, event_id string, ticker string, ground_causal string, ground_assoc string, causal_llm_pred string, " \
           "assoc_llm_pred string, cause_llm_pred string, effect_llm_pred string, raw_llm string"
    return spark.createDataFrame([(m, i, "T", "Yes", "No", "Yes", "No", "a", "b", raw) for m, i, raw in rows], cols)


def test_a_model_run_again_replaces_only_its_own_results(spark):
    path = scratch_path(spark, "t-models")
    got = lambda: sorted((r.model, r.event_id, r.raw_llm) for r in readers.read_results(spark, path).collect())
    writers.write_results(results(spark, [("m1", "1", "old"), ("m1", "2", "old")]), path)
    writers.write_results(results(spark, [("m2", "1", "two")]), path)
    assert got() == [("m1", "1", "old"), ("m1", "2", "old"), ("m2", "1", "two")]
    writers.write_results(results(spark, [("m1", "1", "new")]), path)
    assert got() == [("m1", "1", "new"), ("m2", "1", "two")]


def test_a_save_counts_its_rows_and_keeps_the_old_file_when_empty(spark):
    path = scratch_path(spark, "t-counts")
    df = spark.range(0, 1000, 1, 7)
    assert writers.save_jsonl(df, path) == 1000
    assert writers.save_jsonl(df.where("id < 0"), path) == 0  # nothing is written
    assert spark.read.json(path).count() == 1000
    assert writers.save_jsonl(df.where("id < 3"), path) == 3 and spark.read.json(path).count() == 3
    assert [f for f in os.listdir(os.path.dirname(path)) if f.startswith(os.path.basename(path) + ".")] == []
    assert writers.save_jsonl(df, path, mode="append") == 1000 and spark.read.json(path).count() == 1003


def test_a_save_runs_its_plan_once(spark):
    ran = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    writers.write_jsonl(spark.range(100).mapInArrow(count, "id long"), scratch_path(spark, "t-once"))
    assert ran.value == 100


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_next_trading_day(spark):
    traded = {"A": [1, 2, 5, 30], "B": [3]}
    returns = spark.createDataFrame([(t, day(n), float(n)) for t, own in traded.items() for n in own],
                                    "ticker string, trade_date date, ret double")
    events = [(k, t, day(n) if n is not None else None) for k, (t, n) in enumerate(
        [(t, n) for t in ("A", "B", "C", None) for n in (*range(-12, 34), None)])]
    df = spark.createDataFrame(events, "id long, ticker string, event_date date")
    for strategy in ("auto", "shuffle"):
        got = {r.id: (r.trade_date, r.ret) for r in align_next_trading_day(df, returns, max_gap_days=6, strategy=strategy).collect()}
        assert len(got) == len(events)
        for k, t, d in events:
            later = [n for n in traded.get(t, []) if d is not None and 0 <= (day(n) - d).days <= 6]
            # the very next trading day, if it is in reach
            want = min((n for n in traded.get(t, []) if d is not None and day(n) >= d), default=None)
            want = want if want in later else None
            assert got[k] == ((day(want), float(want)) if want is not None else (None, None))


def test_next_trading_day_keeps_events_where_they_are(spark):
    returns = spark.createDataFrame([("A", day(n), 1.0) for n in range(5)], "ticker string, trade_date date, ret double")
    hot = spark.range(20_000).select("id", F.substring(F.concat(F.lit("A"), F.col("id")), 1, 1).alias("ticker"),
                                      F.date_add(F.lit(day(2)), (F.col("id") * 0).cast("int")).alias("event_date"))
    a = align_next_trading_day(hot, returns)
    assert a.count() == 20_000 and "BroadcastHashJoin" in plan(a) and "SortMergeJoin" not in plan(a)
    p = plan(next_trading_days(returns))
    assert p.count("Window ") == 1 and "Join" not in p


def test_common_types():
    t = T
    assert common_type([t.NullType(), t.IntegerType()]) == t.IntegerType()
    assert common_type([t.IntegerType(), t.LongType(), t.ShortType()]) == t.LongType()
    assert common_type([t.LongType(), t.DoubleType()]) == t.DoubleType()
    assert common_type([t.DecimalType(10, 2), t.DecimalType(12, 4)]) == t.DecimalType(12, 4)
    assert common_type([t.DateType(), t.TimestampType()]) == t.TimestampType()
    for mixed in ([t.StringType(), t.DoubleType()], [t.BooleanType(), t.LongType()], [t.DateType(), t.LongType()],
                  [t.ArrayType(t.LongType()), t.LongType()]):
        assert common_type(mixed) == t.StringType()
    assert common_type([t.NullType()]) == t.NullType()


def test_a_union_of_differing_types_loses_nothing(spark):
    a = spark.createDataFrame([(1, 0.5, [1, 2], True)], "k int, v double, xs array<int>, only_a boolean")
    b = spark.createDataFrame([(2**40, "n/a", "text")], "k long, v string, xs string")
    c = spark.createDataFrame([(None, 3)], "k int, v int")
    rows = [tuple(r) for r in union_events([a, b, c]).select("k", "v", "xs", "only_a").collect()]
    assert rows == [(1, "0.5", "[1,2]", True), (2**40, "n/a", "text", None), (None, "3", None, None)]
    assert "Exchange" not in plan(union_events([a, b, c]))


@pytest.mark.parametrize("text, want", [
    ("2025-11-12", (2025, 11, 12)), ("Nov 12, 2025", (2025, 11, 12)), ("November 2, 2025", (2025, 11, 2)), ("May 2, 2025", (2025, 5, 2)),
    ("12 Nov 2025", (2025, 11, 12)), ("12 November 2025", (2025, 11, 12)), ("1/2/2025", (2025, 1, 2)), ("2025/1/2", (2025, 1, 2)),
    ("20250102", (2025, 1, 2)), ("Nov 12, 2025 10:11:12", (2025, 11, 12)), ("13/13/2025", None), ("Foo 12, 2025", None),
    ("10:11", None), ("", None), (None, None), ("12", None), ("Nov 12 2025", None)])
def test_date_shapes(spark, text, want):
    df = one_col(spark, [text])
    got = df.select(to_date_or_null("t"), published_at_utc("t").cast("date")).first()
    want = dt.date(*want) if want else None
    assert got[0] == want and (text == "12" or got[1] == want)


def test_a_date_column_is_parsed_once(spark):
    p = plan(preprocess_news(B.news_raw(spark, SF_SMALL)))
    assert p.count(DATE_FORMATS[0]) <= 2  # the plan prints a generator's expression beside its input
    assert p.count("try_to_timestamp") + p.count("gettimestamp") + p.count("cast(") < 60
