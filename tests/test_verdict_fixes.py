"""Cases that once lost data without an error."""
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpers import SF_SMALL
from eventlens.functions.dates import published_at_utc, to_date_or_null
from eventlens.functions.ids import padded_cik, zero_padded
from eventlens.operators.align import reference_name
from eventlens.operators.labels import snake_name, standardise
from eventlens.operators.predict import keyword_predictor
from eventlens.operators.returns import prune_prices
from eventlens.plans import bindings as B
from eventlens.plans.pipeline import align_and_save, run_benchmark
from eventlens.schemas import RAW_NEWS, RESULTS
from eventlens.session import scratch_path
from eventlens.sources import readers, writers
from eventlens.streaming.news import aligned_news_stream, start


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_labelled_file_with_prefixed_columns_keeps_its_reactions(spark):
    df = spark.createDataFrame([("e1", "due to x", "Small Up", 1.5), ("e2", "y", "Significant Down", -9.0)],
                               "filing_id string, item_text string, `AAPL_cat_D+1` string, `AAPL_ret_pct_D+1` double")
    ev = standardise(df, "AAPL", "filing_id", "item_text")
    assert ev.columns == ["ticker", "event_id", "event_text", "cat_d1", "ret_pct_d1"]
    got = {r.event_id: r for r in run_benchmark(ev, {"k": keyword_predictor()}).collect()}
    assert got["e1"].effect_llm_pred == "Small Up" and got["e2"].assoc_llm_pred == "Yes"
    raw = ev.withColumnRenamed("cat_d1", "cat_D+1")
    assert {r.effect_llm_pred for r in run_benchmark(raw, {"k": keyword_predictor()}).collect()} == {"Small Up", "Significant Down"}
    with pytest.raises(ValueError):
        run_benchmark(ev.drop("cat_d1"), {"k": keyword_predictor()})
    none = run_benchmark(ev.drop("cat_d1"), {"k": keyword_predictor()}, missing_reaction="N/A").collect()
    assert {r.effect_llm_pred for r in none} == {"N/A"}


def test_names_and_their_inverse():
    for c in ("ret_pct_d0", "cat_d0", "ret_pct_d1", "cat_d12", "adj_close"):
        assert snake_name(reference_name(c)) == c


def test_padding_never_cuts(spark):
    df = spark.createDataFrame([(7,), (999_999,), (1_000_000,), (1_000_007,), (12_345_678_901,)], "k long")
    got = [tuple(r) for r in df.select(zero_padded("k", 6), padded_cik("k")).collect()]
    assert got == [(str(k).zfill(6), str(k).zfill(10)) for k in (7, 999_999, 1_000_000, 1_000_007, 12_345_678_901)]
    big = df.select(B.accession(F.lit(12_345_678_901), F.lit(dt.date(2024, 1, 1)), F.col("k")).alias("a"))
    assert big.distinct().count() == 5


def article(i, when):
    return {"articlesId": str(i), "publishedAt": when, "articlesName": "n", "articlesDescription": "d"}


def test_one_odd_record_does_not_drop_its_file(spark, tmp_path):
    good = {"date": "2024-01-01T00:00:00Z"}
    (tmp_path / "a.json").write_text(json.dumps([article(1, good), article(2, "2024-01-02"), article(3, good)]))
    (tmp_path / "b.json").write_text("[{oops")
    rows = {r.articlesId: r for r in readers.read_json_array(spark, str(tmp_path), RAW_NEWS).collect()}
    assert set(rows) == {"1", "2", "3"} and rows["2"].publishedAt is None and rows["2"].articlesName == "n"
    broken = readers.broken_files(spark, str(tmp_path), RAW_NEWS).collect()
    assert [r.file.rsplit("/", 1)[1] for r in broken] == ["b.json"]


def test_results_written_by_model_are_read_back_beside_foreign_files(spark):
    rows = [(m, str(i), "AAPL", "Yes", "No", "Yes", "No", "a", "b", "multi\nline") for m in ("m 1", "m/2") for i in range(3)]
    df, path = spark.createDataFrame(rows, RESULTS), scratch_path(spark, "t-results")
    writers.write_results(df, path)
    assert sorted(map(tuple, readers.read_results(spark, path).collect())) == sorted(rows)


def test_a_stream_started_again_takes_up_where_it_stopped(spark, tmp_path):
    land, out = tmp_path / "land", str(tmp_path / "out")
    land.mkdir()
    for k in range(2):
        for i in range(5):
            page = {"articles": [article(10 * k + i, {"date": "2024-01-01T00:00:00Z"}) | {"ticker": "T"}]}
            (land / f"p{k}-{i}.json").write_text(json.dumps(page))
        start(aligned_news_stream(spark, str(land)), out).awaitTermination()
    got = [r.news_id for r in spark.read.parquet(out).collect()]
    assert sorted(got, key=int) == [str(10 * k + i) for k in range(2) for i in range(5)]


def test_dates_that_pandas_reads(spark):
    texts = ["2025-11-12", "Nov 12, 2025", "November 12, 2025", "11/12/2025", "12 Nov 2025", "20251112", "2025/11/12", " 2025-11-12 "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0] for r in df.select(to_date_or_null("t")).collect()} == {dt.date(2025, 11, 12)}
    bad = spark.createDataFrame([(t,) for t in ("10:30", "T10:30:00", "n/a", "", "13/13/2025", None)], "t string")
    assert {r[0] for r in bad.select(to_date_or_null("t")).collect()} == {None}
    assert {r[0] for r in bad.select(published_at_utc("t")).collect()} == {None}
    when = df.select(published_at_utc(F.lit("Nov 12, 2025 10:00:00"))).first()[0]
    assert when == dt.datetime(2025, 11, 12, 10)


def test_price_range_reaches_the_scan_and_prunes(spark):
    from eventlens.plans.queries import price_range_prune
    bars = B.ship_bars(spark, SF_SMALL)
    kept = price_range_prune(spark, SF_SMALL)
    assert 0 < kept.count() < bars.count()
    pruned = plan(prune_prices(bars, B.order_events(spark, SF_SMALL), "event_date"))
    below = pruned[pruned.index("partial_max"):]
    assert "l_shipdate" in below and ">= 19" in below.replace("'", "")


def test_bars_use_a_hash_aggregation(spark):
    p = plan(B.bars(spark, SF_SMALL))
    assert "HashAggregate" in p and "SortAggregate" not in p


def test_aligned_sources_are_saved(spark):
    out = scratch_path(spark, "t-align")
    aligned = align_and_save(B.news_raw(spark, SF_SMALL), None, B.bars(spark, SF_SMALL), out)
    assert set(aligned) == {"news"}
    back = readers.read_jsonl(spark, out + "/news", aligned["news"].schema)
    assert back.count() == aligned["news"].count()


def test_reports_are_ordered_by_model_and_target(spark):
    from eventlens.plans.queries import score_report
    rows = [(r.model, r.target) for r in score_report(spark, SF_SMALL).collect()]
    assert rows == sorted(rows) or rows == [(m, t) for m in ("m1", "m2", "m3") for t in ("causal", "assoc")]


def test_a_model_without_a_valid_answer_has_no_scores(spark):
    from eventlens.plans.queries import score_models
    rows = score_models(spark, SF_SMALL).where("model = 'm3'").collect()
    assert len(rows) == 2 and all(r.n_valid == 0 and r.accuracy is None for r in rows)


def test_results_schema_is_closed():
    assert all(isinstance(f.dataType, T.StringType) for f in RESULTS.fields)
