import datetime as dt
import json

from pyspark.sql import functions as F

from eventlens.functions.sql import register_sql_functions
from eventlens.operators.guards import nan_to_null, optional_col, require_columns
from eventlens.operators.labels import annotation_sheet, standardise, union_events
from eventlens.schemas import FILING_EVENTS
from eventlens.sources.readers import read_prices
from eventlens.streaming.news import aligned_news_stream, filings_stream, start
from eventlens.operators.news import preprocess_news
from eventlens.session import scratch_path


def test_standardise_and_union(spark):
    a = spark.createDataFrame([("f1", "text", 1.0, "Flat")],
                              "filing_id string, item_text string, `AAPL_adj_close` double, `AAPL_cat_D+1` string")
    t = spark.createDataFrame([("n1", "sum", "x")], "news_id string, summary string, title string")
    sa, st = standardise(a, "AAPL", "filing_id", "item_text"), standardise(t, "TSLA", "news_id", "summary")
    assert sa.columns == ["ticker", "event_id", "event_text", "adj_close", "cat_d1"]
    u = union_events([st, sa]).collect()
    assert len(u) == 2 and {r.ticker for r in u} == {"AAPL", "TSLA"}
    assert [r for r in u if r.ticker == "TSLA"][0]["adj_close"] is None
    assert annotation_sheet(t).select("causal_label", "assoc_label").first() == ("", "")


def test_guards(spark):
    df = spark.createDataFrame([(float("nan"), 1.0)], "a double, b double")
    assert nan_to_null(df).first() == (None, 1.0)
    assert df.select(optional_col(df, "zz", "N/A").alias("z")).first().z == "N/A"
    empty = require_columns(df, ["id"], FILING_EVENTS)
    assert empty.count() == 0 and empty.columns == [f.name for f in FILING_EVENTS.fields]


def test_price_scan_with_download_headers(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n"
                                    "2024-01-02,1,2,0.5,1.5,1.4,100\n"
                                    "not-a-date,1,2,0.5,1.5,1.4,100\n"
                                    "2024-01-03,1,2,0.5,1.5,oops,x\n")
    rows = read_prices(spark, str(tmp_path / "p.csv"), "csv", ticker="AAPL").orderBy("trade_date").collect()
    assert [r.trade_date for r in rows] == [dt.date(2024, 1, 2), dt.date(2024, 1, 3)]
    assert rows[0].adj_close == 1.4 and rows[1].adj_close is None and rows[1].volume is None


def test_sql_functions(spark):
    register_sql_functions(spark)
    r = spark.sql("SELECT categorize_return(2.5d) AS c, has_causal_keyword('fell due to rain') AS k, "
                  "strip_tags(' <b>x</b> ') AS s").first()
    assert (r.c, r.k, r.s) == ("Significant Up", True, "x")


def test_stream_equals_batch(spark, tmp_path):
    arts = [{"articlesId": str(i), "publishedAt": {"date": f"2024-01-0{1 + i % 5}T10:00:00Z"},
             "articlesName": f"<b>t{i}</b>", "articlesDescription": json.dumps([{"content": f"Up due to x{i}."}]),
             "ticker": "AAPL"} for i in range(7)]
    land = tmp_path / "land"
    land.mkdir()
    for p in range(2):
        (land / f"page{p}.json").write_text(json.dumps({"articles": arts[p * 4:(p + 1) * 4], "allPages": 2}) + "\n")
    out = scratch_path(spark, "t-stream")
    start(aligned_news_stream(spark, str(land)), out).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("news_id", "summary", "has_causal_keyword").collect())
    batch = preprocess_news(spark.read.json(str(land), schema="articles array<struct<articlesId string, "
                                            "publishedAt struct<date string>, articlesName string, "
                                            "articlesDescription string>>")
                            .select(F.explode("articles").alias("a")).select("a.*"))
    want = sorted(tuple(r) for r in batch.select("news_id", "summary", "has_causal_keyword").collect())
    assert got == want and len(got) == 7


def test_filings_stream_html(spark, tmp_path):
    land = tmp_path / "filings"
    land.mkdir()
    docs = [{"id": f"f{i}", "filing_date": "2025-01-0%d" % (i + 1), "ticker": "AAPL",
             "full_filing_text": f"<html><body><p>Item 2.02 Results {i}.</p><table><tr><td>x</td></tr></table>"
                                 f"<p>Item 9.01 Exhibits.</p></body></html>"} for i in range(3)]
    (land / "a.json").write_text(json.dumps(docs[:2]))
    (land / "b.json").write_text(json.dumps(docs[2:]))
    out = scratch_path(spark, "t-fstream")
    start(filings_stream(spark, str(land)), out).awaitTermination()
    got = {r.filing_id: r.item_text for r in spark.read.parquet(out).collect()}
    assert got == {f"f{i}": f"Item 2.02 Results {i}." for i in range(3)}


def test_stream_restart_resumes_exactly_once(spark, tmp_path):
    def page(ids):
        arts = [{"articlesId": str(i), "publishedAt": {"date": "2024-01-02T10:00:00Z"},
                 "articlesName": f"t{i}", "articlesDescription": json.dumps([{"content": f"Body {i}."}]),
                 "ticker": "AAPL"} for i in ids]
        return json.dumps({"articles": arts, "allPages": 1}) + "\n"
    land = tmp_path / "land"
    land.mkdir()
    (land / "p0.json").write_text(page(range(0, 3)))
    (land / "p1.json").write_text(page(range(3, 5)))
    out, ckpt = scratch_path(spark, "t-restart-out"), scratch_path(spark, "t-restart-ckpt")
    start(aligned_news_stream(spark, str(land)), out, ckpt).awaitTermination()
    (land / "p2.json").write_text(page(range(5, 9)))
    start(aligned_news_stream(spark, str(land)), out, ckpt).awaitTermination()
    ids = sorted(int(r.news_id) for r in spark.read.parquet(out).collect())
    assert ids == list(range(9))
