import json
import os

from eventlens.operators.filings import explode_index, latest_from_index
from eventlens.schemas import FILING_INDEX, RAW_FILINGS, RESULTS
from eventlens.session import scratch_path
from eventlens.sources import readers, writers


def test_json_array_landing_and_missing(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text(json.dumps([{"id": "1", "filing_date": "2024-01-01", "full_filing_text": "x"},
                                {"id": "2", "filing_date": "2024-01-02", "full_filing_text": "y"}]))
    (tmp_path / "broken.json").write_text("[{oops")
    df = readers.read_json_array(spark, str(tmp_path), RAW_FILINGS)
    assert sorted(r.id for r in df.collect()) == ["1", "2"]
    assert readers.read_json_array(spark, str(tmp_path / "absent"), RAW_FILINGS).count() == 0


def test_results_glob_model_from_file_name(spark, tmp_path):
    header = ",".join(f.name for f in RESULTS.fields if f.name != "model")
    (tmp_path / "model_a_benchmark.csv").write_text(header + '\n1,AAPL,Yes,No,Yes,No,a,b,"multi\nline"\n')
    (tmp_path / "model_b_benchmark.csv").write_text(header + "\n2,AAPL,No,No,No,No,c,d,e\n")
    (tmp_path / "empty_benchmark.csv").write_text("")
    (tmp_path / "notes.csv").write_text(header + "\n3,X,Yes,Yes,Yes,Yes,,,\n")
    rows = {r.model: r for r in readers.read_results(spark, str(tmp_path)).collect()}
    assert set(rows) == {"model_a", "model_b"} and rows["model_a"].raw_llm == "multi\nline"


def test_jsonl_sink_writes_nulls_and_nan(spark):
    df = spark.createDataFrame([("a", float("nan"), None)], "k string, x double, c string")
    path = scratch_path(spark, "t-jsonl")
    writers.write_jsonl(df, path)
    text = "".join(open(os.path.join(path, f)).read() for f in os.listdir(path) if f.endswith(".json"))
    assert json.loads(text) == {"k": "a", "x": None, "c": None}


def test_jsonl_sink_skips_empty_and_formats_times(spark):
    import datetime as dt
    path = scratch_path(spark, "t-jsonl-empty")
    assert writers.write_jsonl(spark.createDataFrame([], "k string"), path) is False
    assert not os.path.exists(path)
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5), dt.date(2024, 1, 2))], "t timestamp, d date")
    path = scratch_path(spark, "t-jsonl-ts")
    writers.write_jsonl(df, path)
    text = "".join(open(os.path.join(path, f)).read() for f in os.listdir(path) if f.endswith(".json"))
    assert json.loads(text) == {"t": "2024-01-02T03:04:05+00:00", "d": "2024-01-02"}


def test_news_pages_and_index(spark, tmp_path):
    page = {"articles": [{"articlesId": "1", "publishedAt": {"date": "2024-01-01T00:00:00Z"},
                          "articlesName": "n", "articlesDescription": "d"}], "allPages": 1}
    (tmp_path / "p0.json").write_text(json.dumps(page))
    (tmp_path / "p1.json").write_text(json.dumps(page))
    assert readers.read_news_pages(spark, str(tmp_path)).count() == 2
    idx = spark.createDataFrame([("320193", ["a-1", "a-2", "a-3"], ["8-K", "10-Q", "8-K"],
                                  ["2025-01-01", "2025-01-02", "2025-01-03"], ["x.htm", "y.htm", "z.htm"])],
                                FILING_INDEX)
    got = latest_from_index(idx, "8-K", 1).collect()
    assert [(r.id, r.html_url) for r in got] == [
        ("a-1", "https://www.sec.gov/Archives/edgar/data/320193/a1/x.htm")]
    assert explode_index(idx).count() == 3


def test_convert_columns_requires_mapped(spark):
    df = spark.createDataFrame([("e", "Yes")], "event string, ground_causal string")
    assert writers.convert_columns(df, {"event": "event_text"}).columns == ["event_text"]
    try:
        writers.convert_columns(df, {"cause": "ground_cause"})
        raise AssertionError("expected KeyError")
    except KeyError:
        pass


def test_cik_and_urls(spark):
    from eventlens.functions.ids import document_url, index_url, padded_cik
    df = spark.createDataFrame([("320193", "0000320193-25-000055", "a8-k.htm")], "cik string, acc string, doc string")
    r = df.select(padded_cik("cik").alias("p"), index_url("cik").alias("i"),
                  document_url("cik", "acc", "doc").alias("d")).first()
    assert r.p == "0000320193"
    assert r.i == "https://data.sec.gov/submissions/CIK0000320193.json"
    assert r.d == "https://www.sec.gov/Archives/edgar/data/320193/000032019325000055/a8-k.htm"


def test_landing_sink_round_trip(spark):
    from eventlens.schemas import RAW_FILINGS
    df = spark.createDataFrame([("1", "2025-01-02", None, None, "Item 2.02 é")], RAW_FILINGS)
    path = scratch_path(spark, "t-landing")
    writers.write_landing(df, path)
    back = readers.read_jsonl(spark, path, RAW_FILINGS).collect()
    assert [tuple(r) for r in back] == [("1", "2025-01-02", None, None, "Item 2.02 é")]
