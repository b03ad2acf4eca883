"""The README's usage example, on a small landed folder."""
import json

from pyspark.sql import functions as F

from eventlens.operators.predict import keyword_predictor
from eventlens.plans.pipeline import align_pipeline, benchmark_events, evaluate, run_benchmark
from eventlens.schemas import RAW_FILINGS
from eventlens.sources.readers import read_json_array, read_prices


def test_readme_example(spark, tmp_path):
    (tmp_path / "filings").mkdir()
    (tmp_path / "prices").mkdir()
    filings = [{"id": f"0000320193-25-00000{i}", "filing_date": f"2025-01-0{i + 6}",
                "full_filing_text": f"<html><body><p>Item 2.02 Results. Sales rose due to demand {i}.</p>"
                                    f"<p>Item 9.01 Exhibits.</p></body></html>"} for i in range(3)]
    (tmp_path / "filings" / "f.json").write_text(json.dumps(filings, indent=2))
    days = ["2025-01-03", "2025-01-06", "2025-01-07", "2025-01-08", "2025-01-09", "2025-01-10"]
    lines = ["Date,Open,High,Low,Close,Adj Close,Volume"] + [
        f"{d},1,1,1,{100 + k},{100 + k * 3},{1000 + k}" for k, d in enumerate(days)]
    (tmp_path / "prices" / "aapl.csv").write_text("\n".join(lines) + "\n")

    f = (read_json_array(spark, str(tmp_path / "filings"), RAW_FILINGS)
         .withColumn("ticker", F.lit("AAPL")))
    prices = read_prices(spark, str(tmp_path / "prices"), "csv", ticker="AAPL")
    aligned = align_pipeline(None, f, prices)
    results = run_benchmark(benchmark_events(aligned), {"keyword": keyword_predictor()})
    rows = {r.event_id: r for r in results.collect()}
    assert len(rows) == 3 and all(r.causal_llm_pred == "Yes" for r in rows.values())
    a = {r.filing_id: r for r in aligned["filings"].collect()}
    assert a["0000320193-25-000000"].cat_d1 == "Significant Up"   # 103 -> 106
    assert a["0000320193-25-000000"].item_text == "Item 2.02 Results. Sales rose due to demand 0."
    m = evaluate(results).collect()
    assert {r.target for r in m} == {"causal", "assoc"} and all(r.n_valid == 0 for r in m)
