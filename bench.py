"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query is executed in full with the ``noop`` sink (no rows are pulled to
the driver); the reported time per query is the best of $BENCH_REPEAT runs
after one warm-up pass over all queries.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from eventlens.plans.queries import QUERIES  # noqa: E402
from eventlens.session import get_spark  # noqa: E402

HEADLINE = (
    "align_events", "daily_returns", "news_events", "filing_events", "filing_events_html",
    "html_text", "align_all_tickers", "latest_filings", "parse_answers", "score_models",
    "benchmark_end_to_end", "clean_text", "keyword_screen", "price_range_prune", "filings_with_text",
    "benchmark_labelled", "align_job", "jsonl_roundtrip", "results_glob", "landing_roundtrip",
    "stream_news_events",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = get_spark("eventlens-bench", master=f"local[{cpus}]", shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    errors: dict[str, str] = {}
    for n in names:  # warm-up: JIT, file listing, Python workers
        try:
            run(n)
        except Exception as e:  # keep measuring the others; report the failure
            errors[n] = f"{type(e).__name__}: {str(e)[:200]}"
    times = {n: round(min(run(n) for _ in range(repeat)), 3) for n in names if n not in errors}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_sec_headline_queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "spark": spark.version,
    }
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
