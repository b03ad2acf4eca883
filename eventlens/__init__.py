"""eventlens: a Spark-native event-study and label-benchmark engine."""

from __future__ import annotations

import sys as _sys


def _ship_by_value() -> None:
    # Python-side jobs (HTML parsing, predictors) run in Spark's Python
    # workers; pickling this package's functions by value lets executors run
    # them without installing the package. On a cluster, shipping a wheel
    # with --py-files works as well.
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(_sys.modules[__name__])
    except Exception:  # pragma: no cover - optional
        pass


_ship_by_value()

# Public API: the jobs a pipeline is built from (see README).
from eventlens.operators.align import align_events, empty_returns, prefix_columns, to_wide  # noqa: E402
from eventlens.operators.filings import (filings_with_text, latest_filings,  # noqa: E402
                                         latest_from_index, preprocess_filings)
from eventlens.operators.html import html_to_text  # noqa: E402
from eventlens.operators.labels import annotation_sheet, standardise, union_events  # noqa: E402
from eventlens.operators.metrics import report, score  # noqa: E402
from eventlens.operators.news import preprocess_news  # noqa: E402
from eventlens.operators.predict import keyword_predictor, run_predictors  # noqa: E402
from eventlens.operators.returns import daily_returns, prune_prices, returns_table  # noqa: E402
from eventlens.plans.pipeline import (align_pipeline, benchmark_events,  # noqa: E402
                                      results_from_answers, run_benchmark)
from eventlens.session import get_spark, materialize  # noqa: E402

__all__ = [
    "align_events", "empty_returns", "prefix_columns", "to_wide", "filings_with_text",
    "latest_filings", "latest_from_index", "preprocess_filings", "html_to_text",
    "annotation_sheet", "standardise", "union_events", "report", "score", "preprocess_news",
    "keyword_predictor", "run_predictors", "daily_returns", "prune_prices", "returns_table",
    "align_pipeline", "benchmark_events", "results_from_answers", "run_benchmark",
    "get_spark", "materialize",
]
