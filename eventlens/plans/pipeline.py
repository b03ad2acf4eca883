"""Composed jobs (T6, T8): the align pipeline and the benchmark pipeline,
for all tickers in one plan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.functions.answers import build_prompt, keep_raw, with_parsed_answer
from eventlens.functions.dates import published_at_utc, to_date_or_null
from eventlens.operators.align import align_events
from eventlens.operators.filings import preprocess_filings
from eventlens.operators.guards import optional_col
from eventlens.operators.labels import annotation_sheet, union_events
from eventlens.operators.metrics import score
from eventlens.operators.news import preprocess_news
from eventlens.operators.predict import PredictorFactory, run_predictors
from eventlens.operators.returns import prune_prices, returns_table
from eventlens.plans.sizing import sized_side
from eventlens.session import materialize
from eventlens.sources import readers, writers


def event_dates(news_raw: DataFrame | None, filings_raw: DataFrame | None) -> DataFrame:
    """``ticker, event_date`` of every event, read from the *raw* inputs: the
    dates need two columns, and Catalyst prunes the scans to them (the
    preprocessed filings sit behind the Python HTML step, which would not)."""
    parts = []
    if news_raw is not None:
        parts.append(news_raw.select(
            "ticker", F.to_date(published_at_utc(F.col("publishedAt").getField("date"))).alias("event_date")))
    if filings_raw is not None:
        parts.append(filings_raw.select("ticker", to_date_or_null("filing_date").alias("event_date")))
    return union_events(parts)


def align_pipeline(news_raw: DataFrame | None, filings_raw: DataFrame | None,
                   prices: DataFrame, filing_form="8-K", filing_text_mode: str = "html",
                   strategy: str = "auto", prune: bool = True,
                   loads: dict[str, Observation] | None = None) -> dict[str, DataFrame]:
    """Preprocess each source, compute returns once (materialised in the
    shared folder, reused by both joins) and align every ticker at once.
    ``prune`` keeps each ticker's prices to its events' window (A1, +-30
    days) before the returns are computed, as the reference's download did,
    and afterwards keeps only the event days; events are at least 30 days
    inside the window, so their returns are the same either way. ``loads``
    takes an observation of the loaded rows of each source (A3), filled by the
    first query over that source's result. Returns
    ``{"news": ..., "filings": ...}``."""
    returns = None
    if prune:
        # one pass over the raw events: their distinct days give the window too
        dates = materialize(event_dates(news_raw, filings_raw).where("event_date is not null").distinct())
        prices = prune_prices(prices, dates, "event_date", strategy=strategy)
        # returns are computed on the pruned daily series, then only the rows
        # of actual event days are kept: the side to broadcast is bounded by
        # the distinct (ticker, event day) pairs
        keys = dates.select("ticker", F.col("event_date").alias("trade_date"))
        returns = returns_table(prices).join(keys, ["ticker", "trade_date"], "left_semi")
    # sized (and materialised) once, shared by both joins
    returns = sized_side(returns if returns is not None else returns_table(prices),
                         strategy=strategy)
    out = {}
    if loads is not None:  # only what is aligned counts, not the pass over the dates above
        if news_raw is not None:
            news_raw, loads["news"] = writers.counted(news_raw)
        if filings_raw is not None:
            filings_raw, loads["filings"] = writers.counted(filings_raw)
    if news_raw is not None:
        news = preprocess_news(news_raw).withColumnRenamed("published_date_utc", "event_date")
        out["news"] = align_events(news, returns, "event_date", "prepared")
    if filings_raw is not None:
        fil = preprocess_filings(filings_raw, filing_form, filing_text_mode)
        fil = fil.withColumnRenamed("filing_date", "event_date")
        out["filings"] = align_events(fil, returns, "event_date", "prepared")
    return out


def benchmark_events(aligned: Mapping[str, DataFrame]) -> DataFrame:
    """P5/U1 for the all-ticker tables: ``event_id, event_text`` per source,
    unioned by name (columns a source lacks become null)."""
    frames = []
    if "news" in aligned:
        frames.append(aligned["news"].withColumnsRenamed(
            {"news_id": "event_id", "summary": "event_text"}).withColumn("source", F.lit("news")))
    if "filings" in aligned:
        frames.append(aligned["filings"].withColumnsRenamed(
            {"filing_id": "event_id", "item_text": "event_text"}).withColumn("source", F.lit("filings")))
    return union_events(frames)


def run_benchmark(events: DataFrame, predictors: Mapping[str, PredictorFactory],
                  unwrap_fences: bool = False, missing_reaction: str | None = None,
                  token_budget: int | None = None, profile: ResourceProfile | None = None) -> DataFrame:
    """Prompt (F17) -> predictors (G1) -> parsed answers.
    Ground labels come from ``causal_label``/``assoc_label`` when present
    (missing column -> ``''``, P11); the reaction from ``cat_d1`` or
    ``cat_D+1``. A table with neither is refused, as every prompt would be
    wrong without a word; ``missing_reaction`` (such as ``N/A``) allows it.
    The prompt is built only for predictors that read it. ``token_budget`` and
    ``profile``: see :func:`eventlens.operators.predict.run_predictors`."""
    reaction = next((c for c in ("cat_d1", "cat_D+1") if c in events.columns), None)
    if reaction is None and missing_reaction is None:
        raise ValueError("no reaction column: cat_d1 or cat_D+1")
    ev = events.select(
        "event_id", "ticker", "event_text",
        (F.col(f"`{reaction}`") if reaction else F.lit(missing_reaction)).alias("reaction"),
        optional_col(events, "causal_label", "").alias("ground_causal"),
        optional_col(events, "assoc_label", "").alias("ground_assoc"))
    if any(getattr(f, "needs_prompt", True) for f in predictors.values()):
        ev = ev.withColumn("prompt", build_prompt("event_text", "reaction"))
    raw = run_predictors(ev, predictors, "raw_answer", token_budget=token_budget, profile=profile)
    return results_from_answers(raw, unwrap_fences)


def results_from_answers(raw: DataFrame, unwrap_fences: bool = False) -> DataFrame:
    """the result table from raw answers."""
    parsed = with_parsed_answer(raw, "raw_answer", suffix="_llm_pred", unwrap_fences=unwrap_fences)
    return parsed.select(
        "model", "event_id", "ticker", "ground_causal", "ground_assoc",
        "causal_llm_pred", "assoc_llm_pred", "cause_llm_pred", "effect_llm_pred",
        keep_raw("raw_answer").alias("raw_llm"))


def annotate(spark: SparkSession, jsonl_path: str, schema: T.StructType, csv_path: str) -> None:
    """T5: an aligned table as JSON Lines -> the sheet for annotators as CSV."""
    writers.write_csv(annotation_sheet(readers.read_jsonl(spark, jsonl_path, schema)), csv_path)


def convert(spark: SparkSession, csv_path: str, schema: T.StructType, jsonl_path: str,
            field_map: Mapping[str, str]) -> None:
    """K4: an annotated CSV -> JSON Lines with the mapped columns."""
    writers.write_jsonl(writers.convert_columns(readers.read_csv(spark, csv_path, schema), field_map),
                        jsonl_path, skip_empty=False)


def align_and_save(news_raw: DataFrame | None, filings_raw: DataFrame | None, prices: DataFrame,
                   out_dir: str, counts: dict[str, int] | None = None, **options) -> dict[str, DataFrame]:
    """T8 to its end: align every ticker and save each source as JSON Lines
    under ``out_dir`` (``news``, ``filings``); an empty source writes nothing.
    ``counts`` takes the rows loaded and saved (A3) as ``load news``,
    ``save news``, ...; the writes count them on their way."""
    loads: dict[str, Observation] | None = None if counts is None else {}
    aligned = align_pipeline(news_raw, filings_raw, prices, loads=loads, **options)
    for source, df in aligned.items():
        rows = writers.save_jsonl(df, f"{out_dir.rstrip('/')}/{source}")
        if counts is not None:
            counts |= {f"load {source}": loads[source].get["rows"], f"save {source}": rows}
    return aligned


def evaluate(results: DataFrame) -> DataFrame:
    """T7 over a result table."""
    return score(results)
