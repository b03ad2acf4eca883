"""Batch prediction over an event table (G1) with pluggable predictors.

Each model is a *factory* that builds a predictor once per Spark task (load
weights, tokenizer, ... there); the predictor maps a pandas batch to raw
answer texts. ``mapInPandas`` streams Arrow batches through all predictors
and emits one row per (event, model), so the event table is never gathered
anywhere and no event is copied per model before the Python boundary.
Parsing the answers stays in Catalyst
(:func:`eventlens.functions.answers.parse_answer`).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from eventlens.functions.text import CAUSAL_PHRASES

Predictor = Callable[[pd.DataFrame], pd.Series]
PredictorFactory = Callable[[], Predictor]

STRONG_MOVES = ("Significant Up", "Significant Down")


def keyword_predictor(phrases=CAUSAL_PHRASES) -> PredictorFactory:
    """A deterministic stand-in model: ``causal`` = a causal phrase occurs in
    the event text, ``assoc`` = the next-day move is significant. Answers
    are compact JSON like a well-behaved model's."""
    phrases = tuple(phrases)

    def make() -> Predictor:
        pat = re.compile(r"\b(?:" + "|".join(re.escape(p) for p in phrases) + r")\b")

        def predict(batch: pd.DataFrame) -> pd.Series:
            out = []
            for text, reaction in zip(batch["event_text"], batch["reaction"]):
                hit = isinstance(text, str) and pat.search(text.lower()) is not None
                out.append(json.dumps({
                    "assoc": "Yes" if reaction in STRONG_MOVES else "No",
                    "causal": "Yes" if hit else "No",
                    "cause": "keyword" if hit else "none",
                    "effect": reaction if isinstance(reaction, str) else "N/A",
                }, separators=(",", ":")))
            return pd.Series(out, index=batch.index, dtype=object)
        return predict
    make.needs_prompt = False  # it reads the event text and the reaction
    return make


CHARS_PER_TOKEN = 4  # rough, only to size batches
WINDOW_ROWS = 4096  # rows of a task that are ordered by length together
WINDOW_CHARS = 32 << 20  # and their prompts, unless one alone is longer


def length_batches(frames: Iterator[pd.DataFrame], length_col: str, token_budget: int,
                   chars_per_token: float = CHARS_PER_TOKEN) -> Iterator[pd.DataFrame]:
    """The rows of a task in batches of prompts of like length: a batch has at
    most ``token_budget`` tokens when every prompt is padded to its longest (a
    prompt beyond the budget is a batch of its own). Rows are held in windows of
    bounded rows and characters, ordered by length within each, so memory does not
    grow with the task and short prompts are not padded to long ones."""
    held: list[pd.DataFrame] = []
    rows = chars = 0

    def cut() -> Iterator[pd.DataFrame]:
        window = pd.concat(held, ignore_index=True)
        size = window[length_col].map(lambda t: len(t) if isinstance(t, str) else 0)
        order = size.sort_values(kind="stable").index
        tokens = (size[order] // chars_per_token + 1).astype(int).tolist()
        start = 0
        for k, n in enumerate(tokens):
            if k > start and n * (k + 1 - start) > token_budget:  # sizes rise: the newest is the longest
                yield window.loc[order[start:k]]
                start = k
        if tokens:
            yield window.loc[order[start:]]

    for frame in frames:
        for at in range(0, len(frame), 256):
            part = frame.iloc[at:at + 256]
            held.append(part)
            rows += len(part)
            chars += int(part[length_col].map(lambda t: len(t) if isinstance(t, str) else 0).sum())
            if rows >= WINDOW_ROWS or chars >= WINDOW_CHARS:
                yield from cut()
                held, rows, chars = [], 0, 0
    if held:
        yield from cut()


def accelerator_profile(cpus: int = 1, **amounts: float) -> ResourceProfile:
    """A resource profile for the prediction stage alone, such as
    ``accelerator_profile(cpus=4, gpu=1)``: the executors and tasks that run the
    model, while the rest of the plan keeps the session's."""
    tasks, executors = TaskResourceRequests().cpus(cpus), ExecutorResourceRequests().cores(cpus)
    for name, n in amounts.items():
        tasks, executors = tasks.resource(name, n), executors.resource(name, max(1, int(n)))
    return ResourceProfileBuilder().require(tasks).require(executors).build


def run_predictors(events: DataFrame, predictors: Mapping[str, PredictorFactory],
                   out_col: str = "raw_answer",
                   drop: tuple[str, ...] = ("prompt", "event_text"),
                   token_budget: int | None = None, length_col: str | None = None,
                   profile: ResourceProfile | None = None) -> DataFrame:
    """G1: one row per (event, model) with the model's raw answer text.

    Each event crosses the Python boundary once: a task feeds every Arrow
    batch to all models and emits one row per model, so prompts are not
    duplicated per model before the boundary (no fan-out join, no explode).
    ``drop`` lists input columns the output does not need (the long texts).
    ``events`` should hold only what the predictors read plus the ids to
    keep: the Python boundary is opaque to column pruning.

    With ``token_budget`` the models get batches of prompts of like length
    (:func:`length_batches`; by ``length_col``, the prompt if there is one);
    their answers are the same. ``profile`` is the resource profile of this
    stage (:func:`accelerator_profile`)."""
    length_col = length_col or ("prompt" if "prompt" in events.columns else "event_text")
    names = list(predictors)
    factories = dict(predictors)
    drop = tuple(c for c in drop if c in events.columns)
    keep = [f for f in events.schema.fields if f.name not in drop]
    schema = T.StructType(keep + [T.StructField("model", T.StringType()),
                                  T.StructField(out_col, T.StringType())])
    keep_names = [f.name for f in keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built: dict[str, Predictor] = {}
        for pdf in batches if token_budget is None else length_batches(batches, length_col, token_budget):
            for model in names:
                if model not in built:
                    built[model] = factories[model]()
                raw = built[model](pdf)
                yield pdf[keep_names].assign(model=model, **{out_col: raw.values})

    return events.mapInPandas(run, schema, profile=profile)
