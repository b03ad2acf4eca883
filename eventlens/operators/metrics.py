"""Scoring predictions against human labels.

The two targets are unpivoted to long form and scored in one aggregation
pass: partial aggregates are computed map-side, so the shuffle carries one
row per (model, target) per task, whatever the skew of the result table.
Filtering happens *inside* the conditional aggregates, so a model/target
with no valid pair still yields a row (``n_valid = 0``, metrics null).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference's for identical results.
POSITIVE = "Yes"
VALID_LABELS = ("Yes", "No")
TARGETS = (("causal", "ground_causal", "causal_llm_pred"),
           ("assoc", "ground_assoc", "assoc_llm_pred"))
# ---------------------------------------------------------------------------


def to_long(results: DataFrame) -> DataFrame:
    """``model, target, truth, pred`` (values cast to text, as the reference
    compares strings)."""
    parts = ", ".join(f"'{t}', cast(`{g}` as string), cast(`{p}` as string)"
                      for t, g, p in TARGETS)
    return results.select("model", F.expr(f"stack({len(TARGETS)}, {parts})")
                          .alias("target", "truth", "pred"))


def score(results: DataFrame) -> DataFrame:
    """``model, target, n_valid, accuracy, precision, recall, f1`` for the
    positive class ``Yes``; zero division -> 0; no valid pair -> nulls."""
    t, p = F.col("truth"), F.col("pred")
    valid = t.isin(*VALID_LABELS) & p.isin(*VALID_LABELS)
    agg = (to_long(results).groupBy("model", "target")
           .agg(F.count_if(valid).alias("n_valid"),
                F.count_if(valid & (t == p)).alias("correct"),
                F.count_if(valid & (t == POSITIVE) & (p == POSITIVE)).alias("tp"),
                F.count_if(valid & (t != POSITIVE) & (p == POSITIVE)).alias("fp"),
                F.count_if(valid & (t == POSITIVE) & (p != POSITIVE)).alias("fn")))
    n, tp, fp, fn = (F.col(c).cast("double") for c in ("n_valid", "tp", "fp", "fn"))
    some = F.col("n_valid") > 0

    def zdiv(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return agg.select(
        "model", "target", F.col("n_valid").cast("bigint").alias("n_valid"),
        F.when(some, F.col("correct") / n).alias("accuracy"),
        F.when(some, zdiv(tp, tp + fp)).alias("precision"),
        F.when(some, zdiv(tp, tp + fn)).alias("recall"),
        F.when(some, zdiv(2 * tp, 2 * tp + fp + fn)).alias("f1"))


def percent(c) -> F.Column:
    """``0.4`` -> ``40.00%``, rounded like Python's ``{x:.2%}`` (the
    exact binary value, ties to even: 0.78125 -> ``78.12%``); null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.format_number(c * 100, 2), F.lit("%"))


def report(metrics: DataFrame) -> DataFrame:
    """Printable metrics, ordered by model then target."""
    return (metrics.select("model", "target", "n_valid",
                           *[percent(m).alias(f"{m}_pct")
                             for m in ("accuracy", "precision", "recall", "f1")])
            .orderBy("model", "target"))
