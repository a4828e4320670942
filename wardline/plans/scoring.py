"""Scoring prompts with a fitted model: classification alone, or the full analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.admission import accepted
from ..operators.hybrid import analyze, ranked_probabilities
from ..operators.linear import LinearTextModel, with_probabilities
from ..sources.rules import RULES


def classify_prompts(prompts: DataFrame, model: LinearTextModel, keep=()) -> DataFrame:
    """Model verdict per prompt: best class, its probability, all classes ranked (six decimals)."""
    scored = with_probabilities(prompts, model, "prompt")
    ranked = scored.select(*keep, "prompt", ranked_probabilities(F.col("probabilities")).alias("ranked"))
    best = F.get("ranked", F.lit(0))
    return ranked.select(
        *keep,
        "prompt",
        best["label"].alias("classification"),
        best["probability"].alias("confidence"),
        F.col("ranked").alias("probabilities"),
    )


def analyze_prompts(
    prompts: DataFrame, model: LinearTextModel, rules=RULES, keep=(), max_chars: int | None = None
) -> DataFrame:
    """Strip and admit prompts, score them with the model and the rules, build the records.

    Row-local throughout: batches and streams alike, no shuffle. `admission.rejected` with
    the same ``max_chars`` gives the prompts left out.
    """
    return analyze(with_probabilities(accepted(prompts, max_chars=max_chars), model, "prompt"), rules, keep=keep)
