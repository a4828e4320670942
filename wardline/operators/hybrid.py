"""Fusion of rule evidence and model probabilities into one verdict per prompt.

All steps are narrow projections. Each stage is its own select so that a regex or an
array is computed once and later stages read the finished column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import percent_text, round_even
from ..labels import CLASS_ORDER, LABELS, SAFE, THREATS, label_array, mitigations_for
from ..sources.rules import RULES
from .scan import category_scores, scan_prompts

# Scoring weights, thresholds and sentences.
RULE_BOOST = 0.18
SAFE_PENALTY = 0.55
MODEL_SHARE = 0.72
RULE_SHARE = 0.28
OVERRIDE_AT = 90
SAFE_RISK_CAP = 34
SAFE_RISK_CAP_WITH_HITS = 64
CRITICAL_AT, HIGH_AT, MEDIUM_AT = 85, 65, 35
TOP_EXPLANATIONS = 3
MAX_MITIGATIONS = 6
NO_INDICATOR_TEXT = "No high-confidence rule indicator was matched."
MODEL_TEXT = "The machine learning model predicted %s with %s confidence."
ADJUSTED_TEXT = (
    "The hybrid decision adjusted the model prediction because rule indicators changed the risk profile."
)
BLOCK_TEXT = "The final score is high enough to block or review."
REVIEW_TEXT = "The final score suggests manual review."
SAFE_TEXT = "The final score is low and the prompt appears safe."


def _first_best(scores: Column, labels) -> Column:
    """The label of the highest score; the earliest label wins a tie."""
    position = F.array_position(scores, F.array_max(scores))
    return F.get(label_array(labels), position.cast("int") - 1)


def probability_array(probabilities: Column, labels) -> Column:
    """A label->probability map as an array in the given label order, 0 where absent."""
    return F.array(*[F.coalesce(F.try_element_at(probabilities, F.lit(n)), F.lit(0.0)) for n in labels])


def model_label(probabilities: Column) -> Column:
    return _first_best(probability_array(probabilities, CLASS_ORDER), CLASS_ORDER)


def threat_score(probability: Column, rule_score: Column) -> Column:
    boosted = F.greatest(probability * 100.0, rule_score.cast("double")) + rule_score * F.lit(RULE_BOOST)
    return F.least(F.lit(100.0), boosted)


def safe_score(probability: Column, strongest: Column) -> Column:
    return F.greatest(F.lit(0.0), probability * 100.0 - strongest * F.lit(SAFE_PENALTY))


def hybrid_array(probabilities: Column, rule_scores: Column, strongest: Column) -> Column:
    scores = [safe_score(F.get(probabilities, F.lit(0)), strongest)]
    for i in range(1, len(LABELS)):
        scores.append(threat_score(F.get(probabilities, F.lit(i)), F.get(rule_scores, F.lit(i))))
    return F.array(*scores)


def classification(hybrid: Column, rule_scores: Column, strongest: Column) -> Column:
    """Best hybrid score, unless a very strong rule contradicts a Safe verdict."""
    best = _first_best(hybrid, LABELS)
    threat_rules = F.slice(rule_scores, 2, len(THREATS))
    return F.when(
        (best == SAFE) & (strongest >= OVERRIDE_AT), _first_best(threat_rules, THREATS)
    ).otherwise(best)


def score_of(label: Column, scores: Column) -> Column:
    return F.get(scores, F.array_position(label_array(), label).cast("int") - 1)


def risk_score(label: Column, hybrid: Column, strongest: Column, has_hits: Column) -> Column:
    safe_risk = round_even(F.greatest(F.lit(0.0), 100.0 - F.get(hybrid, F.lit(0))), 0).cast("int")
    cap = F.when(has_hits, F.lit(SAFE_RISK_CAP_WITH_HITS)).otherwise(F.lit(SAFE_RISK_CAP))
    blend = score_of(label, hybrid) * F.lit(MODEL_SHARE) + strongest * F.lit(RULE_SHARE)
    threat_risk = round_even(F.least(F.lit(100.0), blend), 0).cast("int")
    return F.when(label == SAFE, F.least(safe_risk, cap)).otherwise(F.greatest(threat_risk, strongest))


def risk_level(risk: Column) -> Column:
    return (
        F.when(risk >= CRITICAL_AT, "Critical")
        .when(risk >= HIGH_AT, "High")
        .when(risk >= MEDIUM_AT, "Medium")
        .otherwise("Low")
    )


def severity(risk: Column, label: Column) -> Column:
    return (
        F.when((label == SAFE) & (risk < MEDIUM_AT), "Benign")
        .when(risk >= CRITICAL_AT, "Severe")
        .when(risk >= HIGH_AT, "High")
        .when(risk >= MEDIUM_AT, "Moderate")
        .otherwise("Low")
    )


def top_indicators(indicators: Column, n: int = TOP_EXPLANATIONS) -> Column:
    """The n heaviest indicators; catalog order decides between equal weights."""
    keyed = F.transform(
        indicators,
        lambda hit, i: F.struct(
            (-hit["weight"]).alias("rank_key"), i.alias("position"), hit.alias("indicator")
        ),
    )
    return F.transform(F.slice(F.sort_array(keyed), 1, n), lambda entry: entry["indicator"])


def mitigations(label: Column, indicators: Column) -> Column:
    """Class advice, then rule advice, without repeats, at most six."""
    advice = F.concat(mitigations_for(label), F.transform(indicators, lambda hit: hit["mitigation"]))
    return F.slice(F.array_distinct(advice), 1, MAX_MITIGATIONS)


def explanations(
    label: Column, ml_label: Column, ml_confidence: Column, indicators: Column, risk: Column
) -> Column:
    evidence = F.when(
        F.size(indicators) > 0, F.transform(top_indicators(indicators), lambda hit: hit["explanation"])
    ).otherwise(F.array(F.lit(NO_INDICATOR_TEXT)))
    model = F.array(F.format_string(MODEL_TEXT, ml_label, percent_text(ml_confidence)))
    adjusted = F.when(label != ml_label, F.array(F.lit(ADJUSTED_TEXT))).otherwise(
        F.array().cast("array<string>")
    )
    closing = (
        F.when(risk >= HIGH_AT, BLOCK_TEXT).when(risk >= MEDIUM_AT, REVIEW_TEXT).otherwise(SAFE_TEXT)
    )
    return F.concat(evidence, model, adjusted, F.array(closing))


def _rounded_map(scores: Column, digits: int) -> Column:
    pairs = [
        part
        for i, name in enumerate(LABELS)
        for part in (F.lit(name), round_even(F.get(scores, F.lit(i)), digits))
    ]
    return F.create_map(*pairs)


def score_scanned(scanned: DataFrame, probabilities_col: str = "probabilities") -> DataFrame:
    """Add the numeric verdict columns to scanned prompts.

    Needs ``triggered_indicators`` and a label->probability map. Working arrays keep the
    ``LABELS`` order: ``rule_scores``, ``ml_scores``, ``hybrid``.
    """
    staged = scanned.withColumns(
        {
            "rule_scores": category_scores(F.col("triggered_indicators")),
            "ml_scores": probability_array(F.col(probabilities_col), LABELS),
            "ml_label": model_label(F.col(probabilities_col)),
        }
    )
    staged = staged.withColumn("strongest", F.array_max("rule_scores"))
    staged = staged.withColumn(
        "hybrid", hybrid_array(F.col("ml_scores"), F.col("rule_scores"), F.col("strongest"))
    )
    staged = staged.withColumn(
        "classification", classification(F.col("hybrid"), F.col("rule_scores"), F.col("strongest"))
    )
    staged = staged.withColumns(
        {
            "ml_confidence": F.array_max("ml_scores"),
            "confidence": round_even(score_of(F.col("classification"), F.col("hybrid")) / 100.0, 4),
            "risk_score": risk_score(
                F.col("classification"),
                F.col("hybrid"),
                F.col("strongest"),
                F.size("triggered_indicators") > 0,
            ),
        }
    )
    return staged.withColumns(
        {
            "confidence_percent": round_even(F.col("confidence") * 100.0, 2),
            "risk_level": risk_level(F.col("risk_score")),
            "severity": severity(F.col("risk_score"), F.col("classification")),
        }
    )


def assemble(scored: DataFrame, keep=()) -> DataFrame:
    """Project scored prompts to the analysis record, plus the ``keep`` columns."""
    return scored.select(
        *keep,
        "prompt",
        "classification",
        "confidence",
        "confidence_percent",
        "risk_score",
        "risk_level",
        "severity",
        F.struct(
            F.col("ml_label").alias("label"),
            round_even(F.col("ml_confidence"), 4).alias("confidence"),
            _rounded_map(F.col("ml_scores"), 4).alias("probabilities"),
        ).alias("ml_prediction"),
        _rounded_map(F.col("hybrid"), 2).alias("hybrid_scores"),
        F.col("strongest").alias("rule_score"),
        "triggered_indicators",
        explanations(
            F.col("classification"),
            F.col("ml_label"),
            F.col("ml_confidence"),
            F.col("triggered_indicators"),
            F.col("risk_score"),
        ).alias("explanations"),
        mitigations(F.col("classification"), F.col("triggered_indicators")).alias("mitigations"),
    )


def analyze(prompts: DataFrame, rules=RULES, probabilities_col: str = "probabilities", keep=()) -> DataFrame:
    """Admitted prompts with model probabilities to analysis records; batch or stream."""
    return assemble(score_scanned(scan_prompts(prompts, "prompt", rules), probabilities_col), keep)


def ranked_probabilities(probabilities: Column) -> Column:
    """(label, probability) structs, most likely first, probabilities to six decimals."""
    entries = F.array(
        *[
            F.struct(
                (-F.try_element_at(probabilities, F.lit(name))).alias("rank_key"),
                F.lit(i).alias("class_ord"),
                F.lit(name).alias("label"),
            )
            for i, name in enumerate(CLASS_ORDER)
        ]
    )
    present = F.filter(entries, lambda e: e["rank_key"].isNotNull())
    return F.transform(
        F.sort_array(present),
        lambda e: F.struct(e["label"].alias("label"), round_even(-e["rank_key"], 6).alias("probability")),
    )
