"""Rule scan: which catalog rules fire on a prompt, and with what evidence.

The catalog is unrolled into one literal expression per rule, so the scan is a narrow
projection over the prompts: no join, no shuffle, no Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import inline_rows
from ..functions.regex import jvm_pattern
from ..functions.text import squash, strip
from ..labels import LABELS
from ..sources.rules import RULES

INDICATOR_TYPE = (
    "array<struct<rule_id:string,category:string,label:string,weight:int,"
    "evidence:string,explanation:string,mitigation:string>>"
)
INDICATOR_FIELDS = ["rule_id", "category", "label", "weight", "evidence", "explanation", "mitigation"]
EVIDENCE_CHARS = 180
RULES_PER_ARRAY = 50

# Letters that match an ASCII letter when case is ignored but do not lowercase to it.
_ODD_CASE_LETTERS = ("\u0130", "\u0131", "\u017f")


def _any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _worth_matching(rule, lowered: Column, odd: Column) -> Column:
    """A cheap necessary condition: substring search is far quicker than the regex."""
    if not rule.anchors:
        return F.lit(True)
    return odd | _any_of([lowered.contains(anchor) for anchor in rule.anchors])


def _indicator(rule, text: Column, lowered: Column, odd: Column) -> Column:
    pattern = jvm_pattern(rule.pattern, dotall=rule.dotall)
    found = _worth_matching(rule, lowered, odd) & text.rlike(pattern)
    evidence = squash(strip(F.regexp_extract(text, pattern, 0)))
    return F.when(
        found,
        F.struct(
            F.lit(rule.rule_id).alias("rule_id"),
            F.lit(rule.category).alias("category"),
            F.lit(rule.label).alias("label"),
            F.lit(rule.weight).cast("int").alias("weight"),
            F.substring(evidence, 1, EVIDENCE_CHARS).alias("evidence"),
            F.lit(rule.explanation).alias("explanation"),
            F.lit(rule.mitigation).alias("mitigation"),
        ),
    )


def scan_prompts(prompts: DataFrame, text_col: str = "prompt", rules=RULES) -> DataFrame:
    """Add ``triggered_indicators``: the rules that match, in catalog order.

    Each rule contributes its leftmost match at most once.
    """
    if not rules:
        return prompts.withColumn("triggered_indicators", F.array().cast(INDICATOR_TYPE))
    text = F.col(text_col)
    odd = _any_of([text.contains(letter) for letter in _ODD_CASE_LETTERS])
    staged = prompts.withColumn("_lowered", F.lower(text)).withColumn("_odd_case", odd)
    # Long catalogs go through several arrays, so that no single expression grows with the catalog.
    groups = {}
    for start in range(0, len(rules), RULES_PER_ARRAY):
        part = rules[start : start + RULES_PER_ARRAY]
        fired = [_indicator(rule, text, F.col("_lowered"), F.col("_odd_case")) for rule in part]
        groups[f"_fired{start}"] = F.array_compact(F.array(*fired)).cast(INDICATOR_TYPE)
    if len(groups) == 1:
        found = staged.withColumn("triggered_indicators", *groups.values())
    else:
        found = staged.withColumns(groups).withColumn("triggered_indicators", F.concat(*groups))
    return found.drop("_lowered", "_odd_case", *groups)


def rule_hits(prompts: DataFrame, key: str, text_col: str = "prompt", rules=RULES) -> DataFrame:
    """One row per (prompt, fired rule)."""
    scanned = scan_prompts(prompts, text_col, rules)
    return inline_rows(scanned, "triggered_indicators", INDICATOR_FIELDS, [key])


def category_score(indicators: Column, category: str) -> Column:
    """The highest weight among a prompt's indicators of one category, or 0."""
    weights = F.transform(
        F.filter(indicators, lambda hit: hit["category"] == category), lambda hit: hit["weight"]
    )
    return F.coalesce(F.array_max(weights), F.lit(0))


def category_scores(indicators: Column, labels=LABELS) -> Column:
    """Scores of all labels as an array in label order."""
    return F.array(*[category_score(indicators, name) for name in labels])


def category_score_rows(scanned: DataFrame, key: str) -> DataFrame:
    """Long form: one row per (prompt, label), zero where no rule of that label fired."""
    scores = scanned.select(
        key,
        F.arrays_zip(
            F.array(*[F.lit(name) for name in LABELS]).alias("label"),
            category_scores(F.col("triggered_indicators")).alias("rule_score"),
        ).alias("grid"),
    )
    return inline_rows(scores, "grid", ["label", "rule_score"], [key])
