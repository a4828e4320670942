"""The human-readable report of an analysis, as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import inline_rows
from ..functions.wrap import wrap

# Wrap widths.
EVIDENCE_WIDTH = 92
TEXT_WIDTH = 94
TITLE = "Prompt Security Analysis Report"


def wrap_blocks(blocks: Column) -> Column:
    """Wrap each block at its width; width 0 keeps the block as one line."""
    return F.flatten(
        F.transform(
            blocks,
            lambda block: F.when(block["width"] == 0, F.array(block["text"])).otherwise(wrap(block["text"], block["width"])),
        )
    )


def _fixed(*lines: Column) -> Column:
    return F.transform(
        F.array(*lines), lambda line: F.struct(line.alias("text"), F.lit(0).alias("width"))
    )


def _wrapped(items: Column, width: int) -> Column:
    return F.transform(items, lambda item: F.struct(item.alias("text"), F.lit(width).alias("width")))


def _field(label: str, value: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(f"{label}: "), F.coalesce(value.cast("string"), F.lit("")), F.lit(suffix))


def _indicator_blocks(indicators: Column) -> Column:
    per_hit = F.transform(
        indicators,
        lambda hit: F.array(
            F.struct(
                F.concat(
                    F.lit("- "), hit["rule_id"], F.lit(" | "), hit["category"], F.lit(" | "), hit["label"]
                ).alias("text"),
                F.lit(0).alias("width"),
            ),
            F.struct(
                F.concat(F.lit("  Evidence: "), hit["evidence"]).alias("text"),
                F.lit(EVIDENCE_WIDTH).alias("width"),
            ),
        ),
    )
    # A hit without evidence has no evidence line.
    blocks = F.filter(F.flatten(per_hit), lambda block: block["text"] != "  Evidence: ")
    return F.when(F.size(indicators) > 0, blocks).otherwise(_fixed(F.lit("- None")))


def report_blocks(analyses: DataFrame, key: str = "id", title: str = TITLE) -> DataFrame:
    """One row per report: (key, blocks), the blocks in order with their wrap width (0: not wrapped).

    Needs the analysis record plus ``id`` and ``generated_at`` (text).
    """
    bulleted = lambda items: F.transform(items, lambda item: F.concat(F.lit("- "), item))
    blocks = F.concat(
        _fixed(
            F.lit(title),
            _field("Generated", F.col("generated_at")),
            _field("Analysis ID", F.col(key)),
            F.lit(""),
            _field("Classification", F.col("classification")),
            _field("Confidence", F.col("confidence_percent"), "%"),
            _field("Risk Score", F.col("risk_score")),
            _field("Risk Level", F.col("risk_level")),
            _field("Severity", F.col("severity")),
            F.lit(""),
            F.lit("Triggered Indicators:"),
        ),
        _indicator_blocks(F.col("triggered_indicators")),
        _fixed(F.lit(""), F.lit("Explanation:")),
        _wrapped(bulleted(F.col("explanations")), TEXT_WIDTH),
        _fixed(F.lit(""), F.lit("Mitigation Recommendations:")),
        _wrapped(bulleted(F.col("mitigations")), TEXT_WIDTH),
        _fixed(F.lit(""), F.lit("Original Prompt:")),
        _wrapped(F.array(F.coalesce(F.col("prompt"), F.lit(""))), TEXT_WIDTH),
    )
    return analyses.select(F.col(key), blocks.alias("blocks"))


def report_lines(analyses: DataFrame, key: str = "id", title: str = TITLE, max_lines: int | None = None) -> DataFrame:
    """One row per report line: (key, line_no from 0, line); with ``max_lines`` the first lines of each report."""
    laid_out = report_blocks(analyses, key, title)
    wrapped = laid_out.select(key, wrap_blocks(F.col("blocks")).alias("lines"))
    shown = F.col("lines") if max_lines is None else F.slice("lines", 1, max_lines)
    numbered = F.transform(
        shown, lambda line, i: F.struct(i.cast("int").alias("line_no"), line.alias("line"))
    )
    return inline_rows(wrapped.select(key, numbered.alias("numbered")), "numbered", ["line_no", "line"], [key])
