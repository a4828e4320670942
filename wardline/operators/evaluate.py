"""Evaluation of predictions.

Every metric is a function of the confusion counts, so the predictions are scanned once:
`confusion_counts` reduces them to at most 25 rows per slice and the rest is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..labels import LABELS, label_array

TOP_ERRORS = 200
LABEL_ISSUE_CONFIDENCE = 0.90


def confidence_and_margin(probabilities: Column) -> tuple[Column, Column]:
    """The highest probability and its distance to the second highest, from an array."""
    ranked = F.sort_array(probabilities, asc=False)
    return F.get(ranked, F.lit(0)), F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1))


def with_correctness(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("correct", F.col("label") == F.col("prediction"))


def confusion_counts(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return predictions.groupBy(*by, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(predictions: DataFrame, labels=LABELS) -> DataFrame:
    """The full matrix in label order: one row per actual label, one column per predicted."""
    known = F.col("label").isin(*labels) & F.col("prediction").isin(*labels)
    counts = confusion_counts(predictions.filter(known))
    # Every label takes part as a row even when it never occurs.
    present = counts.select(F.struct("label", "prediction", "n").alias("cell"))
    slots = F.transform(
        label_array(labels),
        lambda name: F.struct(
            name.alias("actual"),
            F.array_position(label_array(labels), name).cast("int").alias("actual_ord"),
        ),
    )
    rows = present.agg(F.collect_list("cell").alias("cells")).select(
        F.inline(slots), "cells"
    )  # at most labels x labels cells: the counts are already aggregated

    def cell(name: str) -> Column:
        match = F.filter(
            F.col("cells"), lambda c: (c["label"] == F.col("actual")) & (c["prediction"] == name)
        )
        return F.coalesce(F.get(F.transform(match, lambda c: c["n"]), F.lit(0)), F.lit(0)).cast("long")

    matrix = rows.select("actual", "actual_ord", *[cell(name).alias(f"predicted::{name}") for name in labels])
    return matrix.orderBy("actual_ord").drop("actual_ord")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def class_metrics(
    counts: DataFrame, by: Sequence[str] = (), labels=LABELS, present_only: bool = False
) -> DataFrame:
    """Precision, recall, F1 and support per class and slice from confusion counts.

    All ``labels`` appear in every slice, or with ``present_only`` just the labels that occur
    as actual labels there. A zero denominator gives 0.
    """

    def part(name: Column, support: Column, predicted: Column, hit: Column) -> Column:
        return F.struct(
            name.alias("class"), support.alias("support"), predicted.alias("predicted"), hit.alias("hits")
        )

    zero, n = F.lit(0).cast("long"), F.col("n").cast("long")
    hits = F.when(F.col("label") == F.col("prediction"), n).otherwise(zero)
    grid = [part(F.lit(name), zero, zero, zero) for name in labels]
    parts = counts.select(
        *by,
        F.inline(
            F.array(
                part(F.col("label"), n, zero, hits), part(F.col("prediction"), zero, n, zero), *grid
            )
        ),
    )
    sums = parts.groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )
    sums = sums.filter(F.col("class").isin(*labels))
    if present_only:
        sums = sums.filter(F.col("support") > 0)
    scored = sums.withColumns(
        {
            "precision": _ratio(F.col("hits"), F.col("predicted")),
            "recall": _ratio(F.col("hits"), F.col("support")),
            "f1": _ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")),
        }
    )
    return scored.select(*by, F.col("class").alias("label"), "precision", "recall", "f1", "support", "hits")


def overall_metrics(
    counts: DataFrame, by: Sequence[str] = (), labels=LABELS, present_only: bool = False
) -> DataFrame:
    """Rows, accuracy, macro F1 over the label set and support-weighted F1, per slice."""
    per_class = class_metrics(counts, by, labels, present_only)
    return per_class.groupBy(*by).agg(
        F.sum("support").alias("rows"),
        _ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )


def classification_report(predictions: DataFrame, labels=LABELS) -> DataFrame:
    """Per-class rows, then accuracy (repeated in all four columns), macro and weighted averages."""
    per_class = class_metrics(confusion_counts(predictions), (), labels)
    averages = per_class.agg(
        _ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.sum("support").cast("double").alias("total"),
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[
            _ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}")
            for m in ("precision", "recall", "f1")
        ],
    )

    def row(order: int, name: str, *values: Column) -> Column:
        fields = ("precision", "recall", "f1_score", "support")
        return F.struct(
            F.lit(order).alias("row_ord"),
            F.lit(name).alias("name"),
            *[v.cast("double").alias(f) for f, v in zip(fields, values)],
        )

    accuracy = F.col("accuracy")
    summary = averages.select(
        F.inline(
            F.array(
                row(len(labels), "accuracy", accuracy, accuracy, accuracy, accuracy),
                row(
                    len(labels) + 1,
                    "macro avg",
                    F.col("macro_precision"),
                    F.col("macro_recall"),
                    F.col("macro_f1"),
                    F.col("total"),
                ),
                row(
                    len(labels) + 2,
                    "weighted avg",
                    F.col("weighted_precision"),
                    F.col("weighted_recall"),
                    F.col("weighted_f1"),
                    F.col("total"),
                ),
            )
        )
    )
    classes = per_class.select(
        (F.array_position(label_array(labels), F.col("label")) - 1).cast("int").alias("row_ord"),
        F.col("label").alias("name"),
        "precision",
        "recall",
        F.col("f1").alias("f1_score"),
        F.col("support").cast("double").alias("support"),
    )
    return classes.unionByName(summary).orderBy("row_ord")


def metrics_document(predictions: DataFrame) -> DataFrame:
    """All metrics as long rows (slice, label, metric, value); 'all' marks overall rows."""
    counts = confusion_counts(predictions, ["source_dataset"]).select(
        F.explode(F.array(F.lit("all"), F.col("source_dataset"))).alias("slice"), "label", "prediction", "n"
    )
    whole, sliced = counts.filter("slice = 'all'"), counts.filter("slice <> 'all'")

    def unpivot(frame: DataFrame, metrics: Sequence[str], label: Column) -> DataFrame:
        pairs = F.array(
            *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
        )
        return frame.select("slice", label.alias("label"), F.inline(pairs))

    frames = []
    for part, present in ((whole, False), (sliced, True)):
        per_class = class_metrics(part, ["slice"], present_only=present)
        overall = overall_metrics(part, ["slice"], present_only=present)
        frames.append(unpivot(per_class, ["precision", "recall", "f1", "support"], F.col("label")))
        frames.append(unpivot(overall, ["rows", "accuracy", "macro_f1", "weighted_f1"], F.lit("all")))
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])


def metrics_struct(predictions: DataFrame) -> DataFrame:
    """One row, ``metrics``: overall scores, a map of class scores and a map of scores by source, sorted by name.

    The maps have an entry a class and one a source, from counts of at most 25 rows a source.
    """
    counts = confusion_counts(predictions, ["source_dataset"])
    totals = counts.groupBy("label", "prediction").agg(F.sum("n").alias("n"))
    scores = F.struct("rows", "accuracy", "macro_f1", "weighted_f1").alias("scores")

    def as_map(frame: DataFrame, key: str, value: Column, name: str) -> DataFrame:
        return frame.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), value)))).alias(name))

    whole = overall_metrics(totals).agg(*[F.first(c).alias(c) for c in ("rows", "accuracy", "macro_f1", "weighted_f1")])
    classes = as_map(class_metrics(totals), "label", F.struct("precision", "recall", "f1", "support"), "per_class")
    sources = as_map(overall_metrics(counts, ["source_dataset"], present_only=True).select("source_dataset", scores), "source_dataset", F.col("scores"), "by_source")
    parts = F.struct("accuracy", "macro_f1", "weighted_f1", "rows", classes.scalar().alias("per_class"), sources.scalar().alias("by_source"))
    return whole.select(parts.alias("metrics"))


def top_errors(predictions: DataFrame, n: int = TOP_ERRORS, tie_break: Sequence[str] = ()) -> DataFrame:
    """The n most confident errors, by confidence then margin."""
    wrong = with_correctness(predictions).filter(~F.col("correct"))
    return wrong.orderBy(F.col("confidence").desc(), F.col("confidence_margin").desc(), *tie_break).limit(n)


def label_issues(predictions: DataFrame, threshold: float = LABEL_ISSUE_CONFIDENCE) -> DataFrame:
    """Rows whose confident prediction contradicts their label: review these labels."""
    suspect = (F.col("label") != F.col("prediction")) & (F.col("confidence") >= threshold)
    return predictions.filter(suspect)


def review_queue(splits: dict[str, DataFrame], threshold: float = LABEL_ISSUE_CONFIDENCE) -> DataFrame:
    """Suspect rows of several splits, tagged with the split, most confident first."""
    tagged = [
        label_issues(frame, threshold).withColumn("split", F.lit(name)) for name, frame in splits.items()
    ]
    queue = tagged[0]
    for frame in tagged[1:]:
        queue = queue.unionByName(frame)
    return queue.orderBy(F.col("confidence").desc())


def class_weights(labels: DataFrame) -> DataFrame:
    """Balanced and square-root balanced weights of the labels present."""
    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    totals = counts.agg(F.struct(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("classes"))).scalar()
    weighted = counts.withColumn("_all", totals)
    balanced = F.col("_all.rows") / (F.col("_all.classes") * F.col("rows"))
    return weighted.select(
        "label", "rows", balanced.alias("balanced"), F.sqrt(balanced).alias("sqrt_balanced")
    )


def select_candidate(candidates: DataFrame) -> DataFrame:
    """The candidate with the best (macro F1, weighted F1); the earliest wins a tie.

    Needs candidate, candidate_ord, macro_f1, weighted_f1.
    """
    return candidates.agg(
        F.max_by(
            F.struct("candidate", "macro_f1", "weighted_f1"),
            F.struct("macro_f1", "weighted_f1", (-F.col("candidate_ord")).alias("earliest")),
        ).alias("best")
    ).select("best.*")
