"""Corpus preparation from raw sources to splits, audit and report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import corpus, split
from ..operators.admission import require_valid
from ..session import materialize
from ..sources.corpus import write_audit, write_prepared, write_table

# The policies a preparation run follows.
POLICY = {
    "duplicates": "Collapsed after whitespace and case normalization.",
    "conflicting_safe_threat_labels": (
        "Resolved to the single threat label when an identical prompt appeared as both safe and malicious."
    ),
    "automatic_relabeling": (
        "Limited to explicit instruction-override commands and DAN-style roleplay in the safe source."
    ),
    "borderline_records": "Left unchanged when a keyword appeared in benign context.",
}


@dataclass(frozen=True)
class Preparation:
    resolution: corpus.Resolution
    assigned: DataFrame  # cleaned rows with their split
    side_rows: int | None = None

    def split(self, name: str) -> DataFrame:
        return self.assigned.filter(F.col("split") == name)

    @property
    def audit(self) -> DataFrame:
        return corpus.relabel_audit(self.resolution)

    @property
    def report(self) -> DataFrame:
        return preparation_report(self.resolution, self.assigned, self.side_rows)


def prepare(raw: DataFrame, on_conflict: str = "strict", seed: int = split.SEED, side_rows: int | None = None) -> Preparation:
    """Validate, relabel, resolve conflicts, deduplicate and split a labelled corpus.

    The normalised rows and the annotated rows feed several jobs each, so both are written
    once to the shared folder instead of being recomputed.
    """
    require_valid(raw)
    working = materialize(corpus.with_identity(corpus.relabel_safe_attacks(raw)), "normalized")
    annotated = materialize(corpus.resolve_duplicates(working, on_conflict).annotated, "annotated")
    resolution = corpus.Resolution(annotated)
    corpus.require_unique(resolution.cleaned)
    assigned = materialize(split.assign_splits(resolution.cleaned, seed), "splits")
    return Preparation(resolution, assigned, side_rows)


def preparation_report(
    resolution: corpus.Resolution, assigned: DataFrame, side_rows: int | None = None
) -> DataFrame:
    """The report as long rows: (section, name, value)."""
    counters = corpus.preparation_counters(resolution.annotated)
    overlap = split.split_overlap(assigned)

    def unpivot(frame: DataFrame, section: str) -> DataFrame:
        cells = F.array(
            *[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("value")) for c in frame.columns]
        )
        return frame.select(F.lit(section).alias("section"), F.inline(cells))

    def counts(column: str, section: str) -> DataFrame:
        return corpus.distribution(assigned, column).select(
            F.lit(section).alias("section"), F.col(column).alias("name"), F.col("rows").alias("value")
        )

    per_split = split.split_report(assigned).select(
        F.concat(F.lit("split."), "split").alias("section"),
        F.coalesce("label", "source_dataset", F.lit("rows")).alias("name"),
        F.col("rows").alias("value"),
    )
    side = counters.select(
        F.lit("counters").alias("section"),
        F.lit("excluded_rows").alias("name"),
        F.lit(side_rows).cast("long").alias("value"),
    )
    parts = [
        unpivot(counters, "counters"),
        side,
        counts("label", "classes"),
        counts("source_dataset", "sources"),
        per_split,
        unpivot(overlap, "overlap"),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def write_preparation(prep: Preparation, path: str, file_format: str = "parquet") -> None:
    """Write cleaned rows, the three splits, the audit and the report below ``path``."""
    write_prepared(prep.resolution.cleaned, f"{path}/cleaned", file_format)
    for name in split.SPLITS:
        write_prepared(prep.split(name), f"{path}/{name}", file_format)
    write_audit(prep.audit, f"{path}/relabel_audit", file_format)
    write_table(prep.report, f"{path}/preparation_report", "json")
    spark = prep.assigned.sparkSession
    write_table(
        spark.createDataFrame(list(POLICY.items()), "name string, policy string"), f"{path}/policy", "json"
    )
