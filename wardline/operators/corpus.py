"""Corpus cleaning: relabel, find and resolve label conflicts, drop duplicates, audit.

Rows carry their lineage (source_dataset, source_file, source_row). Prompts are compared
by the digest of their normalised text, so long texts are not sorted or shuffled as keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.regex import jvm_pattern
from ..functions.text import normalize_prompt, text_key
from ..labels import LABELS, SAFE, THREATS, label_bit, labels_in_mask
from ..session import materialize
from ..sources.rules import RELABEL_RULES
from .lookup import HOT_FLOOR, attach_key_facts

RELABEL_SOURCE = "safe_evaluation"
SOURCE_ORDER = ("jailbreak", "injection_benign", "safe_evaluation")
# The columns of the prepared corpus and of the audit.
PREPARED_COLUMNS = [
    "prompt",
    "label",
    "source_dataset",
    "source_file",
    "source_row",
    "original_label",
    "relabel_reason",
    "normalized_prompt",
]
AUDIT_COLUMNS = [
    "prompt",
    "original_label",
    "label",
    "relabel_reason",
    "source_dataset",
    "source_file",
    "source_row",
]
LINEAGE = ("source_dataset", "source_file", "source_row")
SAMPLE_CHARS = 120
MAX_BROADCAST_ROWS = 2_000_000  # hashes of rows whose texts are looked for, eight bytes each
ROWS_A_TASK = 100_000  # rows, without texts, that a task holds in memory while texts pass by
_SAFE_BIT = 1
_THREAT_BITS = sum(1 << LABELS.index(name) for name in THREATS)


def source_order(source: Column, order=SOURCE_ORDER) -> Column:
    """Position of a source in the concatenation order; unknown sources come last."""
    position = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        position = F.when(source == name, F.lit(i)).otherwise(position)
    return position


def row_order() -> Column:
    """Total order of corpus rows: source, then file, then record."""
    return F.struct(source_order(F.col("source_dataset")).alias("source_ord"), "source_file", "source_row")


def relabel_safe_attacks(corpus: DataFrame, rules=RELABEL_RULES, source: str = RELABEL_SOURCE) -> DataFrame:
    """Relabel obvious attacks among the Safe rows of the safe source.

    Adds ``original_label`` and ``relabel_reason`` (null when unchanged). Earlier rules win.
    """
    eligible = (F.col("source_dataset") == source) & (F.col("label") == SAFE)
    label, reason = F.col("label"), F.lit(None).cast("string")
    for rule in reversed(rules):
        hit = eligible & F.coalesce(F.col("prompt").rlike(jvm_pattern(rule.pattern)), F.lit(False))
        label = F.when(hit, F.lit(rule.label)).otherwise(label)
        reason = F.when(hit, F.lit(rule.reason)).otherwise(reason)
    return corpus.withColumns({"original_label": F.col("label"), "relabel_reason": reason, "label": label})


def with_identity(relabeled: DataFrame) -> DataFrame:
    """Add ``normalized_prompt`` and its digest ``prompt_key``."""
    normalized = relabeled.withColumn("normalized_prompt", normalize_prompt(F.col("prompt")))
    return normalized.withColumn("prompt_key", text_key(F.col("normalized_prompt")))


def identities(working: DataFrame) -> DataFrame:
    """The rows without their texts: digest, labels and lineage, all that grouping and resolution need.

    Written once (`session.materialize`), they serve any number of jobs without normalising a text again.
    """
    return working.select("prompt_key", "label", "original_label", "relabel_reason", *LINEAGE)


def with_prompts(rows: DataFrame, texts: DataFrame, *columns: str) -> DataFrame:
    """Give rows back their prompt and other ``columns`` of ``texts`` by their lineage, which is unique.

    Rows are written and counted first: hashes of their lineage are broadcast if they are few enough, so that only the
    texts of these rows are shuffled. Texts are never sorted: each task holds its rows, which are narrow, and texts pass by.
    Held rows cannot spill, so the number of tasks grows with them.
    """
    names = ["prompt", *columns]
    rows = materialize(rows, "located")
    held = rows.count()
    if held <= MAX_BROADCAST_ROWS:
        wanted = F.broadcast(rows.select(F.xxhash64(*LINEAGE).alias("_lineage")))
        texts = texts.join(wanted, F.xxhash64(*[texts[c] for c in LINEAGE]) == F.col("_lineage"), "left_semi")
    found = texts.select(*[F.col(c).alias(f"_{c}") for c in LINEAGE], *names)
    tasks = -(-held // ROWS_A_TASK)
    if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(tasks, *LINEAGE)  # texts follow
    same = [F.col(c) == F.col(f"_{c}") for c in LINEAGE]
    return rows.hint("shuffle_hash").join(found, same).select(*rows.columns, *names)


def label_groups(working: DataFrame) -> DataFrame:
    """One row per distinct prompt: its label set as bits, its copies, its first row.

    Every aggregate has a fixed-size state and combines before the shuffle, so a prompt
    copied a billion times costs one row per map task.
    """
    return working.groupBy("prompt_key").agg(
        F.bit_or(label_bit(F.col("label"))).alias("label_mask"),
        F.count(F.lit(1)).alias("copies"),
        F.min(row_order()).alias("first_row"),
    )


def is_conflict(mask: Column) -> Column:
    return F.bit_count(mask) > 1


def resolved_label(mask: Column) -> Column:
    """The label a group settles on; null when its conflict cannot be resolved.

    A conflict resolves only between Safe and exactly one threat label, in favour of the threat.
    """
    threats = mask.bitwiseAND(F.lit(_THREAT_BITS))
    lone_threat = F.get(labels_in_mask(threats), F.lit(0))
    return F.when(F.bit_count(mask) == 1, F.get(labels_in_mask(mask), F.lit(0))).when(
        (F.bit_count(threats) == 1) & (mask.bitwiseAND(F.lit(_SAFE_BIT)) != 0), lone_threat
    )


def conflict_groups(working: DataFrame) -> DataFrame:
    """Prompts that carry more than one label, with their labels and resolution."""
    groups = label_groups(working).filter(is_conflict(F.col("label_mask")))
    return groups.select(
        "prompt_key",
        labels_in_mask(F.col("label_mask")).alias("labels"),
        F.col("copies").alias("rows"),
        resolved_label(F.col("label_mask")).alias("resolved_label"),
    )


def require_resolvable(working: DataFrame) -> None:
    """Raise when some conflict is not between Safe and exactly one threat label."""
    unresolved = label_groups(working).filter(resolved_label(F.col("label_mask")).isNull())
    found = unresolved.agg(
        F.count(F.lit(1)).alias("groups"),
        F.min(F.struct("prompt_key", "label_mask")).alias("sample"),
    ).first()
    if not found["groups"]:
        return
    sample = found["sample"]
    shown = "normalized_prompt" if "normalized_prompt" in working.columns else "prompt_key"
    text = working.filter(F.col("prompt_key") == sample["prompt_key"]).select(
        F.substring(shown, 1, SAMPLE_CHARS)
    ).first()[0]
    names = sorted(n for i, n in enumerate(LABELS) if sample["label_mask"] >> i & 1)
    raise ValueError(
        f"Cannot safely resolve conflicting labels of {found['groups']} normalized prompts, "
        f"for example {text!r}; labels={names}"
    )


def _resolution_reason(label: Column) -> Column:
    # Fixed value: the sentence around the label.
    return F.concat(
        F.lit("Duplicate prompt also appears in a threat dataset; resolved to "), label, F.lit(".")
    )


def annotate_rows(working: DataFrame, hot_floor: int = HOT_FLOOR) -> DataFrame:
    """Every row with the facts of its prompt group.

    Adds ``prior_label`` (before conflict resolution), ``in_conflict``, ``resolvable`` and
    ``is_first`` (the row that survives deduplication), and applies the resolution to
    ``label`` and ``relabel_reason``. Rows of unresolvable groups keep their labels.
    """
    rows = working.withColumn("_row", row_order())
    facts = label_groups(working)
    joined = attach_key_facts(rows, facts, "prompt_key", F.col("_row"), hot_floor=hot_floor)
    settled = resolved_label(F.col("label_mask"))
    moved = is_conflict(F.col("label_mask")) & (F.col("label") == SAFE) & settled.isNotNull()
    return joined.withColumns(
        {
            "prior_label": F.col("label"),
            "in_conflict": is_conflict(F.col("label_mask")),
            "resolvable": settled.isNotNull(),
            "is_first": F.col("_row") == F.col("first_row"),
            "relabel_reason": F.when(moved, _resolution_reason(settled)).otherwise(
                F.col("relabel_reason")
            ),
            "label": F.coalesce(settled, F.col("label")),
        }
    ).drop("_row", "first_row", "label_mask", "copies")


def _first_rows(working: DataFrame, texts: tuple[str, ...]) -> DataFrame:
    """The first row of every resolvable prompt, with its settled label and the given text columns."""
    facts = ("label", "original_label", "relabel_reason", *LINEAGE)
    payload = F.struct(row_order().alias("row"), *facts, *texts)
    merged = working.groupBy("prompt_key").agg(
        F.bit_or(label_bit(F.col("label"))).alias("label_mask"), F.min(payload).alias("first")
    )
    settled = resolved_label(F.col("label_mask"))
    moved = is_conflict(F.col("label_mask")) & (F.col("first.label") == SAFE)
    reason = F.when(moved, _resolution_reason(settled)).otherwise(F.col("first.relabel_reason"))
    return merged.filter(settled.isNotNull()).select(
        "prompt_key",
        settled.alias("label"),
        *[F.col(f"first.{c}").alias(c) for c in ("original_label", *LINEAGE, *texts)],
        reason.alias("relabel_reason"),
    )


def keep_first(working: DataFrame) -> DataFrame:
    """The deduplicated corpus in a single shuffle.

    After resolution a group has one label, so its survivor is its first row: a minimum
    that combines before the shuffle. Unresolvable groups are left out.
    """
    return _first_rows(working, ("prompt", "normalized_prompt"))


def survivors(working: DataFrame) -> DataFrame:
    """The rows of `keep_first` without their texts, which are neither sorted nor shuffled."""
    return _first_rows(working, ())


@dataclass(frozen=True)
class Resolution:
    """Views over the annotated rows; all lazy."""

    annotated: DataFrame

    @property
    def cleaned(self) -> DataFrame:
        return self.annotated.filter(F.col("resolvable") & F.col("is_first"))

    @property
    def dropped_duplicates(self) -> DataFrame:
        return self.annotated.filter(F.col("resolvable") & ~F.col("is_first"))

    @property
    def conflicts(self) -> DataFrame:
        """Rows of conflicting prompts with the labels they had before resolution."""
        return self.annotated.filter("in_conflict").withColumn("label", F.col("prior_label"))

    @property
    def conflict_relabels(self) -> DataFrame:
        return self.annotated.filter(
            F.col("in_conflict") & F.col("resolvable") & (F.col("original_label") != F.col("label"))
        )

    @property
    def quarantined(self) -> DataFrame:
        return self.annotated.filter(~F.col("resolvable"))


def resolve_duplicates(working: DataFrame, on_conflict: str = "strict", hot_floor: int = HOT_FLOOR) -> Resolution:
    """Resolve label conflicts and mark duplicates.

    ``strict`` raises on an unresolvable conflict; ``report`` sets such groups aside in
    ``quarantined``.
    """
    if on_conflict not in ("strict", "report"):
        raise ValueError("on_conflict must be 'strict' or 'report'")
    if on_conflict == "strict":
        require_resolvable(working)
    return Resolution(annotate_rows(working, hot_floor))


def remaining_conflicts(cleaned: DataFrame) -> DataFrame:
    """Prompts that still have several labels or several rows; empty after deduplication."""
    groups = label_groups(cleaned)
    return groups.filter((F.col("copies") > 1) | is_conflict(F.col("label_mask")))


def require_unique(cleaned: DataFrame) -> None:
    left = remaining_conflicts(cleaned).count()
    if left:
        raise ValueError(f"{left} conflicting normalized prompts remain")


def is_changed() -> Column:
    return F.col("relabel_reason").isNotNull() | (F.col("original_label") != F.col("label"))


def relabel_audit(resolution: Resolution, texts: DataFrame | None = None) -> DataFrame:
    """Surviving rows whose label changed plus every row relabelled in a conflict.

    Both branches are tests on the same annotated row, so their union without repeats is
    one filter: no second scan, no deduplication shuffle. A resolution of `identities` takes
    the prompts of its audited rows from ``texts``. Only Safe rows are ever relabelled, by rule or in a conflict, so
    texts of other labels are left out.
    """
    survivor = F.col("resolvable") & F.col("is_first") & is_changed()
    conflict = F.col("in_conflict") & F.col("resolvable") & (F.col("original_label") != F.col("label"))
    found = resolution.annotated.filter(survivor | conflict)
    if texts is not None:
        given = "original_label" if "original_label" in texts.columns else "label"
        found = with_prompts(found, texts.filter(F.col(given) == SAFE))
    return found.select(*AUDIT_COLUMNS)


def ordered(corpus: DataFrame) -> DataFrame:
    return corpus.orderBy("label", "source_dataset", "source_row")


def distribution(corpus: DataFrame, column: str) -> DataFrame:
    return corpus.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).orderBy(column)


def preparation_counters(annotated: DataFrame) -> DataFrame:
    """The counters of a preparation run in one pass over the annotated rows."""
    kept = F.col("resolvable") & F.col("is_first")
    relabeled_before = F.col("prior_label") != F.col("original_label")
    relabeled_in_conflict = (
        F.col("in_conflict") & F.col("resolvable") & (F.col("original_label") != F.col("label"))
    )
    return annotated.agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(kept).alias("unique_rows"),
        F.count_if(F.col("resolvable") & ~F.col("is_first")).alias("removed_duplicates"),
        F.count_if(F.col("in_conflict")).alias("conflicting_rows"),
        F.count_if(relabeled_before).alias("relabeled_before_resolution"),
        F.count_if(relabeled_in_conflict).alias("relabeled_during_resolution"),
        F.count_if(~F.col("resolvable")).alias("quarantined_rows"),
    )
