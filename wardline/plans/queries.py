"""The registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text
from ..functions.regex import WORD_END, WORD_START
from ..labels import LABELS
from ..operators import admission, corpus, evaluate, history, hybrid, linear, report, rule_index, scan, split, tfidf
from ..session import materialize, new_table_path
from ..sources.corpus import (
    forward_slash,
    load_labelled_csv,
    load_split,
    number_rows,
    numbered_csv,
    side_source_rows,
    tag_lineage,
    write_audit,
    write_prepared,
    write_table,
)
from ..sources.history import clear_log, read_log, result_json, write_log_part
from ..sources.rules import RULES
from ..streaming import jobs
from . import fixtures
from .preparation import preparation_report
from .scoring import analyze_prompts, classify_prompts
from .training import EVALUATED, TrainSettings, write_predictions
from .training import train_and_evaluate as fit_and_evaluate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

JOINER = " | "
WEAK_RULES = tuple(replace(rule, weight=rule.weight // 10) for rule in RULES)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def joined(items: Column) -> Column:
    return F.array_join(items, JOINER)


# --- rules ------------------------------------------------------------------------------


@query
def rule_scan_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = scan.rule_hits(fixtures.planted_prompts(spark, d), "doc_id")
    return hits.select("doc_id", "rule_id", "category", "label", "weight")


@query
def rule_evidence(spark: SparkSession, d: str) -> DataFrame:
    return scan.rule_hits(fixtures.planted_prompts(spark, d), "doc_id").select("doc_id", "rule_id", "evidence")


@query
def rule_scan_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = fixtures.read(spark, d, "pages")
    return scan.rule_hits(pages, "page_id", "html").select("page_id", "rule_id", "evidence")


@query
def rule_catalog_summary(spark: SparkSession, d: str) -> DataFrame:
    """Rules, heaviest weight and prompts hit per category."""
    hits = scan.rule_hits(fixtures.planted_prompts(spark, d), "doc_id")
    per_rule = hits.groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"))
    catalog = spark.createDataFrame(
        [(r.rule_id, r.category, r.weight) for r in RULES], "rule_id string, category string, weight int"
    )
    return (
        catalog.join(per_rule, "rule_id", "left")
        .groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("rules"),
            F.max("weight").alias("max_weight"),
            F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"),
        )
    )


@query
def category_scores(spark: SparkSession, d: str) -> DataFrame:
    return scan.category_score_rows(scan.scan_prompts(fixtures.planted_prompts(spark, d)), "doc_id")


@query
def strongest_rule(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", F.col("strongest").alias("rule_score"))


def _word_rules(spark: SparkSession, d: str) -> DataFrame:
    """A user catalog of thousands of rules: one for every longer word of the conversations and the benchmark."""
    texts = fixtures.read(spark, d, "conversations").select("text").unionByName(fixtures.read(spark, d, "benchmark").select("text"))
    words = texts.select(F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{8,})"), 1)).alias("word"))
    distinct = words.filter(F.col("word").isNotNull()).distinct()
    return distinct.select(
        F.pmod(F.xxhash64("word"), F.lit(1 << 31)).cast("int").alias("rule_ord"),
        F.concat(F.lit("word:"), "word").alias("rule_id"),
        F.lit("words").alias("category"),
        F.lit(LABELS[1]).alias("label"),
        F.lit(10).alias("weight"),
        F.concat(F.lit(f"(?ui){WORD_START}"), "word", F.lit(WORD_END)).alias("pattern"),
        F.lit("").alias("explanation"),
        F.lit("").alias("mitigation"),
        F.array("word").alias("literals"),
    )


@query
def catalog_scan(spark: SparkSession, d: str) -> DataFrame:
    """Thousands of user rules over all documents by the literal index: documents hit by every rule."""
    catalog = materialize(_word_rules(spark, d), "catalog")
    hits = rule_index.catalog_hits(fixtures.documents(spark, d), catalog, ["doc_id"], "text")
    return hits.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc"), F.min(F.lower("evidence")).alias("evidence")
    )


# --- hybrid verdict -----------------------------------------------------------------------


def _scored(spark: SparkSession, d: str, rules=RULES) -> DataFrame:
    return hybrid.score_scanned(scan.scan_prompts(fixtures.prompts_with_probabilities(spark, d), rules=rules))


def _label_rows(frame: DataFrame, **arrays: Column) -> DataFrame:
    """(doc_id, label, ...) rows from arrays in label order."""
    names = F.array(*[F.lit(n) for n in LABELS]).alias("label")
    zipped = frame.select(
        "doc_id", F.arrays_zip(names, *[a.alias(n) for n, a in arrays.items()]).alias("cells")
    )
    return zipped.select("doc_id", F.inline_outer("cells"))


@query
def hybrid_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _label_rows(_scored(spark, d), hybrid_score=F.col("hybrid"))
    return rows.withColumn("hybrid_score", F.round("hybrid_score", 6))


@query
def hybrid_classification(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", "ml_label", "classification", "confidence", "confidence_percent")


@query
def override_classification(spark: SparkSession, d: str) -> DataFrame:
    """The override of a Safe verdict by a very strong rule, over scores that favour Safe."""
    favour_safe = F.transform(F.col("ml_scores"), lambda p, i: F.when(i == 0, F.lit(100.0)).otherwise(p))
    verdict = hybrid.classification(favour_safe, F.col("rule_scores"), F.col("strongest"))
    return _scored(spark, d).select("doc_id", verdict.alias("classification"))


@query
def weak_rule_risk(spark: SparkSession, d: str) -> DataFrame:
    """A user catalog of low weights, where Safe verdicts with indicators do occur."""
    return _scored(spark, d, WEAK_RULES).select("doc_id", "classification", "risk_score")


@query
def risk_profile(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", "risk_score", "risk_level", "severity")


@query
def risk_summary(spark: SparkSession, d: str) -> DataFrame:
    """Admitted prompts by verdict: the flagship query."""
    admitted = admission.accepted(fixtures.prompts_with_probabilities(spark, d))
    scored = hybrid.score_scanned(scan.scan_prompts(admitted))
    return scored.groupBy("classification", "risk_level", "severity").agg(
        F.count(F.lit(1)).alias("prompts"), F.max("risk_score").alias("max_risk")
    )


@query
def mitigations_top6(spark: SparkSession, d: str) -> DataFrame:
    advice = hybrid.mitigations(F.col("classification"), F.col("triggered_indicators"))
    return _scored(spark, d).select("doc_id", joined(advice).alias("mitigations"))


@query
def top3_indicators(spark: SparkSession, d: str) -> DataFrame:
    top = hybrid.top_indicators(F.col("triggered_indicators"))
    return _scored(spark, d).select(
        "doc_id", joined(F.transform(top, lambda hit: hit["rule_id"])).alias("rule_ids")
    )


@query
def explanations(spark: SparkSession, d: str) -> DataFrame:
    told = hybrid.explanations(
        F.col("classification"),
        F.col("ml_label"),
        F.col("ml_confidence"),
        F.col("triggered_indicators"),
        F.col("risk_score"),
    )
    return _scored(spark, d).select("doc_id", joined(told).alias("explanations"))


@query
def ranked_probabilities(spark: SparkSession, d: str) -> DataFrame:
    docs = fixtures.read(spark, d, "documents").select("doc_id", fixtures.probabilities().alias("p"))
    ranked = docs.select("doc_id", hybrid.ranked_probabilities(F.col("p")).alias("ranked"))
    rows = F.transform(
        F.col("ranked"),
        lambda e, i: F.struct((i + 1).cast("int").alias("rank"), e["label"].alias("label"), e["probability"].alias("probability")),
    )
    return ranked.select("doc_id", F.inline_outer(rows))


@query
def rounded_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _label_rows(_scored(spark, d), probability=F.col("ml_scores"), hybrid_score=F.col("hybrid"))
    return rows.select(
        "doc_id",
        "label",
        text.round_even(F.col("probability"), 4).alias("probability"),
        text.round_even(F.col("hybrid_score"), 2).alias("hybrid_score"),
    )


def _records(spark: SparkSession, d: str) -> DataFrame:
    admitted = admission.accepted(fixtures.prompts_with_probabilities(spark, d))
    return hybrid.analyze(admitted, keep=["doc_id"])


@query
def analysis_record(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d)
    return records.select(
        "doc_id",
        "prompt",
        "classification",
        "confidence",
        "confidence_percent",
        "risk_score",
        "risk_level",
        "severity",
        F.col("ml_prediction.label").alias("ml_label"),
        F.col("ml_prediction.confidence").alias("ml_confidence"),
        F.try_element_at(F.col("ml_prediction.probabilities"), F.lit(LABELS[0])).alias("safe_probability"),
        F.try_element_at(F.col("hybrid_scores"), F.lit(LABELS[0])).alias("safe_hybrid"),
        "rule_score",
        joined(F.col("triggered_indicators.rule_id")).alias("rule_ids"),
        joined(F.col("triggered_indicators.evidence")).alias("evidence"),
        joined(F.col("explanations")).alias("explanations"),
        joined(F.col("mitigations")).alias("mitigations"),
    )


@query
def analysis_json(spark: SparkSession, d: str) -> DataFrame:
    """Records through their JSON text and back."""
    records = _records(spark, d)
    fields = [c for c in records.columns if c != "doc_id"]
    schema = records.select(*fields).schema
    texts = records.select("doc_id", result_json(fields).alias("result_json"))
    parsed = texts.select("doc_id", F.from_json("result_json", schema).alias("r"))
    return parsed.select(
        "doc_id",
        F.col("r.classification").alias("classification"),
        F.col("r.risk_score").alias("risk_score"),
        F.col("r.confidence").alias("confidence"),
        F.size("r.triggered_indicators").cast("long").alias("indicators"),
        F.length("r.prompt").cast("long").alias("prompt_chars"),
    )


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """Records ready for reports; written first, as the blocks name every field several times and the scoring
    expressions must not be copied into each."""
    records = _records(spark, d).withColumn("generated_at", F.lit("2024-01-31 00:00:00"))
    return materialize(records.withColumn("id", F.col("doc_id").cast("string")), "records")


def _verdict_model(spark: SparkSession, d: str) -> linear.LinearTextModel:
    """The stand-in model over the vocabulary of the admitted prompts."""
    admitted = admission.accepted(fixtures.planted_prompts(spark, d))
    vocabulary = materialize(tfidf.fit_vocabulary(admitted, "doc_id", "prompt"), "vocabulary")
    return linear.local_model(vocabulary, _coefficients(vocabulary), INTERCEPTS)


@query
def model_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The main path in one plan: prompts through the text model and the rules to verdicts; nothing is shuffled."""
    records = analyze_prompts(fixtures.planted_prompts(spark, d), _verdict_model(spark, d), keep=["doc_id"])
    return records.select(
        "doc_id",
        F.col("ml_prediction.label").alias("ml_label"),
        F.col("ml_prediction.confidence").alias("ml_confidence"),
        "classification",
        "confidence",
        "risk_score",
        "risk_level",
        "severity",
    )


@query
def report_lines(spark: SparkSession, d: str) -> DataFrame:
    return report.report_lines(_reports(spark, d))


@query
def report_blocks(spark: SparkSession, d: str) -> DataFrame:
    """What a report says before its lines are wrapped: blocks in order with their width."""
    return report.report_blocks(_reports(spark, d)).select("id", F.posexplode("blocks").alias("block_no", "block")).select(
        "id", "block_no", "block.text", "block.width"
    )


@query
def conversation_risk(spark: SparkSession, d: str) -> DataFrame:
    """Every turn of every conversation scanned, by role and strongest rule."""
    turns = fixtures.read(spark, d, "conversations")
    scanned = scan.scan_prompts(turns.select("role", F.col("text").alias("prompt")))
    strongest = scanned.select(
        "role", F.array_max(scan.category_scores(F.col("triggered_indicators"))).alias("rule_score")
    )
    return strongest.groupBy("role", "rule_score").agg(F.count(F.lit(1)).alias("turns"))


# --- admission and validation -------------------------------------------------------------


@query
def admission_reasons(spark: SparkSession, d: str) -> DataFrame:
    admitted = admission.admit(fixtures.planted_prompts(spark, d), max_chars=admission.INTERACTIVE_CHARS)
    return admitted.groupBy(F.coalesce("rejection", F.lit("accepted")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("prompts"), F.max(F.length("prompt")).cast("long").alias("longest")
    )


def _unchecked_corpus(spark: SparkSession, d: str) -> DataFrame:
    """All documents with whatever label they have, some prompts blank, some labels unknown."""
    docs = fixtures.documents(spark, d).join(fixtures.read(spark, d, "labels"), "doc_id", "left")
    return docs.select(
        F.when(F.col("source") == "src18", F.lit(" \t ")).otherwise(F.col("text")).alias("prompt"),
        F.when(F.col("source") == "src19", F.concat(F.lit("Unlisted "), "lang"))
        .when(F.col("source") == "src17", F.lit(" "))
        .when(F.col("quality").isNotNull(), F.expr(fixtures.LABEL))
        .alias("label"),
    )


@query
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    return admission.validation_report(_unchecked_corpus(spark, d))


@query
def label_domain_diff(spark: SparkSession, d: str) -> DataFrame:
    return admission.invalid_labels(_unchecked_corpus(spark, d))


@query
def null_counts(spark: SparkSession, d: str) -> DataFrame:
    found = admission.null_counts(_unchecked_corpus(spark, d), ["prompt", "label"])
    return found.select(F.col("prompt").alias("null_prompts"), F.col("label").alias("null_labels"))


@query
def normalized_prompt(spark: SparkSession, d: str) -> DataFrame:
    docs = fixtures.documents(spark, d).select(
        "doc_id", text.normalize_prompt(F.expr(fixtures.PLANTED)).alias("normalized_prompt")
    )
    return docs.select(
        "doc_id", "normalized_prompt", text.text_key(F.col("normalized_prompt")).alias("prompt_key")
    )


@query
def text_profile(spark: SparkSession, d: str) -> DataFrame:
    docs = fixtures.documents(spark, d).select("doc_id", text.strip(F.col("text")).alias("stripped"))
    return docs.select(
        "doc_id",
        F.length("stripped").cast("long").alias("chars"),
        text.text_key(F.col("stripped")).alias("digest"),
        text.bucket_of(text.text_key(F.col("stripped"))).cast("long").alias("bucket"),
    )


@query
def source_lineage(spark: SparkSession, d: str) -> DataFrame:
    tagged = tag_lineage(number_rows(fixtures.read(spark, d, "documents")), "documents", "given\\documents.csv")
    return tagged.select("doc_id", "source_dataset", "source_file", "source_row")


# --- corpus preparation -------------------------------------------------------------------


def _working(spark: SparkSession, d: str) -> DataFrame:
    return corpus.with_identity(corpus.relabel_safe_attacks(fixtures.raw_corpus(spark, d)))


def _resolution(spark: SparkSession, d: str) -> corpus.Resolution:
    """Resolution over the rows without their texts, which are normalised once and written."""
    rows = materialize(corpus.identities(_working(spark, d)), "identities")
    return corpus.resolve_duplicates(rows, on_conflict="report")


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return split.assign_splits(materialize(corpus.survivors(_working(spark, d)), "survivors"))


@query
def relabel_safe(spark: SparkSession, d: str) -> DataFrame:
    relabeled = corpus.relabel_safe_attacks(fixtures.raw_corpus(spark, d))
    return relabeled.select("source_file", "source_row", "label", "original_label", "relabel_reason")


@query
def conflict_groups(spark: SparkSession, d: str) -> DataFrame:
    groups = corpus.conflict_groups(_working(spark, d))
    return groups.select("prompt_key", joined(F.col("labels")).alias("labels"), "rows", "resolved_label")


@query
def conflict_rows(spark: SparkSession, d: str) -> DataFrame:
    return _resolution(spark, d).conflicts.select("source_file", "source_row", "label", "prompt_key")


@query
def resolved_labels(spark: SparkSession, d: str) -> DataFrame:
    return _resolution(spark, d).annotated.select(
        "source_file", "source_row", "label", "relabel_reason", "in_conflict", "resolvable", "is_first"
    )


@query
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return corpus.survivors(_working(spark, d)).select(
        "prompt_key", "source_file", "source_row", "label", "original_label", "relabel_reason"
    )


@query
def dropped_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return _resolution(spark, d).dropped_duplicates.select("source_file", "source_row", "label")


@query
def conflict_relabels(spark: SparkSession, d: str) -> DataFrame:
    return _resolution(spark, d).conflict_relabels.select(
        "source_file", "source_row", "label", "original_label", "relabel_reason"
    )


@query
def quarantined_rows(spark: SparkSession, d: str) -> DataFrame:
    return _resolution(spark, d).quarantined.select("source_file", "source_row", "label", "prompt_key")


@query
def remaining_conflicts(spark: SparkSession, d: str) -> DataFrame:
    left = corpus.remaining_conflicts(corpus.survivors(_working(spark, d)))
    return left.agg(F.count(F.lit(1)).alias("groups"))


@query
def relabel_audit(spark: SparkSession, d: str) -> DataFrame:
    return corpus.relabel_audit(_resolution(spark, d), fixtures.raw_corpus(spark, d))


@query
def prepared_corpus(spark: SparkSession, d: str) -> DataFrame:
    return corpus.ordered(corpus.keep_first(_working(spark, d))).select(*corpus.PREPARED_COLUMNS)


@query
def prep_counters(spark: SparkSession, d: str) -> DataFrame:
    return corpus.preparation_counters(_resolution(spark, d).annotated)


@query
def class_distribution(spark: SparkSession, d: str) -> DataFrame:
    return corpus.distribution(corpus.survivors(_working(spark, d)), "label")


@query
def source_distribution(spark: SparkSession, d: str) -> DataFrame:
    return corpus.distribution(corpus.survivors(_working(spark, d)), "source_dataset")


@query
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d).select("prompt_key", "label", "source_dataset", "split")


@query
def split_rows(spark: SparkSession, d: str) -> DataFrame:
    """A training split as the loader prunes it: three columns, no nulls."""
    rows = _assigned(spark, d).filter("split = 'test'")
    return corpus.with_prompts(rows, fixtures.raw_corpus(spark, d)).select("prompt", "label", "source_dataset")


@query
def split_report(spark: SparkSession, d: str) -> DataFrame:
    return split.split_report(_assigned(spark, d))


@query
def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    return split.split_overlap(_assigned(spark, d))


@query
def prep_report(spark: SparkSession, d: str) -> DataFrame:
    annotated = materialize(_resolution(spark, d).annotated, "annotated")
    resolution = corpus.Resolution(annotated)
    assigned = materialize(split.assign_splits(resolution.cleaned), "splits")
    pages = fixtures.read(spark, d, "pages").count()  # stands in for the excluded side corpus
    return preparation_report(resolution, assigned, pages)


# --- sources and sinks ----------------------------------------------------------------------


def _digested(frame: DataFrame, *columns: str) -> DataFrame:
    """Rows with the digest of their prompt, as they came back from a written table."""
    return frame.select(F.sha2("prompt", 256).alias("prompt_digest"), *columns)


@query
def csv_sources(spark: SparkSession, d: str) -> DataFrame:
    """The labelled documents written as CSV, a folder a source, and loaded with lineage."""
    root, rows = new_table_path(spark, "csv"), fixtures.labelled_corpus(spark, d)
    sources = {name: f"raw\\{name}" for name in corpus.SOURCE_ORDER}
    for name, relative in sources.items():
        write_table(rows.filter(F.col("source_dataset") == name).select("prompt", "label"), f"{root}/{forward_slash(relative)}", "csv")
    loaded = load_labelled_csv(spark, root, sources)
    return _digested(loaded, "label", "source_dataset", "source_file")


@query
def csv_record_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Records of a CSV source and whether the numbers in each of its files are dense from 2 on."""
    path = new_table_path(spark, "csv")
    write_table(fixtures.labelled_corpus(spark, d).select("prompt", "label"), path, "csv")
    per_file = numbered_csv(spark, path).groupBy("source_path").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("source_row").alias("numbers"), F.min("source_row").alias("low"), F.max("source_row").alias("high")
    )
    dense = (F.col("n") == F.col("numbers")) & (F.col("low") == 2) & (F.col("high") == F.col("n") + 1)
    return per_file.agg(F.sum("n").alias("records"), F.bool_and(dense).alias("dense"))


@query
def side_source(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a corpus kept out of the core, pages as CSV, and of one that is absent."""
    path = new_table_path(spark, "side")
    pages = fixtures.read(spark, d, "pages").select(F.col("html").alias("prompt"), F.lit("Safe Prompt").alias("label"))
    write_table(pages, path, "csv")
    schema = "side_rows long, absent_rows long"
    return spark.createDataFrame([(side_source_rows(spark, path), side_source_rows(spark, f"{path}-absent"))], schema)


@query
def written_prepared(spark: SparkSession, d: str) -> DataFrame:
    """The prepared corpus written to its sink and read back."""
    path = new_table_path(spark, "prepared")
    write_prepared(corpus.keep_first(_working(spark, d)), path)
    left = [c for c in corpus.PREPARED_COLUMNS if c not in ("prompt", "normalized_prompt")]
    back = spark.read.parquet(path).select(*corpus.PREPARED_COLUMNS)
    return _digested(back, *left, F.sha2("normalized_prompt", 256).alias("prompt_key"))


@query
def loaded_splits(spark: SparkSession, d: str) -> DataFrame:
    """The three splits written, loaded again and checked as training loads them; rows and characters of each."""
    placed = materialize(corpus.with_prompts(_assigned(spark, d), fixtures.raw_corpus(spark, d)), "placed")
    parts = []
    for name in split.SPLITS:
        path = new_table_path(spark, name)
        write_prepared(placed.filter(F.col("split") == name), path, "csv" if name == "test" else "parquet")
        loaded = load_split(spark, path, "csv" if name == "test" else "parquet")
        parts.append(loaded.withColumn("split", F.lit(name)))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("split", "label", "source_dataset").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.length("prompt")).cast("long").alias("chars")
    )


@query
def written_audit(spark: SparkSession, d: str) -> DataFrame:
    """The audit written to its sink and read back."""
    path = new_table_path(spark, "audit")
    write_audit(corpus.relabel_audit(_resolution(spark, d), fixtures.raw_corpus(spark, d)), path)
    back = spark.read.parquet(path).select(*corpus.AUDIT_COLUMNS)
    return _digested(back, *[c for c in corpus.AUDIT_COLUMNS if c != "prompt"])


@query
def validation_errors(spark: SparkSession, d: str) -> DataFrame:
    """The one error that names every problem of a corpus, and that of a table with other columns."""
    unchecked = materialize(_unchecked_corpus(spark, d), "unchecked")
    labels = fixtures.read(spark, d, "labels")
    checks = {
        "corpus": lambda: admission.require_valid(unchecked),
        "known": lambda: admission.require_valid(unchecked.filter(F.col("label").isin(*LABELS) & (text.strip(F.col("prompt")) != ""))),
        "columns": lambda: admission.require_columns(labels, ["prompt", "label"], "labels"),
        "split": lambda: admission.require_split(unchecked.withColumn("source_dataset", F.lit("jailbreak"))),
    }
    return spark.createDataFrame([(name, _error_of(check)) for name, check in checks.items()], "check string, error string")


def _error_of(check: Callable[[], None]) -> str | None:
    try:
        check()
    except ValueError as error:
        return str(error)
    return None


# --- evaluation ---------------------------------------------------------------------------


@query
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    weights = evaluate.class_weights(fixtures.labelled_documents(spark, d))
    return weights.select(
        "label", "rows", F.round("balanced", 9).alias("balanced"), F.round("sqrt_balanced", 9).alias("sqrt_balanced")
    )


@query
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion_matrix(fixtures.predictions(spark, d))


def _rounded(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, 9) for c in columns})


@query
def class_metrics(spark: SparkSession, d: str) -> DataFrame:
    scored = evaluate.class_metrics(evaluate.confusion_counts(fixtures.predictions(spark, d)))
    return _rounded(scored, "precision", "recall", "f1").drop("hits")


@query
def overall_metrics(spark: SparkSession, d: str) -> DataFrame:
    scored = evaluate.overall_metrics(evaluate.confusion_counts(fixtures.predictions(spark, d)))
    return _rounded(scored, "accuracy", "macro_f1", "weighted_f1")


@query
def class_metrics_by_source(spark: SparkSession, d: str) -> DataFrame:
    by = ["source_dataset"]
    counts = evaluate.confusion_counts(fixtures.predictions(spark, d), by)
    scored = evaluate.class_metrics(counts, by, present_only=True)
    return _rounded(scored, "precision", "recall", "f1").drop("hits")


@query
def metrics_by_source(spark: SparkSession, d: str) -> DataFrame:
    by = ["source_dataset"]
    counts = evaluate.confusion_counts(fixtures.predictions(spark, d), by)
    scored = evaluate.overall_metrics(counts, by, present_only=True)
    return _rounded(scored, "accuracy", "macro_f1", "weighted_f1")


@query
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    report_rows = evaluate.classification_report(fixtures.predictions(spark, d))
    return _rounded(report_rows, "precision", "recall", "f1_score", "support")


@query
def metrics_document(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluate.metrics_document(fixtures.predictions(spark, d)), "value")


@query
def written_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation of both splits written to its sinks; what is read back, by split and table."""
    predictions = materialize(
        fixtures.predictions(spark, d).join(fixtures.documents(spark, d).select("doc_id", F.col("text").alias("prompt")), "doc_id"), "predictions"
    )
    path, parts = new_table_path(spark, "evaluation"), []
    write_predictions(predictions, path)
    for name in EVALUATED:
        table = lambda kind: spark.read.parquet(f"{path}/{name}/{kind}")  # noqa: E731, B023
        counts = {
            "predictions": table("predictions").agg(F.count(F.lit(1)).alias("rows"), F.count_if("correct").alias("value")),
            "highest_confidence_errors": table("highest_confidence_errors").agg(
                F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("correct")).alias("value")
            ),
            "confusion_matrix": table("confusion_matrix").agg(F.count(F.lit(1)).alias("rows"), sum(F.sum(F.col(f"`predicted::{c}`")) for c in LABELS).alias("value")),
            "classification_report": table("classification_report").agg(
                F.count(F.lit(1)).alias("rows"), F.max("support").cast("long").alias("value")
            ),
            "metrics": table("metrics").filter("slice = 'all' AND metric = 'rows'").agg(F.count(F.lit(1)).alias("rows"), F.max("value").cast("long").alias("value")),
        }
        parts += [frame.select(F.lit(name).alias("split"), F.lit(kind).alias("sink"), "rows", "value") for kind, frame in counts.items()]
    issues = spark.read.parquet(f"{path}/probable_label_issues").groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    parts.append(issues.select("split", F.lit("probable_label_issues").alias("sink"), "rows", F.col("rows").alias("value")))
    return reduce(DataFrame.unionByName, parts)


@query
def error_counts(spark: SparkSession, d: str) -> DataFrame:
    checked = evaluate.with_correctness(fixtures.predictions(spark, d))
    return checked.groupBy("source_dataset", "correct").agg(F.count(F.lit(1)).alias("rows"))


@query
def top_errors(spark: SparkSession, d: str) -> DataFrame:
    errors = evaluate.top_errors(fixtures.predictions(spark, d), tie_break=["doc_id"])
    return _rounded(errors, "confidence", "confidence_margin").select(
        "doc_id", "label", "prediction", "confidence", "confidence_margin"
    )


@query
def label_issues(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.predictions(spark, d)
    parts = {name: rows.filter(F.col("split") == name).drop("split") for name in ("validation", "test")}
    return _rounded(evaluate.review_queue(parts), "confidence").select(
        "doc_id", "label", "source_dataset", "split", "prediction", "confidence"
    )


@query
def confidence_margin(spark: SparkSession, d: str) -> DataFrame:
    p = hybrid.probability_array(fixtures.probabilities(), LABELS)
    staged = fixtures.read(spark, d, "documents").select("doc_id", p.alias("p"))
    confidence, margin = evaluate.confidence_and_margin(F.col("p"))
    return staged.select("doc_id", F.round(confidence, 9).alias("confidence"), F.round(margin, 9).alias("margin"))


@query
def candidate_selection(spark: SparkSession, d: str) -> DataFrame:
    """Two sets of predictions scored like candidates; the second lacks the most confident errors."""
    rows = fixtures.predictions(spark, d)
    other = F.when(F.col("confidence") > 0.8, F.col("label")).otherwise(F.col("prediction"))
    pairs = rows.select(
        "label",
        F.inline(
            F.array(
                F.struct(F.lit("balanced").alias("candidate"), F.lit(0).alias("candidate_ord"), F.col("prediction")),
                F.struct(F.lit("sqrt_balanced").alias("candidate"), F.lit(1).alias("candidate_ord"), other.alias("prediction")),
            )
        ),
    )
    by = ["candidate", "candidate_ord"]
    scores = evaluate.overall_metrics(evaluate.confusion_counts(pairs, by), by)
    return _rounded(evaluate.select_candidate(scores), "macro_f1", "weighted_f1")


# --- features and model -------------------------------------------------------------------


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.fit_vocabulary(fixtures.documents(spark, d), "doc_id", max_features=tfidf.MAX_FEATURES)


def _coefficients(vocabulary: DataFrame) -> DataFrame:
    """A stand-in model: every (term, label) weight comes from a digest."""
    rows = vocabulary.select("term", F.explode(F.array(*[F.lit(n) for n in LABELS])).alias("label"))
    digits = F.conv(F.substring(F.sha2(F.concat("term", "label"), 256), 1, 6), 16, 10).cast("double")
    return rows.withColumn("coefficient", digits / F.lit(16777216.0) * 4.0 - 2.0)


INTERCEPTS = {name: 0.25 * i for i, name in enumerate(LABELS)}


@query
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = fixtures.documents(spark, d).select("doc_id", text.fold_accents(F.col("text")).alias("folded"))
    tokens = docs.select("doc_id", text.word_tokens(F.col("folded")).alias("tokens"))
    grams = tokens.select("doc_id", "tokens", text.with_bigrams(F.col("tokens")).alias("grams"))
    return grams.select(
        "doc_id",
        F.size("tokens").cast("long").alias("tokens"),
        F.size("grams").cast("long").alias("grams"),
        F.size(F.array_distinct("grams")).cast("long").alias("terms"),
    )


@query
def term_stats(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.term_stats(tfidf.document_terms(fixtures.documents(spark, d), "doc_id"))


@query
def vocabulary_topk(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = _vocabulary(spark, d)
    return vocabulary.select("term", "term_id", "df", "tf", F.round("idf", 9).alias("idf"))


@query
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    weights = tfidf.tfidf_weights(fixtures.documents(spark, d), _vocabulary(spark, d), "doc_id")
    return weights.select("doc_id", "term_id", F.round("weight", 9).alias("weight"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = tfidf.local_vocabulary(_vocabulary(spark, d))
    return tfidf.with_vectors(fixtures.documents(spark, d).select("doc_id", "text"), vocabulary).filter(F.size("indices") > 0)


@query
def document_norms(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("doc_id", F.size("indices").cast("long").alias("nonzero"), F.round("norm", 6).alias("norm"))


@query
def matrix_stats(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.matrix_stats(_vectors(spark, d).select(F.explode("indices").alias("term_id")))


def _stand_in_model(spark: SparkSession, d: str) -> linear.LinearTextModel:
    vocabulary = materialize(_vocabulary(spark, d), "vocabulary")
    return linear.local_model(vocabulary, _coefficients(vocabulary), INTERCEPTS)


@query
def linear_scores(spark: SparkSession, d: str) -> DataFrame:
    scores = linear.linear_scores(fixtures.documents(spark, d), _stand_in_model(spark, d), "doc_id")
    return scores.select(
        "doc_id", "label", F.round("margin", 6).alias("margin"), F.round("probability", 6).alias("probability")
    )


@query
def model_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """The probabilities as the scoring path carries them: a map per prompt."""
    docs = fixtures.documents(spark, d).select("doc_id", "text")
    scored = linear.with_probabilities(docs, _stand_in_model(spark, d), "text", "p")
    return scored.select("doc_id", F.explode_outer("p").alias("label", "probability")).withColumn(
        "probability", F.round("probability", 6)
    )


@query
def batch_classification(spark: SparkSession, d: str) -> DataFrame:
    prompts = fixtures.documents(spark, d).select("doc_id", F.col("text").alias("prompt"))
    verdicts = classify_prompts(prompts, _stand_in_model(spark, d), keep=["doc_id"])
    ranked = F.transform(F.col("probabilities"), lambda e: e["label"])
    return verdicts.select("doc_id", "classification", "confidence", joined(ranked).alias("ranking"))


@query
def top_features(spark: SparkSession, d: str) -> DataFrame:
    top = linear.top_features(_coefficients(_vocabulary(spark, d)))
    return _rounded(top, "coefficient")


@query
def train_and_evaluate(spark: SparkSession, d: str) -> DataFrame:
    """Fit both weightings on the labelled documents; what is determined about the run, whatever the optimizer did.

    One row a class: rows of the three splits, vocabulary, class weights, and whether the fits converged, their gradients
    on the whole training set are small, and the better one was selected.
    """
    working = corpus.with_identity(corpus.relabel_safe_attacks(fixtures.labelled_corpus(spark, d)))
    assigned = materialize(split.assign_splits(corpus.keep_first(working)), "labelled")
    parts = [assigned.filter(F.col("split") == name) for name in split.SPLITS]
    run = fit_and_evaluate(*parts, settings=TrainSettings())
    weights = {c.name: c.class_weight for c in run.candidates}
    rows = [(name, weights["balanced"][name], weights["sqrt_balanced"][name]) for name in run.classes]
    table = spark.createDataFrame(rows, "label string, balanced double, sqrt_balanced double")
    scored = run.predictions.groupBy("label").agg(F.count(F.lit(1)).alias("held_out_rows"))
    facts = {f"{name}_rows": F.lit(run.split_rows.get(name, 0)).cast("long") for name in split.SPLITS}
    return _rounded(table, "balanced", "sqrt_balanced").join(scored, "label", "left").fillna(0, ["held_out_rows"]).withColumns(
        {
            **facts,
            "vocabulary_size": F.lit(run.vocabulary.count()).cast("long"),
            "converged": F.lit(run.converged),
            "gradient_is_small": F.lit(run.certified),
            "best_is_selected": F.lit(run.best_is_selected),
        }
    )


# --- history ------------------------------------------------------------------------------


def _listing(log: DataFrame) -> DataFrame:
    return log.withColumn("created_at", text.utc_text(F.col("created_at")))


@query
def history_recent(spark: SparkSession, d: str) -> DataFrame:
    return _listing(history.recent(fixtures.analyses_log(spark, d), 25))


@query
def history_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _listing(history.lookup(fixtures.analyses_log(spark, d), "evt-321"))


@query
def history_counts(spark: SparkSession, d: str) -> DataFrame:
    return history.headline_counts(fixtures.analyses_log(spark, d))


@query
def history_by_type(spark: SparkSession, d: str) -> DataFrame:
    return history.counts_by_type(fixtures.analyses_log(spark, d))


@query
def history_trend(spark: SparkSession, d: str) -> DataFrame:
    return history.daily_trend(fixtures.analyses_log(spark, d))


def _written_log(spark: SparkSession, d: str, path: str | None = None) -> DataFrame:
    """The log of analyses as it lies on disk: two batches, one of them written twice."""
    log = fixtures.analyses_log(spark, d).withColumn("day", text.utc_day(F.col("created_at")))
    path = path or new_table_path(spark, "log")
    early = F.col("risk_score") < 50
    for rows, batch in ((log.filter(early), "low"), (log.filter(~early), "high"), (log.filter(early), "low")):
        write_log_part(rows, path, batch)
    return read_log(spark, path)


@query
def log_append(spark: SparkSession, d: str) -> DataFrame:
    """Headline counts of a log one of whose batches was run twice."""
    return history.headline_counts(_written_log(spark, d))


@query
def log_clear(spark: SparkSession, d: str) -> DataFrame:
    """Analyses of a written log before it is truncated, after, and after one more batch."""
    path = new_table_path(spark, "log")
    before = _written_log(spark, d, path).count()
    clear_log(spark, path)
    after = read_log(spark, path).count()
    late = fixtures.analyses_log(spark, d).filter("risk_score >= 90").withColumn("day", text.utc_day(F.col("created_at")))
    write_log_part(late, path, "again")
    return spark.createDataFrame([(before, after, read_log(spark, path).count())], "before long, after long, again long")


@query
def log_recent(spark: SparkSession, d: str) -> DataFrame:
    return _listing(history.recent(_written_log(spark, d), 25)).select(*history.LISTING)


@query
def log_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Point read of a written log by id and day."""
    log = _written_log(spark, d)
    day = log.filter(F.col("id") == "evt-321").agg(F.max("day")).first()[0]
    return _listing(history.lookup(log, "evt-321", day)).select(*history.LISTING)


# --- streams ------------------------------------------------------------------------------


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A given table as a stream, be it one file or a folder of files.

    As a pattern the path matches both; a plain path would be taken for a folder.
    """
    schema = fixtures.read(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")


def _run_to_table(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run an aggregate stream in complete mode over all present data; the result table and its state are shared."""
    path = new_table_path(spark, name)
    jobs.table_stream(stream, path, new_table_path(spark, f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    return jobs.latest_table(spark, path, stream.schema)


def _score_stream(spark: SparkSession, prompts: DataFrame) -> DataFrame:
    """A stream of prompts with probabilities scored and appended to a log, read back."""
    when = F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")
    analyses = jobs.scored_stream(prompts, F.col("doc_id"), text.instant_from_utc(when))
    log, checkpoint = new_table_path(spark, "log"), new_table_path(spark, "offsets")
    jobs.append_stream(analyses, log, checkpoint).trigger(availableNow=True).start().awaitTermination()
    return read_log(spark, log).select(
        F.sha2("prompt", 256).alias("prompt_digest"),
        "classification",
        "confidence",
        "risk_score",
        "risk_level",
        "severity",
        joined(F.col("triggered_indicators.rule_id")).alias("rule_ids"),
    )


@query
def stream_score(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a prompt stream, scored and appended to a log, read back."""
    arriving = _stream(spark, d, "documents")
    return _score_stream(
        spark, arriving.select("doc_id", F.expr(fixtures.PLANTED).alias("prompt"), fixtures.probabilities().alias("probabilities"))
    )


@query
def stream_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The main path on a stream: the model's probabilities are computed on the arriving prompts."""
    arriving = _stream(spark, d, "documents").select("doc_id", F.expr(fixtures.PLANTED).alias("prompt"))
    return _score_stream(spark, linear.with_probabilities(arriving, _verdict_model(spark, d), "prompt"))


@query
def stream_trend(spark: SparkSession, d: str) -> DataFrame:
    return _run_to_table(spark, jobs.trend_stream(fixtures.as_log(_stream(spark, d, "events"))), "trend")


@query
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    log = fixtures.as_log(_stream(spark, d, "events"))
    return _run_to_table(spark, jobs.headline_stream(log), "headline")


@query
def stream_class_mix(spark: SparkSession, d: str) -> DataFrame:
    log = fixtures.as_log(_stream(spark, d, "events"))
    return _run_to_table(spark, jobs.class_mix_stream(log), "mix")


TREND_DELAY = "2 days"


@query
def stream_trend_bounded(spark: SparkSession, d: str) -> DataFrame:
    """The daily trend in event time over events that arrive out of order, in update mode with a watermark.

    The events come in twelve shuffled parts. What a closed day refuses is set aside and added in the end, so the sum is
    that of the batch trend however the parts arrive.
    """
    log = fixtures.as_log(fixtures.read(spark, d, "events")).select("created_at", "classification")
    parts, gate, trend = (new_table_path(spark, name) for name in ("parts", "gate", "trend"))
    log.repartition(12, F.xxhash64("created_at")).write.parquet(parts)
    arriving = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(parts)
    jobs.gate_stream(arriving, TREND_DELAY, gate, new_table_path(spark, "gate-offsets")).trigger(availableNow=True).start().awaitTermination()
    counted = jobs.bounded_trend_stream(jobs.on_time_rows(spark, gate, log.schema), TREND_DELAY)
    writer = jobs.table_stream(counted, trend, new_table_path(spark, "trend-state"), "update")
    writer.trigger(availableNow=True).start().awaitTermination()
    in_time = jobs.latest_rows(spark, trend, counted.schema, ["day"])
    late = history.daily_trend(jobs.late_rows(spark, gate, log.schema))
    return in_time.unionByName(late).groupBy("day").agg(F.sum("count").alias("count"), F.sum("threats").alias("threats"))
