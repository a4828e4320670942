"""Saved models: vocabulary, coefficients, the ML model and the training document."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..labels import LABELS
from ..operators.linear import LinearTextModel, local_model, top_features
from ..plans.training import (
    TrainingRun,
    coefficient_table,
    intercepts,
    metadata_row,
    write_evaluation,
)

MODEL_VERSION = "1.0.0"
# What the summary shows when the document lacks a field.
DEFAULT_MODEL = "TF-IDF + Logistic Regression"
DEFAULT_CANDIDATE = "sqrt_balanced"


def save_run(run: TrainingRun, path: str) -> None:
    """Write everything a training run leaves behind below ``path``."""
    spark = run.vocabulary.sparkSession
    coefficients = coefficient_table(run)
    run.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
    coefficients.write.mode("overwrite").parquet(f"{path}/coefficients")
    top_features(coefficients).write.mode("overwrite").parquet(f"{path}/top_features")
    run.selected.model.write().overwrite().save(f"{path}/classifier")
    bundle = spark.createDataFrame(
        [(list(LABELS), run.selected.name, MODEL_VERSION, intercepts(run))],
        "labels array<string>, selected_candidate string, model_version string, intercepts map<string,double>",
    )
    bundle.write.mode("overwrite").json(f"{path}/bundle")
    metadata_row(run, spark).write.mode("overwrite").json(f"{path}/metadata")
    write_evaluation(run, path)


def load_bundle(spark: SparkSession, path: str) -> dict:
    """Labels (the shipped list when absent), candidate, version and intercepts."""
    row = spark.read.schema(
        "labels array<string>, selected_candidate string, model_version string, intercepts map<string,double>"
    ).json(f"{path}/bundle").first()
    return {
        "labels": list(row["labels"] or LABELS),
        "selected_candidate": row["selected_candidate"],
        "model_version": row["model_version"],
        "intercepts": dict(row["intercepts"]),
    }


def load_model(spark: SparkSession, path: str) -> LinearTextModel:
    """The saved model, ready for `linear.with_probabilities`."""
    bundle = load_bundle(spark, path)
    return local_model(
        spark.read.parquet(f"{path}/vocabulary"),
        spark.read.parquet(f"{path}/coefficients"),
        bundle["intercepts"],
    )


def load_classifier(path: str) -> LogisticRegressionModel:
    return LogisticRegressionModel.load(f"{path}/classifier")


def model_summary(spark: SparkSession, path: str) -> DataFrame:
    """One row: model, selected candidate, test metrics and training facts, with defaults."""
    document = spark.read.schema(
        "model string, selected_candidate string, "
        "test_metrics struct<accuracy:double,macro_f1:double,weighted_f1:double,rows:bigint,"
        "per_class:map<string,struct<precision:double,recall:double,f1:double,support:bigint>>,"
        "by_source:map<string,struct<rows:bigint,accuracy:double,macro_f1:double,weighted_f1:double>>>, "
        "training struct<train_rows:bigint,vocabulary_size:bigint,converged:boolean,elapsed_seconds:double>"
    ).json(f"{path}/metadata")
    return document.select(
        F.coalesce("model", F.lit(DEFAULT_MODEL)).alias("model"),
        F.coalesce("selected_candidate", F.lit(DEFAULT_CANDIDATE)).alias("selected_candidate"),
        "test_metrics",
        "training",
    )
