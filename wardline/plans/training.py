"""Train and evaluate the text classifier: TF-IDF features, multinomial logistic regression."""

from __future__ import annotations

import platform
import time
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators import evaluate, tfidf
from ..session import materialize, new_table_path

CANDIDATES = ("balanced", "sqrt_balanced")
EVALUATED = ("validation", "test")
GRADIENT_BOUND = 0.05  # of the gradient at zero weights; a certified fit is below it
#: MLlib stops at a small relative decrease of the objective, which leaves gradients of a quarter of the first one when
#: the tolerance is taken as it is; with this share of it they fall below GRADIENT_BOUND.
TOLERANCE_SHARE = 0.05


@dataclass(frozen=True)
class TrainSettings:
    c_value: float = 2.0
    max_iterations: int = 450
    tolerance: float = 2e-3
    max_features: int = tfidf.MAX_FEATURES
    min_df: int = tfidf.MIN_DOCUMENTS
    max_df: float = tfidf.MAX_DOCUMENT_SHARE
    weighting: str = "auto"

    def candidates(self) -> tuple[str, ...]:
        return CANDIDATES if self.weighting == "auto" else (self.weighting,)


@dataclass(frozen=True)
class Certificate:
    """How close a fit is to the optimum of its objective, from the data alone."""

    objective: float  # C x weighted loss + half the squared weights
    gradient: float  # its Euclidean norm at the fit
    start_objective: float  # the same at zero weights, where the fit began
    start_gradient: float

    @property
    def ratio(self) -> float:
        return self.gradient / self.start_gradient if self.start_gradient else 0.0


@dataclass
class Candidate:
    name: str
    model: LogisticRegressionModel
    class_weight: dict[str, float]
    iterations: int
    macro_f1: float
    weighted_f1: float
    accuracy: float
    certificate: Certificate


@dataclass
class TrainingRun:
    settings: TrainSettings
    classes: tuple[str, ...]
    vocabulary: DataFrame
    candidates: list[Candidate]
    selected: Candidate
    predictions: DataFrame  # validation and test rows, with split
    split_rows: dict[str, int]
    nonzero: int
    elapsed_seconds: float = 0.0

    @property
    def converged(self) -> bool:
        return self.selected.iterations < self.settings.max_iterations

    @property
    def certified(self) -> bool:
        """Whether every candidate's gradient fell to GRADIENT_BOUND of the one it began with."""
        return all(c.certificate.ratio <= GRADIENT_BOUND for c in self.candidates)

    @property
    def best_is_selected(self) -> bool:
        return (self.selected.macro_f1, self.selected.weighted_f1) == max((c.macro_f1, c.weighted_f1) for c in self.candidates)


def _sparse_struct(size: Column, indices: Column, values: Column) -> Column:
    """The stored form of a sparse ML vector."""
    return F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        size.cast("int").alias("size"),
        F.coalesce(indices, F.array().cast("array<int>")).alias("indices"),
        F.coalesce(values, F.array().cast("array<double>")).alias("values"),
    )


def feature_table(rows: DataFrame, vocabulary: tfidf.LocalVocabulary, text_col: str, keep) -> DataFrame:
    """``keep`` columns plus an ML ``features`` vector for every row, written to the shared folder.

    Vectors are made in the row by built-in functions, as the struct an ML vector is stored as,
    and read back under the vector type: no shuffle, no Python per row, and the iterative fit
    that follows starts from a table instead of a lineage.
    """
    spark = rows.sparkSession
    vectors = tfidf.with_vectors(rows.select(*keep, text_col), vocabulary, text_col)
    width = F.lit(max(1, len(vocabulary.terms)))
    path = new_table_path(spark, "features")
    vectors.select(*keep, _sparse_struct(width, F.col("indices"), F.col("weights")).alias("features")).write.parquet(path)
    fields = [rows.schema[c] for c in keep] + [T.StructField("features", VectorUDT())]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def _by_label(values: dict[str, float]) -> Column:
    result = F.lit(None).cast("double")
    for name, value in values.items():
        result = F.when(F.col("label") == name, F.lit(float(value))).otherwise(result)
    return result


def predict(model: LogisticRegressionModel, features: DataFrame, classes) -> DataFrame:
    """Add prediction, confidence and confidence_margin; ties go to the first class."""
    scored = model.transform(features).withColumn("_p", vector_to_array("probability"))
    confidence, margin = evaluate.confidence_and_margin(F.col("_p"))
    names = F.array(*[F.lit(c) for c in classes])
    best = F.array_position(F.col("_p"), F.array_max("_p")).cast("int") - 1
    return scored.withColumns(
        {"prediction": F.get(names, best), "confidence": confidence, "confidence_margin": margin}
    ).drop("_p", "features", "rawPrediction", "probability")


def _fit(train: DataFrame, classes, weights: dict[str, float], weight_sum: float, s: TrainSettings):
    # Penalty: C times the weighted loss sum, against MLlib's weighted loss mean.
    estimator = LogisticRegression(
        family="multinomial",
        featuresCol="features",
        labelCol="class_index",
        predictionCol="class_prediction",
        weightCol="weight",
        elasticNetParam=0.0,
        regParam=1.0 / (s.c_value * weight_sum),
        standardization=False,
        maxIter=s.max_iterations,
        tol=s.tolerance * TOLERANCE_SHARE,
    )
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")).cast("double") - 1.0
    return estimator.fit(train.select("features", index.alias("class_index"), _by_label(weights).alias("weight")))


def _gradient(scored: DataFrame, classes, weights: dict[str, float]) -> DataFrame:
    """Weighted loss gradient by feature: one row a feature, and one without feature for the intercepts.

    ``scored`` has label, features and ``_p``, an array of class probabilities. Every nonzero value meets its row's
    residuals; the sums combine before the shuffle, so it carries a row a feature and task at most.
    """
    residuals = F.array(
        *[_by_label(weights) * (F.get("_p", F.lit(k)) - (F.col("label") == name).cast("double")) for k, name in enumerate(classes)]
    )
    nonzero = F.unwrap_udt(F.col("features"))
    cells = F.arrays_zip(nonzero["indices"].alias("feature"), nonzero["values"].alias("value"))
    intercept = F.array(F.struct(F.lit(None).cast("int").alias("feature"), F.lit(1.0).alias("value")))
    rows = scored.select(residuals.alias("r"), F.concat(cells, intercept).alias("cells"))
    long = rows.select("r", F.inline_outer("cells").alias("feature", "value"))
    sums = [F.sum(F.col("value") * F.get("r", F.lit(k))).alias(f"g{k}") for k in range(len(classes))]
    return long.groupBy("feature").agg(*sums)


def _loss(scored: DataFrame, classes, weights: dict[str, float]) -> float:
    own = F.get("_p", F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")).cast("int") - 1)
    return scored.agg(F.sum(-_by_label(weights) * F.log(own))).first()[0] or 0.0


def certify(model: LogisticRegressionModel, train: DataFrame, classes, weights: dict[str, float], c_value: float) -> Certificate:
    """Objective and gradient norm of a fit, and of zero weights, over the whole feature table.

    The objective is C x weighted loss + half the squared coefficients; intercepts carry no penalty. The gradient is
    one aggregate over the nonzeros; the coefficients join it as a table of one row a feature.
    """
    spark, names = train.sparkSession, range(len(classes))
    matrix = model.coefficientMatrix.toArray()

    def norm(scored: DataFrame, coefficients: np.ndarray) -> float:
        wide = pd.DataFrame(coefficients.T, columns=[f"w{k}" for k in names])
        wide.insert(0, "feature", np.arange(len(wide), dtype="int32"))
        table = spark.createDataFrame(wide)
        joined = _gradient(scored, classes, weights).join(table, "feature", "full")
        slopes = [c_value * F.coalesce(f"g{k}", F.lit(0.0)) + F.coalesce(f"w{k}", F.lit(0.0)) for k in names]
        return joined.agg(F.sqrt(F.sum(sum(s * s for s in slopes)))).first()[0] or 0.0

    fitted = model.transform(train).withColumn("_p", vector_to_array("probability"))
    # Zero weights say the same of every row: one over the number of classes.
    start = train.withColumn("_p", F.array_repeat(F.lit(1.0 / len(classes)), len(classes)))
    return Certificate(
        c_value * _loss(fitted, classes, weights) + 0.5 * float((matrix * matrix).sum()),
        norm(fitted, matrix),
        c_value * _loss(start, classes, weights),
        norm(start, np.zeros_like(matrix)),
    )


def train_and_evaluate(
    train: DataFrame, validation: DataFrame, test: DataFrame, settings: TrainSettings = TrainSettings()
) -> TrainingRun:
    """Fit the candidates on ``train``, select on ``validation``, predict validation and test.

    Inputs have prompt, label, source_dataset.
    """
    started = time.time()
    splits = {"train": train, "validation": validation, "test": test}
    tagged = reduce(
        DataFrame.unionByName,
        [
            frame.select("prompt", "label", "source_dataset").withColumn("split", F.lit(name))
            for name, frame in splits.items()
        ],
    )
    rows = materialize(tagged.withColumn("row_id", F.monotonically_increasing_id()), "corpus")
    train_rows = rows.filter("split = 'train'")

    vocabulary = materialize(
        tfidf.fit_vocabulary(
            train_rows,
            "row_id",
            "prompt",
            min_df=settings.min_df,
            max_df=settings.max_df,
            max_features=settings.max_features,
        ),
        "vocabulary",
    )
    local = tfidf.local_vocabulary(vocabulary)
    features = feature_table(rows, local, "prompt", ["row_id", "label", "source_dataset", "split"])
    train_features = features.filter("split = 'train'")
    nonzero = train_features.agg(
        F.coalesce(F.sum(F.size(F.unwrap_udt("features")["indices"])), F.lit(0))
    ).first()[0]

    stats = {r["label"]: r for r in evaluate.class_weights(train_rows).collect()}  # one row per class
    classes = tuple(sorted(stats))
    def fitted(name: str) -> Candidate:
        weights = {label: r[name] for label, r in stats.items()}
        weight_sum = sum(r[name] * r["rows"] for r in stats.values())
        model = _fit(train_features, classes, weights, weight_sum, settings)
        held_out = predict(model, features.filter("split = 'validation'"), classes)
        score = evaluate.overall_metrics(evaluate.confusion_counts(held_out)).first()
        return Candidate(
            name,
            model,
            weights,
            model.summary.totalIterations,
            score["macro_f1"],
            score["weighted_f1"],
            score["accuracy"],
            certify(model, train_features, classes, weights, settings.c_value),
        )

    # The candidates are fitted side by side: many small jobs each, which leave executors idle one after another.
    with ThreadPool(len(settings.candidates())) as pool:
        candidates = pool.map(inheritable_thread_target(rows.sparkSession)(fitted), settings.candidates())
    spark = rows.sparkSession
    ranked = spark.createDataFrame(
        [(c.name, i, c.macro_f1, c.weighted_f1) for i, c in enumerate(candidates)],
        "candidate string, candidate_ord int, macro_f1 double, weighted_f1 double",
    )
    best = evaluate.select_candidate(ranked).first()["candidate"]
    selected = next(c for c in candidates if c.name == best)
    predictions = predict(selected.model, features.filter(F.col("split").isin(*EVALUATED)), classes)
    predictions = materialize(
        predictions.join(rows.select("row_id", "prompt"), "row_id").select(
            "prompt", "label", "source_dataset", "split", "prediction", "confidence", "confidence_margin"
        ),
        "predictions",
    )
    counts = {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    return TrainingRun(
        settings, classes, vocabulary, candidates, selected, predictions, counts, nonzero, time.time() - started
    )


def coefficient_table(run: TrainingRun) -> DataFrame:
    """(term, label, coefficient) of the selected model: vocabulary x classes rows."""
    spark = run.vocabulary.sparkSession
    matrix = run.selected.model.coefficientMatrix.toArray()
    wide = pd.DataFrame(matrix.T, columns=[f"c{i}" for i in range(len(run.classes))])
    wide.insert(0, "term_id", np.arange(len(wide), dtype="int32"))
    table = spark.createDataFrame(wide).join(run.vocabulary.select("term", "term_id"), "term_id")
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("label"), F.col(f"c{i}").alias("coefficient"))
            for i, name in enumerate(run.classes)
        ]
    )
    return table.select("term", F.inline(pairs))


def intercepts(run: TrainingRun) -> dict[str, float]:
    return dict(zip(run.classes, (float(v) for v in run.selected.model.interceptVector)))


def evaluation_tables(run: TrainingRun, split: str) -> dict[str, DataFrame]:
    """The five evaluation outputs of one split."""
    return prediction_tables(run.predictions, split)


def prediction_tables(predictions: DataFrame, split: str) -> dict[str, DataFrame]:
    """The same of any predictions (prompt, label, source_dataset, split, prediction, confidence, confidence_margin)."""
    rows = predictions.filter(F.col("split") == split).drop("split")
    return {
        "predictions": evaluate.with_correctness(rows),
        "highest_confidence_errors": evaluate.top_errors(rows),
        "confusion_matrix": evaluate.confusion_matrix(rows),
        "classification_report": evaluate.classification_report(rows),
        "metrics": evaluate.metrics_document(rows),
    }


def write_evaluation(run: TrainingRun, path: str) -> None:
    write_predictions(run.predictions, path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Write the evaluation of both splits, and the labels to review, below ``path``."""
    for split in EVALUATED:
        for name, table in prediction_tables(predictions, split).items():
            table.write.mode("overwrite").parquet(f"{path}/{split}/{name}")
    by_split = {s: predictions.filter(F.col("split") == s).drop("split") for s in EVALUATED}
    evaluate.review_queue(by_split).write.mode("overwrite").parquet(f"{path}/probable_label_issues")


def metadata_row(run: TrainingRun, spark: SparkSession) -> DataFrame:
    """The training document: settings, sizes, convergence, candidate scores, test metrics."""
    train_rows, vocabulary_size = run.split_rows.get("train", 0), run.selected.model.numFeatures
    base = spark.createDataFrame(
        [
            (
                "TF-IDF + Logistic Regression",
                run.selected.name,
                [
                    (c.name, c.class_weight, c.accuracy, c.macro_f1, c.weighted_f1, c.iterations, c.certificate.ratio)
                    for c in run.candidates
                ],
                (
                    train_rows,
                    run.split_rows.get("validation", 0),
                    run.split_rows.get("test", 0),
                    vocabulary_size,
                    [train_rows, vocabulary_size],
                    run.nonzero,
                    run.settings.max_features,
                    run.settings.max_iterations,
                    run.settings.c_value,
                    run.settings.tolerance,
                    "lbfgs",
                    run.converged,
                    round(run.elapsed_seconds, 2),
                ),
                (spark.version, platform.python_version(), platform.platform()),
            )
        ],
        "model string, selected_candidate string, candidate_validation_results array<struct<"
        "candidate:string,class_weight:map<string,double>,accuracy:double,macro_f1:double,"
        "weighted_f1:double,iterations:int,gradient_ratio:double>>, training struct<train_rows:bigint,validation_rows:bigint,"
        "test_rows:bigint,vocabulary_size:bigint,train_matrix_shape:array<bigint>,"
        "train_matrix_nonzero_values:bigint,max_features:int,max_iterations:int,c_value:double,"
        "tolerance:double,solver:string,converged:boolean,elapsed_seconds:double>, "
        "environment struct<spark:string,python:string,platform:string>",
    )
    issues = evaluate.label_issues(run.predictions).agg(F.count(F.lit(1))).scalar()

    def metrics(split: str) -> Column:
        return evaluate.metrics_struct(run.predictions.filter(F.col("split") == split)).scalar()

    return base.withColumns(
        {
            "probable_label_issue_rows": issues,
            "validation_metrics": metrics("validation"),
            "test_metrics": metrics("test"),
        }
    )
