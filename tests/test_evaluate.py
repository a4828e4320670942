import pytest
from pyspark.sql import functions as F

from wardline.labels import LABELS
from wardline.operators import evaluate

# Two published confusion matrices (actual by predicted, label order) and their scores.
TEST_MATRIX = [
    [13647, 0, 115, 0, 0],
    [1, 21, 0, 0, 0],
    [129, 0, 2266, 0, 6],
    [1, 0, 1, 14, 0],
    [4, 0, 9, 0, 1610],
]
VALIDATION_MATRIX = [
    [13634, 2, 126, 0, 0],
    [0, 21, 1, 0, 0],
    [131, 1, 2263, 0, 6],
    [2, 0, 0, 13, 1],
    [1, 0, 9, 0, 1613],
]
PUBLISHED = {
    "test": (TEST_MATRIX, 0.985076301615799, 0.9681756058644329, 0.985060629083886),
    "validation": (VALIDATION_MATRIX, 0.9842908438061041, 0.9475505837159168, 0.9842849746609558),
}
TEST_F1 = [0.990923613128086, 0.9767441860465116, 0.9457429048414023, 0.9333333333333333, 0.9941339919728311]


def _counts(spark, matrix):
    cells = [(LABELS[i], LABELS[j], n) for i, row in enumerate(matrix) for j, n in enumerate(row) if n]
    return spark.createDataFrame(cells, "label string, prediction string, n bigint")


def _expanded(spark, matrix):
    return _counts(spark, matrix).select("label", "prediction", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))


@pytest.mark.parametrize("name", PUBLISHED)
def test_published_metrics(spark, name):
    matrix, accuracy, macro, weighted = PUBLISHED[name]
    got = evaluate.overall_metrics(evaluate.confusion_counts(_expanded(spark, matrix))).first()
    assert got["rows"] == 17824
    assert got["accuracy"] == pytest.approx(accuracy, abs=1e-12)
    assert got["macro_f1"] == pytest.approx(macro, abs=1e-12)
    assert got["weighted_f1"] == pytest.approx(weighted, abs=1e-12)


def test_published_class_scores_and_matrix(spark):
    rows = _expanded(spark, TEST_MATRIX)
    scores = {r["label"]: r for r in evaluate.class_metrics(_counts(spark, TEST_MATRIX)).collect()}
    assert [scores[l]["f1"] for l in LABELS] == pytest.approx(TEST_F1, abs=1e-12)
    matrix = evaluate.confusion_matrix(rows).collect()
    assert [list(r[1:]) for r in matrix] == TEST_MATRIX and [r["actual"] for r in matrix] == list(LABELS)


def test_report_layout(spark):
    report = evaluate.classification_report(_expanded(spark, TEST_MATRIX)).collect()
    assert [r["name"] for r in report] == [*LABELS, "accuracy", "macro avg", "weighted avg"]
    assert len(set(report[5][2:])) == 1 and report[6]["support"] == 17824.0
    assert report[6]["precision"] == pytest.approx(0.9868424724831175, abs=1e-12)
    assert report[7]["precision"] == pytest.approx(0.9850565038036676, abs=1e-12)


def test_slices_use_the_labels_present(spark):
    # One slice of the published test set: 13,737 safe rows of which 114 went elsewhere, one lone injection row.
    rows = spark.createDataFrame(
        [("s", "Safe Prompt", "Safe Prompt", 13623), ("s", "Safe Prompt", "Jailbreak", 114), ("s", "Prompt Injection", "Safe Prompt", 1)],
        "source_dataset string, label string, prediction string, n bigint",
    )
    got = evaluate.overall_metrics(rows, ["source_dataset"], present_only=True).first()
    assert got["accuracy"] == pytest.approx(0.9916290580870578, abs=1e-12)
    assert got["macro_f1"] == pytest.approx(0.49789846862322285, abs=1e-12)
    assert got["weighted_f1"] == pytest.approx(0.9957244523914998, abs=1e-12)


def test_missing_classes_are_zero(spark):
    rows = spark.createDataFrame([("Jailbreak", "Safe Prompt")], "label string, prediction string")
    matrix = evaluate.confusion_matrix(rows).collect()
    assert sum(sum(r[1:]) for r in matrix) == 1 and len(matrix) == 5
    scores = evaluate.class_metrics(evaluate.confusion_counts(rows)).collect()
    assert len(scores) == 5 and all(r["f1"] == 0.0 for r in scores)


PREDICTIONS = [
    (1, "Jailbreak", "Safe Prompt", 0.90, 0.8, "a"),
    (2, "Jailbreak", "Safe Prompt", 0.8999, 0.9, "a"),
    (3, "Jailbreak", "Jailbreak", 0.99, 0.9, "a"),
    (4, "Safe Prompt", "Jailbreak", 0.90, 0.85, "b"),
]


def test_errors_and_issues(spark):
    frame = spark.createDataFrame(
        PREDICTIONS, "i int, label string, prediction string, confidence double, confidence_margin double, source_dataset string"
    )
    assert [r["i"] for r in evaluate.top_errors(frame).collect()] == [4, 1, 2]
    assert [r["i"] for r in evaluate.top_errors(frame, 1).collect()] == [4]
    assert {r["i"] for r in evaluate.label_issues(frame).collect()} == {1, 4}  # 0.90 counts
    queue = evaluate.review_queue({"validation": frame.filter("i < 3"), "test": frame.filter("i >= 3")})
    assert sorted((r["i"], r["split"]) for r in queue.collect()) == [(1, "validation"), (4, "test")]
    slices = {(r["slice"], r["metric"]) for r in evaluate.metrics_document(frame).collect()}
    assert ("all", "macro_f1") in slices and ("b", "recall") in slices


def test_candidate_ties_go_to_the_first(spark):
    frame = spark.createDataFrame(
        [("balanced", 0, 0.9, 0.8), ("sqrt_balanced", 1, 0.9, 0.8), ("worse", 2, 0.9, 0.7)],
        "candidate string, candidate_ord int, macro_f1 double, weighted_f1 double",
    )
    assert evaluate.select_candidate(frame).first()["candidate"] == "balanced"


def test_class_weights(spark):
    frame = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "label string")
    got = {r["label"]: r for r in evaluate.class_weights(frame).collect()}
    assert got["a"]["balanced"] == pytest.approx(8 / (2 * 6)) and got["b"]["sqrt_balanced"] == pytest.approx((8 / 4) ** 0.5)


def test_confidence_and_margin(spark):
    p = F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3))
    row = spark.range(1).select(*evaluate.confidence_and_margin(p)).first()
    assert row[0] == 0.5 and row[1] == pytest.approx(0.2)


def test_metrics_struct_holds_the_long_document(spark):
    """Scores of classes and sources in one row equal the long rows of the metrics document."""
    rows = [(LABELS[i % 5], LABELS[(i * i) % 5], "s1" if i % 3 else "s2") for i in range(40)]
    predictions = spark.createDataFrame(rows, "label string, prediction string, source_dataset string")
    found = evaluate.metrics_struct(predictions).first()["metrics"]
    long = {(r.slice, r.label, r.metric): r.value for r in evaluate.metrics_document(predictions).collect()}
    for name in LABELS:
        for metric in ("precision", "recall", "f1", "support"):
            assert abs(found["per_class"][name][metric] - long["all", name, metric]) < 1e-12
    for metric in ("rows", "accuracy", "macro_f1", "weighted_f1"):
        assert abs(found[metric] - long["all", "all", metric]) < 1e-12
        for source in ("s1", "s2"):
            assert abs(found["by_source"][source][metric] - long[source, "all", metric]) < 1e-12


def test_metrics_struct_of_nothing(spark):
    empty = spark.createDataFrame([], "label string, prediction string, source_dataset string")
    assert evaluate.metrics_struct(empty).first()["metrics"]["by_source"] == {}
