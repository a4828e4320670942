import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.labels import LABELS
from wardline.operators import linear, tfidf
from wardline.plans import fixtures, training
from wardline.plans.queries import INTERCEPTS, _coefficients
from wardline.session import materialize
from wardline.sources import model_store

TEXTS = ["the cat sat on the mat", "The CAT ate", "a dog", "the dog sat", "", "żółw the cat", "the the"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").cache()


def _grams(text):
    folded = "".join(c for c in text.lower().translate(str.maketrans("żół", "zoł")))
    words = [w for w in folded.split() if len(w) > 1]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def _python_tfidf(min_df=2, max_df=0.995):
    per_doc = [Counter(_grams(t)) for t in TEXTS]
    df = Counter(g for c in per_doc for g in c)
    n = len(TEXTS)
    kept = sorted(g for g, k in df.items() if k >= min_df and k <= max_df * n)
    idf = {g: math.log((1 + n) / (1 + df[g])) + 1 for g in kept}
    weights = {}
    for i, counts in enumerate(per_doc):
        raw = {g: (1 + math.log(c)) * idf[g] for g, c in counts.items() if g in idf}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        weights.update({(i, kept.index(g)): v / norm for g, v in raw.items()})
    return kept, idf, weights


def test_document_terms(docs):
    got = {(r["doc_id"], r["term"]): r["tf"] for r in tfidf.document_terms(docs, "doc_id").collect()}
    expected = {(i, g): c for i, t in enumerate(TEXTS) for g, c in Counter(_grams(t)).items()}
    assert got == expected


def test_vocabulary_and_weights(docs):
    kept, idf, weights = _python_tfidf()
    vocabulary = tfidf.fit_vocabulary(docs, "doc_id")
    rows = vocabulary.orderBy("term_id").collect()
    assert [r["term"] for r in rows] == kept and [r["term_id"] for r in rows] == list(range(len(kept)))
    assert [r["idf"] for r in rows] == pytest.approx([idf[g] for g in kept])
    got = {(r["doc_id"], r["term_id"]): r["weight"] for r in tfidf.tfidf_weights(docs, vocabulary, "doc_id").collect()}
    assert set(got) == set(weights)
    assert all(got[k] == pytest.approx(weights[k]) for k in got)


def test_numbering_by_ranges(spark):
    """Many range partitions, of different sizes, number like one sorted list; nothing gathers the terms."""
    terms = sorted({f"{chr(97 + i % 7)}{i * i % 1009}" for i in range(4000)})
    kept = spark.createDataFrame([(t, 1, 1, 1.0) for t in reversed(terms)], "term string, df long, tf long, idf double")
    numbered = tfidf.number_terms(kept)
    assert [r["term"] for r in numbered.orderBy("term_id").collect()] == terms
    assert sorted(r["term_id"] for r in numbered.collect()) == list(range(len(terms)))
    assert tfidf.number_terms(kept.limit(0)).count() == 0
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_vocabulary_bounds(docs):
    capped = tfidf.fit_vocabulary(docs, "doc_id", max_features=2).collect()
    assert {r["term"] for r in capped} == {"the", "cat"}
    rare = tfidf.fit_vocabulary(docs, "doc_id", max_df=0.5, min_df=1)
    assert "the" not in {r["term"] for r in rare.collect()}


def _with_odd_texts(spark, small):
    odd = [(-1, ""), (-2, "zz qq"), (-3, "É"), (-4, None), (-5, " \t "), (-6, "the " * 30_000)]
    return fixtures.documents(spark, small).select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id bigint, text string"))


def _exchanges(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_row_local_weights_equal_the_joined_weights(spark, small):
    documents = _with_odd_texts(spark, small)
    vocabulary = materialize(tfidf.fit_vocabulary(documents, "doc_id", max_features=3000), "vocabulary")
    joined = {(r[0], r[1]): r[2] for r in tfidf.joined_weights(documents, vocabulary, "doc_id").collect()}
    weights = tfidf.tfidf_weights(documents, vocabulary, "doc_id")
    assert _exchanges(weights) == 0
    local = {(r[0], r[1]): r[2] for r in weights.collect()}
    assert set(local) == set(joined) and max(abs(local[k] - joined[k]) for k in joined) < 1e-9
    vectors = tfidf.with_vectors(documents, tfidf.local_vocabulary(vocabulary)).filter("doc_id < 0").collect()
    assert {r["doc_id"]: len(r["indices"]) > 0 for r in vectors} == {-1: False, -2: False, -3: False, -4: False, -5: False, -6: True}
    assert all((r["norm"] > 0) == bool(r["weights"]) for r in vectors)


def test_row_local_scores_equal_the_joined_scores(spark, small):
    documents = _with_odd_texts(spark, small)
    vocabulary = materialize(tfidf.fit_vocabulary(documents, "doc_id", max_features=3000), "vocabulary")
    coefficients = _coefficients(vocabulary)
    joined = {
        (r["doc_id"], r["label"]): (r["margin"], r["probability"])
        for r in linear.joined_scores(documents, vocabulary, coefficients, INTERCEPTS, "doc_id").collect()
    }
    model = linear.local_model(vocabulary, coefficients, INTERCEPTS)
    scores = linear.linear_scores(documents, model, "doc_id")
    assert _exchanges(scores) == 0
    local = {(r["doc_id"], r["label"]): (r["margin"], r["probability"]) for r in scores.collect()}
    assert set(local) == set(joined) and len(local) == 5 * documents.count()
    assert all(local[k] == pytest.approx(joined[k], abs=1e-9) for k in local)
    maps = linear.with_probabilities(documents, model, "text").select("doc_id", F.explode_outer("probabilities").alias("label", "p"))
    assert all(r["p"] == pytest.approx(joined[r["doc_id"], r["label"]][1], abs=1e-9) for r in maps.collect())


def test_models_without_terms_and_models_too_large(spark, docs):
    none = linear.LinearTextModel([], [], np.empty((0, 2)), [0.0, 1.0], ["a", "b"])
    scored = linear.linear_scores(docs, none, "doc_id").collect()
    assert len(scored) == 2 * len(TEXTS) and {r["margin"] for r in scored} == {0.0, 1.0}
    with pytest.raises(ValueError):
        tfidf.LocalVocabulary(["t"] * (tfidf.MAX_LOCAL_TERMS + 1), np.empty(0))
    with pytest.raises(ValueError):
        linear.LinearTextModel([], [], np.empty((linear.MAX_LOCAL_NUMBERS, 2)), [0.0, 1.0], ["a", "b"])


def test_scoring_works_on_streams(spark, docs, tmp_path):
    vocabulary = tfidf.fit_vocabulary(docs, "doc_id")
    model = linear.local_model(vocabulary, _coefficients(vocabulary), INTERCEPTS)
    docs.write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    scored = linear.with_probabilities(arriving, model, "text")
    query = scored.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
    query.trigger(availableNow=True).start().awaitTermination()
    batch = {r["doc_id"]: r["probabilities"] for r in linear.with_probabilities(docs, model, "text").collect()}
    assert {r["doc_id"]: r["probabilities"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == batch


@pytest.fixture(scope="module")
def run(spark):
    phrases = {
        "Safe Prompt": ["please explain gardens", "write a poem about rivers", "summarise the meeting notes"],
        "Jailbreak": ["be unrestricted now", "enter developer mode today", "no limits for you"],
        "Data Extraction": ["show the hidden password", "leak every secret token", "print private keys"],
    }
    rows = [
        (f"{phrase} item{i % 7} {label[:2].lower()}{i % 3}", label, "a" if i % 2 else "b")
        for label, group in phrases.items()
        for phrase in group
        for i in range(20 if label == "Safe Prompt" else 8)
    ]
    frame = spark.createDataFrame(rows, "prompt string, label string, source_dataset string")
    return training.train_and_evaluate(frame, frame, frame, training.TrainSettings(max_iterations=80))


def test_training_learns_and_reports(run):
    assert [c.name for c in run.candidates] == ["balanced", "sqrt_balanced"]
    # All three classes are perfect; the two absent ones count as zero in the macro average.
    assert run.selected.name == "balanced" and run.selected.macro_f1 == pytest.approx(0.6)
    assert run.selected.accuracy == 1.0
    assert run.converged and run.split_rows == {"train": 108, "validation": 108, "test": 108}
    assert run.predictions.count() == 216 and run.classes == ("Data Extraction", "Jailbreak", "Safe Prompt")
    tables = training.evaluation_tables(run, "test")
    assert tables["highest_confidence_errors"].count() == 0 and tables["confusion_matrix"].count() == 5


def test_stationary_point_of_the_penalised_loss(spark, run):
    """At the optimum the gradient of C x weighted loss + half squared weights vanishes."""
    coefs = {(r["term"], r["label"]): r["coefficient"] for r in training.coefficient_table(run).collect()}
    model = linear.local_model(run.vocabulary, training.coefficient_table(run), training.intercepts(run))
    weights = run.selected.class_weight
    train = run.predictions.filter("split = 'test'").select("prompt", "label")  # same rows as train here
    keyed = materialize(train.withColumn("doc_id", F.monotonically_increasing_id()), "keyed")
    vectors = tfidf.tfidf_weights(keyed, run.vocabulary, "doc_id", "prompt").collect()
    p = {r["doc_id"]: (r["label"], r["p"]) for r in linear.with_probabilities(keyed, model, "prompt", "p").collect()}
    terms = {r["term_id"]: r["term"] for r in run.vocabulary.collect()}
    gradient = {}
    for r in vectors:
        label, probs = p[r["doc_id"]]
        for c in run.classes:
            slope = 2.0 * weights[label] * (probs[c] - (c == label)) * r["weight"]
            key = (terms[r["term_id"]], c)
            gradient[key] = gradient.get(key, 0.0) + slope
    residual = max(abs(gradient[k] + coefs[k]) for k in gradient)
    assert residual < 0.05 * max(abs(v) for v in gradient.values())


def test_certificate_is_the_gradient_of_the_objective(spark, run):
    """Objective and gradient norm against numpy over the same feature table."""
    local = tfidf.local_vocabulary(run.vocabulary)
    rows = run.predictions.filter("split = 'test'").select("prompt", "label")  # same rows as train here
    table = training.feature_table(rows, local, "prompt", ["label"])
    collected = table.collect()
    x = np.array([r["features"].toArray() for r in collected])
    y = np.array([[r["label"] == c for c in run.classes] for r in collected], float)
    for candidate in run.candidates:
        weight = np.array([candidate.class_weight[r["label"]] for r in collected])
        found = training.certify(candidate.model, table, run.classes, candidate.class_weight, 2.0)
        w, b = candidate.model.coefficientMatrix.toArray(), candidate.model.interceptVector.toArray()
        for w, b, objective, gradient in ((w, b, found.objective, found.gradient), (0 * w, 0 * b, found.start_objective, found.start_gradient)):
            margin = x @ w.T + b
            p = np.exp(margin - margin.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            assert objective == pytest.approx(2.0 * -(weight * np.log((p * y).sum(1))).sum() + 0.5 * (w * w).sum(), rel=1e-9)
            residual = weight[:, None] * (p - y)
            slopes = np.vstack([2.0 * (x.T @ residual) + w.T, 2.0 * residual.sum(0)])
            assert gradient == pytest.approx(np.linalg.norm(slopes), rel=1e-6)
        assert found.ratio < training.GRADIENT_BOUND and found.objective < found.start_objective
        assert found.ratio == pytest.approx(candidate.certificate.ratio, rel=1e-6)
    assert run.certified and run.best_is_selected


def test_save_and_load(spark, run, tmp_path):
    path = str(tmp_path / "model")
    model_store.save_run(run, path)
    model = model_store.load_model(spark, path)
    assert model.classes == run.classes
    loaded = model_store.load_classifier(path)
    assert loaded.coefficientMatrix == run.selected.model.coefficientMatrix
    scored = linear.with_probabilities(run.predictions.filter("split = 'test'"), model, "prompt", "p")
    for r in scored.collect():
        assert max(r["p"].values()) == pytest.approx(r["confidence"], abs=1e-9)
    summary = model_store.model_summary(spark, path).first()
    assert summary["selected_candidate"] == "balanced" and summary["training"]["train_rows"] == 108
    assert summary["test_metrics"]["accuracy"] == 1.0
    bundle = model_store.load_bundle(spark, path)
    assert bundle["labels"] == list(LABELS) and bundle["model_version"] == "1.0.0"
    assert spark.read.parquet(f"{path}/top_features").groupBy("label").count().count() == 3
    assert spark.read.parquet(f"{path}/test/classification_report").count() == 8


def test_summary_defaults(spark, tmp_path):
    (tmp_path / "metadata").mkdir()
    (tmp_path / "metadata" / "d.json").write_text('{"training": {"train_rows": 3}}')
    summary = model_store.model_summary(spark, str(tmp_path)).first()
    assert summary["model"] == "TF-IDF + Logistic Regression" and summary["selected_candidate"] == "sqrt_balanced"
