"""Linear classification of documents.

A model that executors can hold scores rows where they are (`with_margins`). `joined_scores`
gives the same numbers from long-form tables by joins, for a model of any size.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrays import bound
from ..functions.terms import KnownTerms, slices, unpacked, word_points
from ..functions.text import fold_accents
from .tfidf import MAX_LOCAL_TERMS, LocalVocabulary, document_terms, total

# Ship the Arrow function by value: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOP_FEATURES = 30
MAX_LOCAL_NUMBERS = 20_000_000  # terms x classes of a model that executors hold


def softmax(margins: Column) -> Column:
    """Softmax of an array<double>, shifted by its maximum."""
    powers = bound(margins, lambda m: F.transform(m, lambda x: F.exp(x - F.array_max(m))))
    return bound(powers, lambda p: F.transform(p, lambda x: x / total(p)))


def class_coefficients(coefficients: DataFrame, classes) -> DataFrame:
    """(term, label, coefficient) rows to one row per term with an array in class order."""
    columns = [
        F.coalesce(F.max(F.when(F.col("label") == name, F.col("coefficient"))), F.lit(0.0))
        for name in classes
    ]
    return coefficients.groupBy("term").agg(F.array(*columns).alias("coefs"))


def _score_rows(scored: DataFrame, classes, key: str) -> DataFrame:
    labels = F.array(*[F.lit(name) for name in classes])
    return scored.select(
        key,
        F.inline(F.arrays_zip(labels.alias("label"), "margins", "probabilities")).alias(
            "label", "margin", "probability"
        ),
    )


def joined_scores(
    documents: DataFrame,
    vocabulary: DataFrame,
    coefficients: DataFrame,
    intercepts: dict[str, float],
    key: str,
    text_col: str = "text",
) -> DataFrame:
    """Class probabilities per document: (key, label, margin, probability).

    margin = (sum of raw weight x coefficient) / norm + intercept, so one pass over the
    terms yields both the norm and all class sums: fixed-size sums that combine map-side.
    Documents without known terms get the intercepts alone. Classes are the intercept keys.
    """
    classes = sorted(intercepts)
    model = vocabulary.select("term", "idf").join(class_coefficients(coefficients, classes), "term")
    found = document_terms(documents, key, text_col, keep_empty=True)
    terms = found.join(model, "term", "left")
    weight = (F.log(F.col("tf").cast("double")) + 1.0) * F.col("idf")
    weighted = terms.select(key, weight.alias("w"), "coefs")
    sums = weighted.groupBy(key).agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
        *[F.sum(F.col("w") * F.get("coefs", F.lit(i))).alias(f"dot{i}") for i in range(len(classes))],
    )
    margins = F.array(
        *[
            F.coalesce(F.when(F.col("norm") > 0, F.col(f"dot{i}") / F.col("norm")), F.lit(0.0))
            + F.lit(float(intercepts[name]))
            for i, name in enumerate(classes)
        ]
    )
    staged = sums.select(key, margins.alias("margins"))
    return _score_rows(staged.select(key, "margins", softmax(F.col("margins")).alias("probabilities")), classes, key)


class LinearTextModel:
    """A fitted model small enough for every executor: vocabulary x classes numbers."""

    def __init__(self, terms: list[str], idf: np.ndarray, coefs: np.ndarray, intercepts: np.ndarray, classes):
        self.vocabulary = LocalVocabulary(list(terms), np.asarray(idf, dtype=float))
        self.coefs = np.asarray(coefs, dtype=float)  # terms x classes
        self.intercepts = np.asarray(intercepts, dtype=float)
        self.classes = tuple(classes)
        if self.coefs.size > MAX_LOCAL_NUMBERS:
            raise ValueError(f"a model of {self.coefs.size} numbers is too large to be held; use joined_scores")


def local_model(vocabulary: DataFrame, coefficients: DataFrame, biases: dict[str, float]) -> LinearTextModel:
    """Gather a fitted model on the driver: at most max_features terms x classes."""
    classes = sorted(biases)
    wide = vocabulary.join(
        coefficients.groupBy("term").pivot("label", classes).agg(F.first("coefficient")), "term"
    )
    pdf = wide.limit(MAX_LOCAL_TERMS + 1).toPandas().sort_values("term_id")
    return LinearTextModel(
        pdf["term"].tolist(),
        pdf["idf"].to_numpy(),
        pdf[classes].to_numpy(),
        np.array([biases[c] for c in classes]),
        classes,
    )


def _margin_function(model: LinearTextModel, points: bytes):
    """Arrow function from folded texts to their margins; it holds no more than a slice of texts at a time."""
    known = KnownTerms(model.vocabulary.terms)
    idf, coefs, intercepts = model.vocabulary.idf, model.coefs, model.intercepts

    def margins(texts: pa.Array) -> pa.Array:
        inside, found = unpacked(points), []
        for some in slices(texts):
            owner, term, count = known.counts(some, inside)
            raw = (np.log(count) + 1.0) * idf[term]
            norm = np.sqrt(np.bincount(owner, raw * raw, len(some)))
            of_class = [np.bincount(owner, raw * coefs[term, i], len(some)) for i in range(len(intercepts))]
            found.append(np.stack(of_class, 1) / np.where(norm > 0, norm, 1.0)[:, None] + intercepts)
        flat = np.concatenate(found) if found else np.empty((0, len(intercepts)))
        offsets = np.arange(len(texts) + 1, dtype=np.int32) * len(intercepts)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))

    margins.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(margins, "array<double>")


def with_margins(rows: DataFrame, model: LinearTextModel, text_col: str, out: str = "margins") -> DataFrame:
    """Add the class margins of every row's text as an array in class order.

    margin = (sum of raw weight x coefficient) / norm + intercept, for batches and streams: no join and no shuffle. Texts
    are folded in the JVM; their terms are found and added up by an Arrow function over slices of texts.
    """
    function = _margin_function(model, word_points(rows.sparkSession))
    return rows.withColumn(out, function(fold_accents(F.coalesce(F.col(text_col), F.lit("")))))


def with_probabilities(rows: DataFrame, model: LinearTextModel, text_col: str, out: str = "probabilities") -> DataFrame:
    """Add a label->probability map; row-local, so it also serves streams."""
    scored = with_margins(rows, model, text_col, "_m_margins").withColumn("_m_softmax", softmax(F.col("_m_margins")))
    names = F.array(*[F.lit(name) for name in model.classes])
    return scored.withColumn(out, F.map_from_arrays(names, F.col("_m_softmax"))).drop("_m_margins", "_m_softmax")


def linear_scores(documents: DataFrame, model: LinearTextModel, key: str, text_col: str = "text") -> DataFrame:
    """Class scores per document in long form: (key, label, margin, probability)."""
    scored = with_margins(documents.select(key, text_col), model, text_col)
    scored = scored.select(key, "margins", softmax(F.col("margins")).alias("probabilities"))
    return _score_rows(scored, model.classes, key)


def top_features(coefficients: DataFrame, n: int = TOP_FEATURES) -> DataFrame:
    """The n strongest terms of every class with their rank.

    Spark keeps only n rows per class and task before the shuffle (window group limit).
    """
    by_class = Window.partitionBy("label").orderBy(F.col("coefficient").desc(), F.col("term"))
    ranked = coefficients.withColumn("rank", F.row_number().over(by_class)).filter(F.col("rank") <= n)
    return ranked.select("label", "rank", F.col("term").alias("feature"), "coefficient")
