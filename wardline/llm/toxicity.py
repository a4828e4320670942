"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams, skip-grams and word beginnings.

Fit: a bounded sample of the labelled rows (``sample_rows``) is dealt over shards of at most ``shard_rows`` rows, every
shard runs FTRL over its rows, and the sparse weights are averaged by bucket. At most 2 ** bits + 1 numbers reach the
driver, whatever the input. Scoring is a narrow Arrow function with these weights in its closure.

Defined results: a null or empty text has the bias alone as its score; a label row without id or label is ignored; the
highest label of a repeated id counts and the least of its texts is used; without any usable label every score is 0.5.
A null doc_id is not held out. Other columns of the documents are kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .hashed import PREFIXES, Words, bounded_sample, buckets, distinct_rows, ftrl, slices, text_buffers

THRESHOLD = 0.7
L1_ROWS = 400


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0  # or fewer, one for each L1_ROWS rows of a run: few rows cannot push a gradient past more
    l2: float = 0.0
    epochs: int = 8
    sample_rows: int = 40_000  # labelled rows that the fit uses at most
    shard_rows: int = 10_000  # rows that one FTRL run takes


@dataclass(frozen=True)
class Model:
    """Nonzero weights by bucket, and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int

    def dense(self) -> np.ndarray:
        table = np.zeros(1 << self.bits)
        table[self.buckets] = self.weights
        return table


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, toxic, text of the sampled labelled documents that are not held out."""
    usable = F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id"))
    known = labels.filter(usable).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic"))
    sample = bounded_sample(known, F.xxhash64("doc_id"), settings.sample_rows)
    # The sample has a bound, so its ids may be broadcast; only texts of sampled documents are shuffled.
    return (
        documents.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"))
    )


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """documents: doc_id, text; labels: doc_id, toxic (0 or 1)."""
    s = settings
    rows = materialize(training_rows(documents, labels, s), "toxicity-sample")
    shards = max(1, -(-rows.count() // s.shard_rows))
    filled = rows.select(F.lower("text").alias("text"), "toxic", F.xxhash64("doc_id").alias("order"))
    filled = filled.withColumn("shard", F.pmod(F.shiftright("order", 20), F.lit(shards)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("order")
        data, offsets = text_buffers(pa.array(frame["text"], pa.large_string()))
        features: list[np.ndarray] = []
        for first, last in slices(offsets):
            words = Words(data, offsets[first : last + 1], PREFIXES)
            features += distinct_rows(*buckets(words.features(), s.bits), last - first, s.bits)
        l1 = min(s.l1, len(frame) / L1_ROWS)
        weights, bias = ftrl(features, frame["toxic"].to_numpy(), s.bits, s.alpha, s.beta, l1, s.l2, s.epochs)
        kept = np.flatnonzero(weights)
        share = len(frame)
        return pd.DataFrame(
            {
                "bucket": np.append(kept, [-1, -2]),
                "weight": np.append(weights[kept] * share, [bias * share, share]),
            }
        )

    parts = filled.groupBy("shard").applyInPandas(run, "bucket long, weight double")
    merged = parts.groupBy("bucket").agg(F.sum("weight").alias("weight")).toPandas().sort_values("bucket")
    named = dict(zip(merged["bucket"], merged["weight"]))
    total = named.get(-2, 1.0)
    merged = merged[merged["bucket"] >= 0]
    weights = np.round(merged["weight"].to_numpy(float) / total, 9)
    return Model(merged["bucket"].to_numpy(np.int64), weights, round(named.get(-1, 0.0) / total, 9), s.bits)


def score(text: Column, model: Model) -> Column:
    """Probability that a whole text is toxic."""

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        table = model.dense()
        data, offsets = text_buffers(column)
        margins = np.full(len(column), model.bias)
        for first, last in slices(offsets):
            bucket, owner = buckets(Words(data, offsets[first : last + 1], PREFIXES).features(), model.bits)
            used = np.flatnonzero(table[bucket])
            for i, row in enumerate(distinct_rows(bucket[used], owner[used], last - first, model.bits), first):
                margins[i] += table[row].sum()
        return pa.array(1 / (1 + np.exp(-np.clip(margins, -35, 35))))

    return scored(F.lower(text))


def classify(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold, else 0)."""
    scored = documents.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score stays below the threshold, with their columns."""
    return documents.filter(score(F.col("text"), model) < threshold)
