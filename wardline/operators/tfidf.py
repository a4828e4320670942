"""TF-IDF over word unigrams and bigrams.

A document's terms are counted inside its own row, so term statistics need one shuffle, on the
term, with map-side combining. Vectors are row-local too: a vocabulary held by every executor
turns a row's terms into its weights, without a shuffle by document (`with_vectors`). The join
form (`joined_weights`) gives the same numbers for a vocabulary too large to be held.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import terms as numbered
from ..functions.arrays import bound, inline_rows
from ..functions.text import fold_accents, with_bigrams, word_tokens
from ..session import materialize

MIN_DOCUMENTS = 2
MAX_DOCUMENT_SHARE = 0.995
MAX_FEATURES = 60_000
MAX_LOCAL_TERMS = 2_000_000  # a vocabulary beyond this size takes the join form
_VECTOR = "_tfidf_"  # prefix of working columns


def _run_lengths(terms: Column) -> Column:
    """Sorted terms to (term, tf) pairs."""
    last = F.size(terms) - 1
    starts = F.filter(
        F.sequence(F.lit(0), last),
        lambda i: (i == 0) | (F.get(terms, i) != F.get(terms, i - 1)),
    )
    return F.when(last >= 0, starts).otherwise(F.array().cast("array<int>"))


def document_terms(
    documents: DataFrame, key: str, text_col: str = "text", keep_empty: bool = False
) -> DataFrame:
    """One row per (document, term) with its frequency ``tf``; narrow.

    With ``keep_empty`` a document without terms gets one row with a null term.
    """
    folded = documents.select(F.col(key), fold_accents(F.col(text_col)).alias("folded"))
    tokens = folded.select(key, word_tokens(F.col("folded")).alias("tokens"))
    terms = tokens.select(key, F.sort_array(with_bigrams(F.col("tokens"))).alias("terms"))
    starts = terms.select(key, "terms", _run_lengths(F.col("terms")).alias("starts"))
    counted = F.transform(
        F.col("starts"),
        lambda start, i: F.struct(
            F.get(F.col("terms"), start).alias("term"),
            (F.coalesce(F.get(F.col("starts"), i + 1), F.size("terms")) - start).alias("tf"),
        ),
    )
    pairs = starts.select(key, counted.alias("pairs"))
    return inline_rows(pairs, "pairs", ["term", "tf"], [key], keep_empty)


def term_stats(doc_terms: DataFrame) -> DataFrame:
    """Document frequency and corpus frequency of every term."""
    return doc_terms.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("tf")
    )


def corpus_size(doc_terms_source: DataFrame) -> Column:
    return doc_terms_source.agg(F.count(F.lit(1))).scalar()


def smooth_idf(documents: Column, df: Column) -> Column:
    return F.log((documents + 1) / (df + 1)) + 1.0


def _reaching(stats: DataFrame, n: int, counted: Column | None = None) -> DataFrame:
    """The rows of a frequency tf that at least n of them reach, and little more than those.

    A plain top-n over many partitions sends n rows of each to one task. A histogram over the logarithm of tf (some
    hundred buckets) finds the frequency first. Only rows that are ``counted`` make up the n.
    """
    scaled = stats.withColumn("_scale", F.floor(F.log2(F.col("tf").cast("double")) * 16))
    histogram = (scaled if counted is None else scaled.filter(counted)).groupBy("_scale").agg(F.count(F.lit(1)).alias("terms"))
    from_top = Window.orderBy(F.col("_scale").desc())  # over the histogram only
    reached = histogram.withColumn("_reached", F.sum("terms").over(from_top)).filter(F.col("_reached") >= n)
    cut = reached.agg(F.max("_scale")).scalar()
    return scaled.filter(F.col("_scale") >= F.coalesce(cut, F.lit(-1))).drop("_scale")


def _top_terms(stats: DataFrame, n: int) -> DataFrame:
    return stats.orderBy(F.col("tf").desc(), F.col("term")).limit(n)


def _most_frequent(stats: DataFrame, n: int) -> DataFrame:
    """The n terms of highest tf, ties by term."""
    return _top_terms(_reaching(stats, n), n)


def fit_vocabulary(
    documents: DataFrame,
    key: str,
    text_col: str = "text",
    *,
    min_df: int = MIN_DOCUMENTS,
    max_df: float = MAX_DOCUMENT_SHARE,
    max_features: int = MAX_FEATURES,
) -> DataFrame:
    """The vocabulary: term, term_id (alphabetical from 0), df, tf, idf.

    Terms outside the document-frequency bounds go first, then the most frequent
    ``max_features`` stay; equal frequencies at the cut keep the alphabetically first.
    Frequencies are counted by hash; a second pass finds the terms of the frequent hashes only, and should two of
    them share a hash, all is counted by term.
    """
    n_docs = corpus_size(documents)
    # Texts are folded once for both passes, and the counts are merged once for the histogram and the cut.
    folded = materialize(documents.select(fold_accents(F.col(text_col)).alias("folded")), "vocabulary-texts")
    below = F.col("df") <= n_docs * F.lit(max_df)

    def frequent(counts: DataFrame) -> DataFrame:
        hashed = materialize(counts.filter(F.col("df") >= min_df), "vocabulary-hashes")
        return materialize(_reaching(hashed, max_features, below).withColumn("_below", below), "vocabulary-candidates")

    candidates = frequent(_sliced_counts(folded))
    # The candidates are counted before every task gets their hashes; more of them are met by a join, under hashes of its own.
    if candidates.count() <= MAX_LOCAL_TERMS:
        named = _sliced_terms(folded, candidates)
    else:
        candidates = frequent(_hash_counts(folded))
        named = _candidate_terms(folded, candidates)
    if named is None:
        stats = term_stats(document_terms(documents, key, text_col))
        bounded = stats.filter((F.col("df") >= min_df) & below)
        kept = _most_frequent(bounded, max_features)
    else:
        # A candidate has one term, so the counts of its hash are those of the term.
        rows = candidates.filter("_below").join(named, "_hash").select("term", "df", "tf")
        kept = _top_terms(rows, max_features)
    return number_terms(kept.withColumn("idf", smooth_idf(n_docs, F.col("df"))))


def _sliced_counts(folded: DataFrame) -> DataFrame:
    """`_hash_counts` under other hashes: a task adds up some texts at a time, so fewer rows are grouped."""
    counted = folded.mapInArrow(numbered.counter(numbered.word_points(folded.sparkSession)), numbered.COUNTED)
    return counted.groupBy("_hash").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def _sliced_terms(folded: DataFrame, candidates: DataFrame) -> DataFrame | None:
    """`_candidate_terms` by the hashes of `_sliced_counts`, for candidates that every task can hold."""
    wanted = np.sort(candidates.select("_hash").toPandas()["_hash"].to_numpy(dtype=np.int64))
    met = folded.mapInArrow(numbered.namer(numbered.word_points(folded.sparkSession), wanted), numbered.NAMED)
    return _named_once(met, len(wanted))


def _named_once(met: DataFrame, n: int) -> DataFrame | None:
    """The distinct rows of hash and term, written; None unless there are n, one for every candidate."""
    named = materialize(met.distinct(), "vocabulary-terms")
    return named if named.count() == n else None


def _token_hashes(tokens: Column) -> tuple[Column, Callable[[Column], Column]]:
    """A 64-bit hash of every token, and what makes of these the hashes of `with_bigrams` in its order."""

    def all_terms(hashes: Column) -> Column:
        n = F.greatest(F.size(hashes) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
        return F.concat(hashes, pairs)

    return F.transform(tokens, lambda token: F.xxhash64(token)), all_terms


def _hashed_stats(documents: DataFrame, text_col: str) -> DataFrame:
    """`term_stats` by the 64-bit hash of a term: a group is a number."""
    return _sliced_counts(documents.select(fold_accents(F.col(text_col)).alias("folded")))


def _hash_counts(folded: DataFrame) -> DataFrame:
    """Counts by hash over folded texts.

    A document's hashes are sorted, so one that differs from the hash before it is the document's first of its kind.
    """
    tokens = folded.select(word_tokens(F.col("folded")).alias("tokens"))
    hashes, all_terms = _token_hashes(F.col("tokens"))
    hashed = tokens.select(hashes.alias("hashes")).select(F.sort_array(all_terms(F.col("hashes"))).alias("hashes"))
    before = F.concat(F.array(F.lit(None).cast("long")), F.slice("hashes", F.lit(1), F.greatest(F.size("hashes") - 1, F.lit(0))))
    zipped = hashed.select(F.arrays_zip(F.col("hashes").alias("_hash"), before.alias("_before")).alias("cells"))
    rows = inline_rows(zipped, "cells", ["_hash", "_before"], [])
    return rows.groupBy("_hash").agg(
        F.count_if(F.col("_before").isNull() | (F.col("_before") != F.col("_hash"))).alias("df"),
        F.count(F.lit(1)).alias("tf"),
    )


def _candidate_terms(folded: DataFrame, candidates: DataFrame) -> DataFrame | None:
    """The term of every candidate hash: (_hash, term), written. None if two terms share a candidate's hash."""
    tokens = folded.select(word_tokens(F.col("folded")).alias("tokens"))
    hashes, all_terms = _token_hashes(F.col("tokens"))
    staged = tokens.select("tokens", hashes.alias("hashes"))
    zipped = staged.select(
        F.arrays_zip(with_bigrams(F.col("tokens")).alias("term"), all_terms(F.col("hashes")).alias("_hash")).alias("cells")
    )
    rows = inline_rows(zipped, "cells", ["term", "_hash"], [])
    met = rows.join(candidates.select("_hash"), "_hash", "left_semi")
    return _named_once(met.select("_hash", "term"), candidates.count())


def number_terms(kept: DataFrame) -> DataFrame:
    """Add ``term_id``, the alphabetical position of every term from 0; terms are distinct.

    Range partitions hold the terms in order; a term's position in its partition plus the sizes of the partitions before
    is its number. The partitions are written first, so that both parts speak of the same ones; only their sizes, a row a
    partition, are summed up in one place.
    """
    runs = kept.repartitionByRange("term").sortWithinPartitions("term")
    # Spark's increasing ids carry the partition in the upper bits and count within it in the lower 33.
    runs = runs.withColumn("_id", F.monotonically_increasing_id())
    runs = materialize(
        runs.withColumns({"_run": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id"),
        "vocabulary-runs",
    )
    sizes = runs.groupBy("_run").agg(F.count(F.lit(1)).alias("_terms"))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)  # over the partitions' sizes only
    offsets = sizes.select("_run", F.coalesce(F.sum("_terms").over(before), F.lit(0)).alias("_offset"))
    numbered = runs.join(F.broadcast(offsets), "_run")  # a row a partition
    return numbered.select("term", (F.col("_offset") + F.col("_place")).cast("int").alias("term_id"), "df", "tf", "idf")


def raw_weights(doc_terms: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """Sublinear tf times idf for the terms in the vocabulary; unknown terms drop out.

    How the vocabulary is joined is left to the optimizer, which knows the size of a written one.
    """
    looked_up = doc_terms.join(vocabulary.select("term", "term_id", "idf"), "term")
    weight = (F.log(F.col("tf").cast("double")) + 1.0) * F.col("idf")
    return looked_up.select(key, "term", "term_id", weight.alias("raw_weight"))


def document_vectors(weighted: DataFrame, key: str) -> DataFrame:
    """One row per document: term ids and unit-length weights as parallel arrays."""
    gathered = weighted.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("term_id", "raw_weight"))).alias("entries"),
        F.sqrt(F.sum(F.col("raw_weight") * F.col("raw_weight"))).alias("norm"),
    )
    return gathered.select(
        key,
        F.col("entries.term_id").alias("indices"),
        F.transform(F.col("entries.raw_weight"), lambda w: w / F.col("norm")).alias("values"),
        "norm",
    )


def joined_weights(documents: DataFrame, vocabulary: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """L2-normalised weights in long form by joins: (key, term_id, weight)."""
    weighted = raw_weights(document_terms(documents, key, text_col), vocabulary, key)
    vectors = document_vectors(weighted, key)
    zipped = vectors.select(
        key, F.arrays_zip(F.col("indices").alias("term_id"), F.col("values").alias("weight")).alias("cells")
    )
    return inline_rows(zipped, "cells", ["term_id", "weight"], [key])


@dataclass(frozen=True)
class LocalVocabulary:
    """A vocabulary small enough for every executor: terms in ``term_id`` order and their idf."""

    terms: list[str]
    idf: np.ndarray

    def __post_init__(self):
        if len(self.terms) > MAX_LOCAL_TERMS:
            raise ValueError(f"a vocabulary of {len(self.terms)} terms is too large to be held; use joined_weights")


def local_vocabulary(vocabulary: DataFrame) -> LocalVocabulary:
    """Gather a fitted vocabulary: at most its max_features rows."""
    rows = vocabulary.select("term_id", "term", "idf").limit(MAX_LOCAL_TERMS + 1).toPandas().sort_values("term_id")
    return LocalVocabulary(rows["term"].tolist(), rows["idf"].to_numpy(dtype=float))


def _count_model(rows: DataFrame, terms: list[str]) -> CountVectorizerModel:
    """`CountVectorizerModel.from_vocabulary`, which sends the JVM one term a call, by one call.

    An empty vocabulary is no model; a blank is no term of any text, and no term has a line break.
    """
    split = rows.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile("\n").split
    return CountVectorizerModel._create_from_java_class(
        "org.apache.spark.ml.feature.CountVectorizerModel", split("\n".join(terms or [" "]))
    )


def with_term_counts(rows: DataFrame, terms: list[str], text_col: str, out: str) -> DataFrame:
    """Add the sparse vector of known terms' counts; narrow, batch or stream."""
    listed = rows.withColumn(f"{_VECTOR}folded", fold_accents(F.coalesce(F.col(text_col), F.lit(""))))
    listed = listed.withColumn(f"{_VECTOR}words", word_tokens(F.col(f"{_VECTOR}folded")))
    listed = listed.withColumn(f"{_VECTOR}terms", with_bigrams(F.col(f"{_VECTOR}words")))
    counter = _count_model(listed, terms).setInputCol(f"{_VECTOR}terms").setOutputCol(out)
    return counter.transform(listed).drop(f"{_VECTOR}folded", f"{_VECTOR}words", f"{_VECTOR}terms")


def scaled_values(rows: DataFrame, vector_col: str, scaling: dict[str, np.ndarray]) -> DataFrame:
    """Add, for every name, the vector's values times the scaling at their indices, in index order.

    A vector keeps an entry whose scaling is zero, so all arrays of a row are parallel.
    """
    for name, factors in scaling.items():
        scaling_vector = Vectors.dense(factors if len(factors) else [0.0])
        product = ElementwiseProduct(scalingVec=scaling_vector, inputCol=vector_col, outputCol=f"{name}_vector")
        rows = product.transform(rows)
    arrays = {name: F.unwrap_udt(F.col(f"{name}_vector"))["values"] for name in scaling}
    return rows.withColumns(arrays).drop(*[f"{name}_vector" for name in scaling])


def sublinear_factors(counts: Column) -> Column:
    """What makes a count's product with anything that of 1 + ln(count)."""
    return F.transform(counts, lambda tf: (F.log(tf) + 1.0) / tf)


def products(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a * b)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def with_vectors(rows: DataFrame, vocabulary: LocalVocabulary, text_col: str = "text") -> DataFrame:
    """Add ``indices`` and ``weights`` (parallel, unit length) and ``norm`` of every row's text.

    Row-local from end to end, so it serves batches and streams. A null, empty or unknown text
    has empty arrays and norm 0.
    """
    counted = with_term_counts(rows, vocabulary.terms, text_col, f"{_VECTOR}counts")
    counted = scaled_values(counted, f"{_VECTOR}counts", {f"{_VECTOR}idf": vocabulary.idf})
    found = F.unwrap_udt(F.col(f"{_VECTOR}counts"))
    staged = counted.withColumns(
        {"indices": found["indices"], f"{_VECTOR}raw": products(sublinear_factors(found["values"]), F.col(f"{_VECTOR}idf"))}
    )
    raw = F.col(f"{_VECTOR}raw")
    norm = F.sqrt(total(F.transform(raw, lambda w: w * w)))
    unit = bound(norm, lambda n: F.transform(raw, lambda w: w / n))
    staged = staged.withColumns({"norm": norm, "weights": unit})
    return staged.drop(f"{_VECTOR}counts", f"{_VECTOR}idf", f"{_VECTOR}raw")


def tfidf_weights(documents: DataFrame, vocabulary: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """L2-normalised weights in long form: (key, term_id, weight); no shuffle by document."""
    vectors = with_vectors(documents.select(key, text_col), local_vocabulary(vocabulary), text_col)
    zipped = vectors.select(key, F.arrays_zip(F.col("indices").alias("term_id"), F.col("weights").alias("weight")).alias("cells"))
    return inline_rows(zipped, "cells", ["term_id", "weight"], [key])


def matrix_stats(weighted: DataFrame) -> DataFrame:
    """Nonzero values of the document-term matrix and the terms in use."""
    return weighted.agg(F.count(F.lit(1)).alias("nonzero"), F.count_distinct("term_id").alias("terms_used"))
