"""Quality rules and robust multivariate outliers: minimum covariance determinant by language and source. Native only.

Every document gets a vector of four transformed statistics. For each (lang, source) group a minimum-covariance-determinant
estimate is found by concentration steps: centre and covariance of the half of the rows nearest to the previous estimate,
starting from medians; then both are refined from all rows within the usual distance. A row is rejected when its
Mahalanobis distance exceeds ``cutoff``. Steps run for all groups at once over a narrow table of vectors, as partial
aggregates (sums, and quantile summaries of bounded size), so no group is ever gathered.

Defined results: a null or empty text has no words, and base rules fail it; null languages and sources are values of their
own; groups under ``min_group`` rows are judged together by language, and languages under it together; if all together are
fewer than that, nothing is rejected by distance. Every row is judged by itself, repeated ids included.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

WORD = r"[^\x20\x09-\x0D]"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
VECTOR = ("x0", "x1", "x2", "x3")
#: Quantiles of the chi-squared distribution with four degrees of freedom: 0.5, 0.975.
CHI2_HALF, CHI2_REWEIGHT = 3.3567, 11.1433
FEW_GROUPS = 50_000  # tables by group (about 200 bytes a row) are broadcast up to this many rows, by their count


@dataclass(frozen=True)
class Settings:
    min_words: int = 50
    max_repeat_percent: int = 50
    share: float = 0.5  # of a group's rows that the estimate rests on
    steps: int = 3
    cutoff: float = 150.0  # squared distance beyond which a row is rejected
    min_group: int = 100
    accuracy: int = 2000  # of the quantile summaries
    floor: tuple[float, ...] = (0.05, 0.1, 0.05, 0.05)  # least spread of each statistic that counts as spread


def with_statistics(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs) to rows with a text column."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, GAP), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(WORD))
    staged = rows.withColumns({"_words": words, "_lines": lines, "_text": whole})
    windows = F.transform(
        F.when(F.size("_words") >= 3, F.sequence(F.lit(0), F.size("_words") - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
    )
    staged = staged.withColumn("_windows", windows)
    return staged.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0))
            .otherwise(_repeated(F.col("_windows")))
            .cast("long"),
        }
    ).drop("_words", "_lines", "_windows", "_text")


def _repeated(windows: Column) -> Column:
    """How many positions lie in a window of three that occurs more than once: sort by hash, then compare neighbours."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(ordered: Column) -> Column:
        def starts(x: Column, k: Column) -> Column:
            before = F.when(k > 0, F.get(ordered, k - 1)["h"])
            return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False))

        hits = F.transform(F.filter(ordered, starts), lambda x: x["i"])
        return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda i: F.array(i, i + 1, i + 2)))))

    return F.element_at(F.transform(F.array(placed), covered), 1)


def with_vector(rows: DataFrame) -> DataFrame:
    """Adds the transformed statistics x0 .. x3: word length, symbols, repeated lines, repeated words."""
    words = F.greatest("n_words", F.lit(1))
    return rows.withColumns(
        {
            "x0": F.log(F.greatest("word_chars", F.lit(1)) / words),
            "x1": F.log1p(F.lit(20) * F.col("n_symbols") / words),
            "x2": F.sqrt(F.col("n_dup_lines") / words),
            "x3": F.sqrt(F.col("n_repeat_words") / words),
        }
    )


def _group_columns(vectors: DataFrame, min_group: int) -> DataFrame:
    """lang, source, group: where rows of a language and source are judged; null if nowhere."""
    counts = vectors.groupBy("lang", "source").count()
    fine = counts.withColumn("group", F.when(F.col("count") >= min_group, F.to_json(F.struct("lang", "source"))))
    rest = fine.filter("group is null").groupBy("lang").agg(F.sum("count").alias("_of_lang"))
    fine = fine.join(rest.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    own = F.when(F.col("_of_lang") >= min_group, F.to_json(F.struct("lang", F.lit("*").alias("of"))))
    fine = fine.withColumn("group", F.coalesce("group", own))
    left = fine.filter("group is null").agg(F.sum("count").alias("n")).first().n or 0
    if left >= min_group:
        fine = fine.withColumn("group", F.coalesce("group", F.lit("*")))
    return fine.select("lang", "source", "group")


def _estimates(rows: DataFrame, settings: Settings, scale: float = 1.0) -> DataFrame:
    """group, centre and Cholesky factor (columns m0.., c00..) of rows, covariances times ``scale``."""
    pairs = list(combinations_with_replacement(range(len(VECTOR)), 2))
    sums = [F.avg(x).alias(f"m{i}") for i, x in enumerate(VECTOR)]
    sums += [F.avg(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"s{i}{j}") for i, j in pairs]
    found = rows.groupBy("group").agg(*sums)
    for i, j in pairs:
        least = settings.floor[i] ** 2 if i == j else 0.0
        moment = (F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * scale
        found = found.withColumn(f"v{i}{j}", F.round(moment, 9) + least)
    return _with_factor(found)


def _with_factor(found: DataFrame) -> DataFrame:
    """Cholesky factor l_ij (i >= j) of the covariances v_ji, one column after the other."""
    size = len(VECTOR)
    for j in range(size):
        inner = sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        found = found.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"v{j}{j}") - inner, F.lit(1e-9))))
        for i in range(j + 1, size):
            cross = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            found = found.withColumn(f"l{i}{j}", (F.col(f"v{j}{i}") - cross) / F.col(f"l{j}{j}"))
    names = [f"l{i}{j}" for j in range(size) for i in range(j, size)]
    return found.select("group", *[F.round(f"m{i}", 9).alias(f"m{i}") for i in range(size)], *names)


def _sent(by_group: DataFrame, few: bool) -> DataFrame:
    """A table by group as the side of a join: broadcast if there are few groups, so that a hot group stays spread out."""
    return F.broadcast(by_group) if few else by_group


def _distances(vectors: DataFrame, estimates: DataFrame, few: bool) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance from the group's estimate; rows without a group are left out."""
    joined = vectors.join(_sent(estimates, few), "group")
    size = len(VECTOR)
    for i in range(size):
        solved = sum((F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))
        joined = joined.withColumn(f"z{i}", (F.col(VECTOR[i]) - F.col(f"m{i}") - solved) / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, size)), F.col("z0") * F.col("z0"))
    return joined.withColumn("d2", d2).select(*vectors.columns, "d2")


def _start(vectors: DataFrame, settings: Settings) -> DataFrame:
    """Medians as centres and interquartile ranges as spreads, without covariances."""
    quantiles = [F.percentile_approx(x, [0.25, 0.5, 0.75], settings.accuracy).alias(f"q{i}") for i, x in enumerate(VECTOR)]
    found = vectors.filter("group is not null").groupBy("group").agg(*quantiles)
    for i in range(len(VECTOR)):
        spread = (F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349
        found = found.withColumn(f"m{i}", F.col(f"q{i}")[1])
        found = found.withColumn(f"v{i}{i}", spread * spread + settings.floor[i] ** 2)
        for j in range(i + 1, len(VECTOR)):
            found = found.withColumn(f"v{i}{j}", F.lit(0.0))
    return _with_factor(found)


def mcd(vectors: DataFrame, settings: Settings, few: bool) -> DataFrame:
    """Reweighted minimum-covariance-determinant estimates of every group of ``vectors`` (group, x0 .. x3)."""
    estimates = materialize(_start(vectors, settings), "estimates")
    for _ in range(settings.steps):
        far = _distances(vectors, estimates, few)
        edge = far.groupBy("group").agg(F.percentile_approx("d2", settings.share, settings.accuracy).alias("edge"))
        near = far.join(_sent(edge, few), "group").filter("d2 <= edge")
        # The half nearest to the centre understates the covariance by this much if the rows are normal.
        estimates = materialize(_estimates(near, settings, scale=1 / _half_consistency()), "estimates")
    near = _distances(vectors, estimates, few).filter(F.col("d2") <= CHI2_REWEIGHT)
    return materialize(_estimates(near, settings), "estimates")


def _half_consistency() -> float:
    """P(chi2 with 6 degrees <= median of chi2 with 4 degrees) / 0.5, from the closed form for even degrees."""
    from math import exp

    half = CHI2_HALF / 2
    return (1 - exp(-half) * (1 + half + half * half / 2)) / 0.5


def judge(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, the statistics, base_failed, d2 (null without a group) and kept of documents (doc_id, text, lang, source)."""
    s = settings
    rows = with_vector(with_statistics(documents.select("doc_id", "text", "lang", "source")).drop("text"))
    failed = (F.col("n_words") < s.min_words) | (100 * F.col("n_repeat_words") > s.max_repeat_percent * F.col("n_words"))
    rows = materialize(rows.withColumn("base_failed", failed), "statistics")
    groups = materialize(_group_columns(rows.filter(~F.col("base_failed")), s.min_group), "groups")
    few = groups.count() <= FEW_GROUPS
    groups = groups.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "group")
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    placed = rows.join(_sent(groups, few), same, "left").drop("_lang", "_source")
    sound = materialize(placed.filter(~F.col("base_failed")).select("group", *VECTOR), "vectors")
    estimates = mcd(sound, s, few)
    known = _distances(placed.filter(F.col("group").isNotNull()), estimates, few)
    unknown = placed.filter(F.col("group").isNull()).withColumn("d2", F.lit(None).cast("double"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= s.cutoff, F.lit(True))
    return known.unionByName(unknown).withColumn("kept", kept).drop("group", "lang", "source", *VECTOR)
