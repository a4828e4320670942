"""Analytics over the log of past analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import utc_day
from ..labels import SAFE
from .hybrid import HIGH_AT

DEFAULT_LIMIT = 50
MAX_LIMIT = 200
LISTING = [
    "id", "created_at", "prompt", "classification", "confidence", "risk_score", "risk_level", "severity",
]


def is_safe() -> Column:
    return F.col("classification") == SAFE


def recent(log: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The newest analyses; the limit is held within [1, 200]. Equal instants order by id.

    A log partitioned by ``day`` is read from the youngest days that hold enough rows: their counts come from the
    partition values alone, and a day has a row at least, so ``limit`` days are always enough to look at.
    """
    limit = max(1, min(limit, MAX_LIMIT))
    if "day" in log.columns:
        log = log.filter(F.col("day") >= _oldest_day_needed(log, limit))
    return log.select(*LISTING).orderBy(F.col("created_at").desc(), F.col("id")).limit(limit)


def _oldest_day_needed(log: DataFrame, limit: int) -> Column:
    counts = log.groupBy("day").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.col("day").desc()).limit(limit).collect()
    total, oldest = 0, None
    for row in counts:  # a row a day, `limit` at most
        oldest, total = row["day"], total + row["rows"]
        if total >= limit:
            break
    return F.lit(oldest)


def lookup(log: DataFrame, analysis_id: str, day=None) -> DataFrame:
    """The analysis with this id, or no row; with the day it was made only that partition is read."""
    found = log.filter(F.col("id") == analysis_id)
    return found if day is None else found.filter(F.col("day") == day)


def headline_columns() -> list[Column]:
    """Total, safe, threat and high-risk counts; what is not safe is a threat, an unknown class too."""
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_safe()).alias("safe"),
        (F.count(F.lit(1)) - F.count_if(is_safe())).alias("threats"),
        F.count_if(F.col("risk_score") >= HIGH_AT).alias("high_risk"),
    ]


def headline_counts(log: DataFrame) -> DataFrame:
    """The headline counts in one pass."""
    return log.agg(*headline_columns())


def counts_by_type(log: DataFrame) -> DataFrame:
    return (
        log.groupBy(F.col("classification").alias("label"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), "label")
    )


def daily_trend(log: DataFrame) -> DataFrame:
    """Analyses and threats per UTC day, oldest first."""
    return (
        log.groupBy(utc_day(F.col("created_at")).alias("day"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.coalesce(F.sum(F.when(is_safe(), 0).otherwise(1)), F.lit(0)).alias("threats"),
        )
        .orderBy("day")
    )
