"""Attach per-key facts to rows when one key may own a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HOT_SHARE = 1000  # a key is hot when it owns more than 1/HOT_SHARE of all rows
HOT_FLOOR = 50_000  # ... and at least this many rows, so small inputs take one plain join


def attach_key_facts(
    rows: DataFrame,
    facts: DataFrame,
    key: str,
    spread: Column,
    *,
    copies: str = "copies",
    hot_floor: int = HOT_FLOOR,
) -> DataFrame:
    """Left-join ``facts`` (one row per key, with its row count in ``copies``) to ``rows``.

    Since the counts sum to the row count, fewer than HOT_SHARE keys can be hot: their
    facts are broadcast, a side of proven size. Rows of hot keys then take a spread-out
    join key (``spread``, any near-unique column) that matches nothing, so the shuffled
    join that serves every other key never piles them onto one task.
    """
    names = [c for c in facts.columns if c != key]
    total = rows.agg(F.count(F.lit(1))).scalar()
    is_hot = (F.col(copies) * HOT_SHARE > total) & (F.col(copies) >= hot_floor)
    hot = facts.filter(is_hot).select(
        F.col(key).alias("_hot_key"), F.struct(*names).alias("_hot_facts")
    )
    cold = facts.filter(~is_hot).select(
        F.col(key).alias("_cold_key"), F.struct(*names).alias("_cold_facts")
    )
    flagged = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    routed = flagged.withColumn(
        "_route",
        F.when(F.col("_hot_key").isNull(), F.col(key)).otherwise(
            F.concat(F.lit("hot "), F.xxhash64(spread).cast("string"))
        ),
    )
    joined = routed.join(cold, F.col("_route") == F.col("_cold_key"), "left")
    found = F.coalesce(F.col("_hot_facts"), F.col("_cold_facts"))
    return joined.select(*[F.col(c) for c in rows.columns], *[found[n].alias(n) for n in names])
