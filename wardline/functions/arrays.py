"""Array elements as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def bound(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function(value)`` with the value computed once, however often the function names it.

    Spark copies a named expression into every place that names it where it merges projections
    or pushes a filter below them, also into lambdas that run for every element of an array.
    """
    return F.get(F.transform(F.array(value), function), F.lit(0))


def inline_rows(
    frame: DataFrame, array_col: str, names: list[str], keep: list[str], keep_empty: bool = False
) -> DataFrame:
    """One row per struct of ``array_col``: the ``keep`` columns, then the struct fields.

    Spark infers a size filter below a plain inline and pushes it under the projection that
    builds the array, which then runs twice. The outer form has no such filter; the row of
    nulls it adds for an empty array goes by the first field, which no element may have null;
    ``keep_empty`` leaves that row in.
    """
    rows = frame.select(*keep, F.inline_outer(array_col).alias(*names))
    return rows if keep_empty else rows.filter(F.col(names[0]).isNotNull())
