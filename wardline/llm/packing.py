"""Packing into optimal length buckets, with token-budget batches inside each bucket.

The global histogram of lengths has a bounded number of cells: exact up to FINE, then 256 to each doubling. With ``to_rows``
the longest row of a cell stands for it, otherwise its upper grid value, which may exceed all rows. Dynamic programming over
the cells finds the bucket boundaries that pad least in total; its cost is exact because a row is padded to a boundary, and
boundaries are cells. Beyond FINE a boundary inside a cell is not considered: a cell is at most 1/256 of its lengths wide. Every bucket is dealt over parts of about ``part_rows`` rows, so that ranks inside
a bucket come from a window over a part plus the counts of the parts before it: a hot bucket is never in one task.

Defined results: a null length counts as 0; rows of length 0 are padded to the least boundary; a row longer than the budget
is a batch of its own; equal rows are told apart only by their place; among equal paddings the earliest boundary wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

FINE = 4096  # lengths up to here are cells of their own
CELL_BITS = 8  # beyond, so many bits after the first tell cells apart
BLANKS = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Settings:
    buckets: int = 16
    batch_tokens: int = 65_536
    part_rows: int = 20_000
    to_rows: bool = False  # boundaries are lengths of rows, not values of the grid


@dataclass(frozen=True)
class Plan:
    """Boundaries in ascending order, the rows of each bucket, and the padding in total."""

    boundaries: list[int]
    counts: list[int]
    padding: int


def word_count(text: Column) -> Column:
    """Words between ASCII blanks; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, BLANKS), lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def cell(length: Column) -> Column:
    """The least length of the grid that is not below ``length``."""
    step = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(length)) - CELL_BITS - 1, F.lit(0)))
    return F.when(length <= FINE, length).otherwise(F.call_function("div", length + step - 1, step) * step)


def best_boundaries(cells: list[tuple[int, int, int]], buckets: int) -> Plan:
    """Boundaries for (length, rows, sum of lengths) cells in ascending order, with at most ``buckets`` buckets.

    A bucket over cells i .. j - 1 pads u[j - 1] * (C[j] - C[i]) - (S[j] - S[i]). For a fixed end this is a line in the
    boundary for every start i, and both slopes and boundaries are sorted; so each layer takes one walk along the lower
    envelope of the lines.
    """
    lengths = [c[0] for c in cells]
    rows, sums = [0], [0]
    for _, count, total in cells:
        rows.append(rows[-1] + count)
        sums.append(sums[-1] + total)
    size = len(cells)
    if not size:
        return Plan([], [], 0)
    none = None
    costs: list[int | None] = [0] + [none] * size
    starts: list[list[int]] = []
    layers = [costs]
    for _ in range(min(buckets, size)):
        before, now, chosen = layers[-1], [none] * (size + 1), [0] * (size + 1)
        hull: list[tuple[int, int, int]] = []  # (slope, intercept, start)
        at = 0
        for j in range(1, size + 1):
            i = j - 1
            if before[i] is not None:
                slope, intercept = -rows[i], before[i] + sums[i]
                while len(hull) - at >= 2 and _useless(hull[-2], hull[-1], slope, intercept):
                    hull.pop()
                hull.append((slope, intercept, i))
            x = lengths[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] < hull[at][0] * x + hull[at][1]:
                at += 1
            if at < len(hull):
                slope, intercept, start = hull[at]
                now[j] = slope * x + intercept + x * rows[j] - sums[j]
                chosen[j] = start
        layers.append(now)
        starts.append(chosen)
    totals = [(layer[size], k) for k, layer in enumerate(layers) if k and layer[size] is not None]
    padding, used = min(totals)
    end, bounds, counts = size, [], []
    for k in range(used, 0, -1):
        start = starts[k - 1][end]
        bounds.append(lengths[end - 1])
        counts.append(rows[end] - rows[start])
        end = start
    return Plan(bounds[::-1], counts[::-1], padding)


def _useless(first: tuple, second: tuple, slope: int, intercept: int) -> bool:
    """Is the second of three lines of falling slope nowhere below both others?"""
    return (second[1] - first[1]) * (first[0] - slope) >= (intercept - first[1]) * (first[0] - second[0])


def plan(lengths: DataFrame, settings: Settings = Settings()) -> Plan:
    """The plan for a column ``length`` of non-negative longs."""
    cells = lengths.groupBy(cell(F.col("length")).alias("cell")).agg(
        F.max("length").alias("longest"), F.count(F.lit(1)).alias("rows"), F.sum("length").alias("total")
    )
    ends = ((r.longest if settings.to_rows else r.cell, r.rows, r.total) for r in cells.collect())
    return best_boundaries(sorted(ends), settings.buckets)


def pack(rows: DataFrame, order: list[str], settings: Settings = Settings()) -> DataFrame:
    """Rows with ``length`` and bucket, padded_length, batch_id and position, which replace columns of these names.

    ``order`` names near-unique columns.
    """
    s = settings
    added = ("length", "bucket", "padded_length", "batch_id", "position")
    kept = [c for c in rows.columns if c not in added]
    length = F.greatest(F.coalesce("length", F.lit(0)).cast("long"), F.lit(0).cast("long"))
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), length.alias("length"), F.xxhash64(*order).alias("_order"))
    rows = materialize(rows, "lengths")
    found = plan(rows, s)
    if not found.boundaries:
        empty = {"bucket": "int", "padded_length": "long", "batch_id": "long", "position": "long"}
        return rows.select("_row.*", "length", *[F.lit(None).cast(kind).alias(c) for c, kind in empty.items()])
    fits = [max(1, s.batch_tokens // max(1, b)) for b in found.boundaries]
    first_batch = [0]
    for count, fit in zip(found.counts, fits):
        first_batch.append(first_batch[-1] - (-count // fit))
    parts = [-(-count // s.part_rows) for count in found.counts]

    def of_bucket(values: list[int]) -> Column:
        return F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.col("bucket"))

    bucket = sum(((F.col("length") > b).cast("int") for b in found.boundaries[:-1]), F.lit(0))
    dealt = rows.withColumn("bucket", bucket)
    dealt = dealt.withColumn("_part", F.pmod("_order", of_bucket(parts)))
    sizes = dealt.groupBy("bucket", "_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("bucket").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("bucket", "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("bucket", "_part").orderBy("_order", *[F.col(f"_row.`{c}`") for c in order if c in kept], "length")
    ranked = dealt.withColumn("_rank", F.row_number().over(inside) - 1).join(sizes, ["bucket", "_part"])
    place = F.col("_rank") + F.col("_before")
    return ranked.select(
        "_row.*",
        "length",
        "bucket",
        of_bucket(found.boundaries).alias("padded_length"),
        (of_bucket(first_batch) + F.floor(place / of_bucket(fits))).alias("batch_id"),
        (place % of_bucket(fits)).alias("position"),
    )
