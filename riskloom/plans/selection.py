"""Exact quantiles in two readings of the input: a sketch brackets the ranks, and only the brackets are kept and searched."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Row, functions as F

from riskloom.plans.lineage import materialise
from riskloom.sources.versions import counted

CELLS = 4_096
SMALL = 100_000
#: Size of the sketch, and how far, as a share of all rows, a bracket reaches on both sides of its rank. The sketch's error is
#: about a tenth of that; a rank that still lies outside is searched in the whole input.
SKETCH, REACH = 4_096, 0.005


def order_statistics(values: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """The values at zero-based ``ranks`` of the sorted, non-null ``column``.

    Each pass counts equal-width cells of the interval that still holds the rank, so only
    cell counts are shuffled and at most ``CELLS`` of them reach the driver. Every pass
    narrows the interval; the last one sorts at most ``SMALL`` values. Ranks in the same
    interval share its pass.
    """
    number = values.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    span = number.agg(F.min("v"), F.max("v"), F.count("*")).first()

    @functools.cache
    def cells(low: float, high: float) -> list:
        scale = CELLS / (high / 2 - low / 2) / 2
        cell = F.least(F.floor((F.col("v") - low) * scale), F.lit(CELLS - 1))
        counts = number.where(F.col("v").between(low, high)).groupBy(cell.alias("cell")).agg(
            F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("rows"))
        return counts.orderBy("cell").collect()

    def select(rank: int) -> float:
        low, high, rows = span
        while low < high and rows > SMALL:
            for part in cells(low, high):
                if rank < part["rows"]:
                    low, high, rows = part["low"], part["high"], part["rows"]
                    break
                rank -= part["rows"]
        if low == high:
            return low
        inside = number.where(F.col("v").between(low, high))
        return inside.orderBy("v").limit(rank + 1).agg(F.max("v")).first()[0]

    return {rank: select(rank) for rank in ranks}


def measured_quantiles(values: DataFrame, column: str, shares: list[float], *also: Column) -> tuple[Row, list[float | None]]:
    """The aggregates ``also`` and the interpolated quantiles, as in pandas and ``quantile_cont``.

    The input is read twice, however many quantiles are asked for: once for a sketch and the aggregates, and once
    to count what lies below each bracket and to store what lies inside.
    """
    number = values.select("*", F.col(column).cast("double").alias("_v"))
    reach = F.array(*[F.lit(min(max(share + side, 0.0), 1.0)) for share in shares for side in (-REACH, REACH)])
    sketch = F.kll_sketch_agg_double("_v", F.lit(SKETCH))
    known = number.agg(F.count("_v").alias("_rows"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.when(
        F.count("_v") > 0, F.kll_sketch_get_quantile_double(sketch, reach)).alias("_bounds"), *also).first()
    rows = known["_rows"]
    if rows == 0:
        return known, [None] * len(shares)
    bounds = list(zip(known["_bounds"][::2], known["_bounds"][1::2]))
    bounds = [(known["_least"] if s <= REACH else low, known["_most"] if s >= 1 - REACH else high) for s, (low, high) in zip(shares, bounds)]
    inside = functools.reduce(Column.__or__, [F.col("_v").between(low, high) for low, high in bounds])
    seen, below = counted(number.select("_v"), "ranks", *[
        F.count_if(F.col("_v") < low).alias(f"below{i}") for i, (low, _) in enumerate(bounds)])
    kept = materialise(seen.where(inside), "brackets")
    out = []
    for i, (share, (low, high)) in enumerate(zip(shares, bounds)):
        place = share * (rows - 1)
        first, last, before = int(place), min(int(place) + 1, rows - 1), below.get[f"below{i}"]
        own = kept.where(F.col("_v").between(low, high))
        found = {}
        if first >= before and last - before < own.count():
            found = {r + before: v for r, v in order_statistics(own, "_v", sorted({first - before, last - before})).items()}
        else:
            found = order_statistics(number, "_v", sorted({first, last}))
        out.append(found[first] + (found[last] - found[first]) * (place - first))
    return known, out


def quantiles(values: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Interpolated quantiles, as in pandas and ``quantile_cont``."""
    return measured_quantiles(values, column, shares)[1]
