"""Hot keys: finding them and joining around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT_ROWS = 5_000_000
MAX_HOT_KEYS = 100_000


def hot_keys(counts: DataFrame, key: str, hot_rows: int = HOT_ROWS, rows: str = "rows") -> DataFrame | None:
    """Keys of ``counts(key, rows)`` above the limit, or None when there are none.

    ``n / limit`` bounds the number of such keys; the limit grows with the table so that
    it stays below ``MAX_HOT_KEYS``, which makes the result safe to broadcast.
    """
    total, largest = counts.where(F.col(key).isNotNull()).agg(F.sum(rows), F.max(rows)).first()
    limit = max(hot_rows, (total or 0) // MAX_HOT_KEYS)
    if largest is None or largest <= limit:
        return None
    return counts.where(F.col(key).isNotNull() & (F.col(rows) > limit)).select(
        key, F.col(rows), F.ceil(F.col(rows) / limit).alias("parts")
    )


def lookup(facts: DataFrame, dim: DataFrame, key: str, hot: DataFrame | None = None,
           how: str = "left", spread: list[str] | None = None) -> DataFrame:
    """Equi-join many ``facts`` to a ``dim`` that is unique in ``key``.

    Rows of a hot key are spread over ``parts`` sub-keys, and its single dimension row is
    repeated as often, so no task gets more than about one limit's worth of rows.
    """
    if hot is None:
        return facts.join(dim, key, how)
    parts = F.broadcast(hot.select(key, "parts"))
    spread = spread or [c for c in facts.columns if c != key]
    cell = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(
        F.pmod(F.xxhash64(*spread), F.col("parts")).cast("int"))
    copies = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), (F.col("parts") - 1).cast("int")))
    left = facts.join(parts, key, "left").withColumn("_cell", cell).drop("parts")
    right = dim.join(parts, key, "left").withColumn("_cell", F.explode(copies)).drop("parts")
    return left.join(right, [key, "_cell"], how).drop("_cell")
