"""Running totals over a whole table without a one-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from riskloom.plans.lineage import materialise


def numbered(df: DataFrame, order: list, out: str) -> DataFrame:
    """Adds ``out``: the place of each row in ``order``, from 1.

    ``order`` must be total. Rows are range-partitioned, sorted and stored with their place in their partition, and
    are not shuffled again; only one row per partition is summed in a single task.
    """
    at = F.monotonically_increasing_id()  # the partition, and the row's place in it in the lower 33 bits
    placed = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "ranged")
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(
        out, F.col("_offset") + F.col("_at") - F.shiftleft("_part", 33) + 1).drop("_part", "_at", "_offset")


def running_total(df: DataFrame, order: list, value, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows that come before, in ``order``.

    ``order`` must be total. Rows are range-partitioned and stored with their partition
    number, so both passes see the same boundaries; only one row per partition is summed
    in a single task.
    """
    ranged = df.withColumn("_value", value).repartitionByRange(*order)
    placed = materialise(ranged.withColumn("_part", F.spark_partition_id()), "ranged")
    parts = placed.groupBy("_part").agg(F.sum("_value").alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + F.col("_inside"))
        .drop("_part", "_value", "_inside", "_offset")
    )
