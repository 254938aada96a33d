"""Rolling average per account and the composite risk score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from riskloom import fixed_values as fixed
from riskloom.functions.scoring import risk_score
from riskloom.plans.lineage import materialise
from riskloom.plans.skew import HOT_ROWS, hot_keys

ORPHAN_CELLS = 4_096


def enrich(tx: DataFrame, account_rows: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Raw transactions plus ``rolling_avg_amount`` and ``risk_score``.

    ``account_rows(account_id, rows)`` may be given where the counts are known; they may
    be too high but not too low.
    """
    return rolling_average(tx, account_rows, hot_rows).withColumn("risk_score", risk_score())


def rolling_average(tx: DataFrame, account_rows: DataFrame | None = None, hot_rows: int = HOT_ROWS,
                    rows: int = fixed.ROLLING_ROWS) -> DataFrame:
    """Mean amount of the last ``rows`` transactions of the account, this one included.

    Order is time, then transaction id. The mean comes from differences of exact decimal
    running totals, so each row costs the same whatever the frame. Accounts above
    ``hot_rows`` are cut into slices by time and id, each preceded by copies of the last
    rows before it; then no task has to sort a whole hot account, even if all its rows have
    one timestamp. Rows without an account get no average and are spread instead of
    meeting in one task.
    """
    if hot_rows < rows:
        raise ValueError("hot_rows must be at least the window length")
    if account_rows is None:
        account_rows = tx.groupBy("account_id").agg(F.count("*").alias("rows"))
    orphan_cell = F.pmod(F.xxhash64("transaction_id"), F.lit(ORPHAN_CELLS)).cast("int")
    hot = hot_keys(account_rows, "account_id", hot_rows)
    if hot is None:
        sliced = tx.withColumn("_slice", F.when(F.col("account_id").isNull(), orphan_cell).otherwise(0))
    else:
        sliced = _with_halo(tx, hot, max(rows - 1, 1), orphan_cell)
    out = _averaged(sliced, ["account_id", "_slice"], rows)
    if hot is not None:
        out = out.where(~F.col("_halo"))
    return out.select(*tx.columns, "rolling_avg_amount")


def _averaged(base: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Adds ``rolling_avg_amount`` from differences of running totals of the amount, per ``keys`` in time order.

    Amounts of the table's own type are summed as they are, so no copy of them is shuffled.
    """
    if base.schema["amount"].dataType == T.DecimalType(18, 2):
        money = "amount"
    else:
        base, money = base.withColumn("_money", F.col("amount").try_cast("decimal(18,2)")), "_money"
    order = Window.partitionBy(*keys).orderBy("timestamp", "transaction_id")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    totals = base.withColumn("_sum", F.sum(money).over(running)).withColumn("_n", F.count(money).over(running))
    zero = F.lit(0).cast(T.DecimalType(28, 2))
    total = F.coalesce("_sum", zero) - F.coalesce(F.lag("_sum", rows).over(order), zero)
    count = F.col("_n") - F.coalesce(F.lag("_n", rows).over(order), F.lit(0))
    out = totals.withColumn("_total", total).withColumn("_count", count)
    mean = F.when(F.col("account_id").isNotNull() & (F.col("_count") > 0),
                  F.col("_total").cast("double") / F.col("_count"))
    return out.withColumn("rolling_avg_amount", mean)


def enrich_bucketed(stored: DataFrame, hot_rows: int = HOT_ROWS, rows: int = fixed.ROLLING_ROWS) -> DataFrame:
    """``enrich`` for a table of ``write_by_account``: no exchange, as every account lies in one bucket.

    Accounts are counted without an exchange as well. Those above ``hot_rows`` alone are shuffled and cut
    into slices; the rest stays in its buckets.
    """
    tx = stored.drop("account_bucket")
    counts = stored.groupBy("account_bucket").agg(F.count("*").alias("rows")).withColumnRenamed("account_bucket", "account_id")
    hot = hot_keys(counts, "account_id", hot_rows)
    kept = stored
    if hot is not None:
        few = F.broadcast(hot.select(F.col("account_id").alias("account_bucket")))  # bounded by MAX_HOT_KEYS
        kept = stored.join(few, "account_bucket", "left_anti")
    out = _averaged(kept, ["account_bucket", "account_id"], rows).select(
        *tx.columns, "rolling_avg_amount")
    if hot is not None:
        large = stored.join(few, "account_bucket", "left_semi").drop("account_bucket")
        out = out.unionByName(rolling_average(large, hot.select("account_id", "rows"), hot_rows, rows))
    return out.withColumn("risk_score", risk_score())


def _range_parts(rows: int, slices: int, shuffled: int) -> int:
    """Range partitions for hot rows: as many as a shuffle has or ``HOT_ROWS`` asks for, and no more than slices."""
    return max(1, min(slices, max(shuffled, -(-rows // HOT_ROWS))))


def _with_halo(base: DataFrame, hot: DataFrame, halo: int, orphan_cell: Column) -> DataFrame:
    """``base`` with ``_slice``, each slice of a hot account preceded by the last rows before it.

    Rows of hot accounts are range-partitioned by account, time and id, a total order that
    splits any account. Each partition is ranked, cut into slices as long as a part of ``hot``, and stored;
    slices are numbered in that order. So partitions grow with the rows, not with the number of slices.
    """
    keys = ["account_id", "timestamp", "transaction_id"]
    rows, slices = (int(n or 1) for n in hot.agg(F.sum("rows"), F.sum("parts")).first())
    parts = _range_parts(rows, slices, int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    few = hot.select("account_id").withColumn("_hot", F.lit(True))  # bounded by MAX_HOT_KEYS
    marked = base.join(F.broadcast(few), "account_id", "left")
    cold = marked.where(F.col("_hot").isNull()).withColumn(
        "_slice", F.when(F.col("account_id").isNull(), orphan_cell).otherwise(0).cast("bigint"))
    ranged = marked.where(F.col("_hot")).drop("_hot").repartitionByRange(parts, *keys).withColumn(
        "_part", F.spark_partition_id().cast("bigint"))
    # Rows of equal keys have one rank, so no cut divides them.
    place = (F.rank().over(Window.partitionBy("_part").orderBy(*keys)) - 1).cast("bigint")
    placed = materialise(ranged.withColumn("_place", place).withColumn("_slice", F.shiftleft("_part", 33) + (
        F.col("_place") - F.col("_place") % -(-rows // slices))).drop("_part", "_place"), "slices")
    from_end = Window.partitionBy("account_id", "_slice").orderBy(F.desc("timestamp"), F.desc("transaction_id"))
    # At most ``halo`` rows of each slice are numbered through; slices number a few per part.
    tails = placed.select(*keys, "amount", "_slice").withColumn("_back", F.row_number().over(from_end)).where(
        F.col("_back") <= halo)
    in_time = Window.partitionBy("account_id").orderBy("_slice", F.desc("_back"))
    tails = materialise(tails.withColumn("_rank", F.row_number().over(in_time)), "tails")
    before = tails.groupBy("account_id", F.col("_slice").alias("_next")).agg((F.min("_rank") - 1).alias("_before")).where(
        "_before > 0").withColumn("_group", F.floor(F.col("_before") / halo))
    # A row belongs to the slices that begin at most ``halo`` ranks after it.
    group = F.explode(F.array(F.floor(F.col("_rank") / halo), F.floor(F.col("_rank") / halo) + 1))
    copies = tails.withColumn("_group", group).join(before, ["account_id", "_group"]).where(
        (F.col("_before") >= F.col("_rank")) & (F.col("_before") < F.col("_rank") + halo))
    haloes = copies.select(*keys, "amount", F.col("_next").alias("_slice"), F.lit(True).alias("_halo"))
    main = cold.drop("_hot").unionByName(placed).withColumn("_halo", F.lit(False))
    return main.unionByName(haloes, allowMissingColumns=True)
