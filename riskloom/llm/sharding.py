"""Sharding by extendible hashing: a directory of hash prefixes whose oversized buckets split.

A bucket is the rows whose hashes begin with the same bits. The empty prefix is the first
bucket; a bucket above the limit splits on its next bit, and only then, so a shard is the
shortest prefix whose rows fit. Splits are found from sums per prefix, several bits at a
time; no row moves until its shard is known.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.llm.common import set_aside
from riskloom.plans.lineage import materialise
from riskloom.plans.numbering import running_total

#: Bytes of text of a shard.
LIMIT = 1 << 20
#: Bits of the hash, and bits that one pass over the unresolved rows looks ahead.
BITS, STEP = 60, 6


def hash_bits(column: str) -> Column:
    """The first 60 bits of the MD5 of the value as text; a null counts as an empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


ADDED = ("shard", "depth", "shard_bytes", "shard_rows")
#: Names of columns that come and go on the way.
WORKING = ("cell", "rows", "prefix", "_most", "_row", "_before", "_number", "_b0", "_n0", "_part", "_value", "_total", "_offset", "_inside")


def _prefix(hashes: Column, depth: int) -> Column:
    return F.shiftright(hashes, BITS - depth)


def _name(depth: Column, prefix: Column) -> Column:
    return F.when(depth == 0, "").otherwise(F.lpad(F.bin(prefix), depth, "0"))


def shards(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``rows(hash, bytes, ...)`` with ``shard``, ``depth``, ``shard_bytes`` and ``shard_rows``.

    ``shard`` has the bits of the prefix; null bytes count as 0. A single row above the
    limit is a shard of its own. Rows that share all bits and still exceed the limit,
    such as a repeated id, are cut by their running total; a number after a dot tells those
    shards apart. Empty input gives no rows. Columns of the added names are replaced; all
    others are kept, whatever their names.
    """
    rows, back = set_aside(rows.drop(*ADDED), *WORKING)
    return _shards(rows, limit).withColumnsRenamed(back)


def _shards(rows: DataFrame, limit: int) -> DataFrame:
    stored = materialise(rows.withColumn("bytes", F.coalesce(F.col("bytes"), F.lit(0)).cast("bigint")), "to_shard")
    total = stored.agg(F.sum("bytes")).first()[0] or 0
    depth = min(BITS, max(1, math.ceil(math.log2(max(total / limit, 1))) + STEP // 2))
    above, left, out = -1, stored, None
    while True:
        cell = _prefix(F.col("hash"), depth)
        cells = left.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
        levels = cells.select("*", F.explode(F.sequence(F.lit(above + 1), F.lit(depth))).alias("depth"))
        prefix = F.expr(f"shiftright(cell, {depth} - depth)")
        buckets = levels.groupBy("depth", prefix.alias("prefix")).agg(
            F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows")).where(
            (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
        shortest = F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("s")
        directory = materialise(
            levels.select("cell", "depth", prefix.alias("prefix")).join(buckets, ["depth", "prefix"]).groupBy("cell").agg(
                shortest).select("cell", "s.*"), "directory")
        placed = left.withColumn("cell", cell).join(directory, "cell").drop("cell")
        named = placed.withColumn("shard", _name(F.col("depth"), F.col("prefix"))).drop("prefix")
        out = named if out is None else out.unionByName(named)
        left = materialise(left.withColumn("cell", cell).join(directory.select("cell"), "cell", "left_anti").drop("cell"), "oversized")
        if left.isEmpty():
            return out
        if depth == BITS:
            return out.unionByName(_cut(left, limit))
        above, depth = depth, min(BITS, depth + STEP)


def _cut(rows: DataFrame, limit: int) -> DataFrame:
    """Shards for rows that no bit separates: each takes rows up to the limit in stored order."""
    largest = rows.groupBy("hash").agg(F.max("bytes").alias("_most"))
    placed = materialise(rows.withColumn("_row", F.monotonically_increasing_id()).join(largest, "hash"), "repeated")
    # With steps of the limit less the largest row no shard can exceed the limit.
    step = F.lit(limit) - F.col("_most")
    counted = running_total(placed, ["hash", "_row"], F.col("bytes"), "_before")
    counted = running_total(counted, ["hash", "_row"], F.lit(1), "_number")
    first = counted.groupBy("hash").agg(F.min("_before").alias("_b0"), F.min("_number").alias("_n0"))
    part = F.when(step > 0, F.floor((F.col("_before") - F.col("_b0")) / step)).otherwise(F.col("_number") - F.col("_n0"))
    cut = materialise(counted.join(first, "hash").withColumn("_part", part), "cut")
    sums = cut.groupBy("hash", "_part").agg(F.sum("bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    name = F.concat(F.lpad(F.bin("hash"), BITS, "0"), F.lit("."), F.col("_part").cast("string"))
    return cut.join(sums, ["hash", "_part"]).withColumns({"shard": name, "depth": F.lit(BITS)}).drop(
        "_row", "_most", "_before", "_number", "_b0", "_n0", "_part")


def write_shards(sharded: DataFrame, folder: str) -> None:
    """One file per shard below ``folder``, without the working columns."""
    files = max(1, sharded.select("shard").distinct().count())
    sharded.drop("hash", "bytes", "depth", "shard_bytes", "shard_rows").repartition(files, "shard").write.partitionBy(
        "shard").parquet(folder)
