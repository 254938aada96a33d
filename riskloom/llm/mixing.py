"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are dealt to blocks of bounded size by hash, and its blocks are put
in a random order. A source gives whole passes over its blocks and one partial pass, until
its target is met; the last block of the partial pass is filled document by document.

The root of the tree has every source's number of blocks. Each node draws, exactly, how
many blocks of each source its left half of the output shards gets; a block's number in
its source's order then leads it to one shard. Nodes draw with their own seeds, so every
task can walk its blocks down on its own and all agree. Inside a shard rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from riskloom.llm.common import set_aside
from riskloom.plans.lineage import materialise

#: Weights of the sources in the order of their names, repeating (fixed values).
WEIGHTS = (5, 2, 1)
#: No source and no document is taken more often than this (fixed value).
MOST_REPEATS = 3
#: Words of a block, on average, and blocks of an output shard.
BLOCK_WORDS, SHARD_BLOCKS = 65_536, 64
SEED = 1


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST_REPEATS) -> list[float]:
    """Shares of ``total`` by weight; none above ``most`` times its size, the excess reshared by weight."""
    out, active, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while active:
        weight = sum(weights[i] for i in active)
        share = {i: left * weights[i] / weight for i in active}
        over = [i for i in active if share[i] > most * sizes[i]]
        if not over:
            for i in active:
                out[i] = share[i]
            return out
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        active = [i for i in active if i not in set(over)]
    return out


class Tree:
    """The splitting tree; nodes are drawn when they are first visited."""

    def __init__(self, quotas: list[int], shards: int, seed: int = SEED):
        self.quotas, self.shards, self.seed = np.array(quotas, np.int64), shards, seed
        self.total = int(self.quotas.sum())
        self.drawn: dict[tuple[int, int], np.ndarray] = {}

    def _room(self, low: int, high: int) -> int:
        return self.total * high // self.shards - self.total * low // self.shards

    def left(self, low: int, high: int, quotas: np.ndarray) -> np.ndarray:
        """How many blocks of each source go to the left half of shards ``[low, high)``."""
        if (low, high) not in self.drawn:
            rng = np.random.default_rng([self.seed, low, high])
            self.drawn[low, high] = rng.multivariate_hypergeometric(
                quotas, self._room(low, (low + high) // 2), method="marginals")
        return self.drawn[low, high]

    def shard(self, source: int, number: int) -> int:
        """The shard of a source's block with this number."""
        low, high, quotas = 0, self.shards, self.quotas
        while high - low > 1:
            first = self.left(low, high, quotas)
            middle = (low + high) // 2
            if number < first[source]:
                high, quotas = middle, first
            else:
                number -= int(first[source])
                low, quotas = middle, quotas - first
        return low


@dataclass
class Plan:
    """One row per source, per block, and per hash of a document that the partial pass takes from a last block."""

    sources: DataFrame
    blocks: DataFrame
    extra: DataFrame


def keyed(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` with the ``key`` that decides blocks and order; it replaces one of that name."""
    return docs.withColumn("key", F.xxhash64("doc_id", "text"))


def _placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("source", "_source").join(
        sources, F.col("_source").eqNullSafe(F.col("source"))).drop("_source").withColumn(
        "block", F.pmod(F.col("key"), F.col("n_blocks")))


def plan(rows: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> Plan:
    """What to take of ``rows(source, size, key)``. One row per source passes through the driver."""
    spark = rows.sparkSession
    sums = {r["source"]: int(r["n"] or 0) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    names = sorted((s for s in sums if s is not None)) + ([None] if None in sums else [])
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(names))]
    sizes = [sums[s] for s in names]
    goal = targets(sizes, weights, sum(sizes))
    sources = materialise(spark.createDataFrame(
        [(i, s, n, t, min(int(t // n), MOST_REPEATS) if n else 0,
          0.0 if not n or t // n >= MOST_REPEATS else t - t // n * n, max(1, -(-n // block_words)))
         for i, (s, n, t) in enumerate(zip(names, sizes, goal))],
        "sid int, source string, source_size bigint, target double, passes int, rest double, n_blocks bigint"), "sources")

    # Running totals in two steps, so that no window holds all blocks of a large source.
    found = _placed(rows, sources).groupBy("sid", "block").agg(F.sum("size").alias("words"))
    order = F.xxhash64(F.lit(seed), "sid", "block")
    found = materialise(found.withColumn("order", order).withColumn("part", F.shiftrightunsigned("order", 52)), "blocks")
    before = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = found.groupBy("sid", "part").agg(F.sum("words").alias("w"), F.count("*").alias("c")).select(
        "sid", "part", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"),
        F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    inside = Window.partitionBy("sid", "part").orderBy(F.col("order"), "block").rowsBetween(Window.unboundedPreceding, -1)
    numbered = found.join(parts, ["sid", "part"]).join(
        sources.select("sid", "passes", "rest"), "sid").select(
        "sid", "block", "words", "passes", "rest",
        (F.col("w0") + F.coalesce(F.sum("words").over(inside), F.lit(0))).alias("start"),
        (F.col("c0") + F.coalesce(F.count("words").over(inside), F.lit(0))).alias("number"))
    state = (F.when(F.col("start") + F.col("words") <= F.col("rest"), 1)
             .when(F.col("start") < F.col("rest"), 2).otherwise(0))
    numbered = materialise(numbered.withColumn("state", state), "numbered")

    counts = {r["sid"]: (r["n"], r["p"]) for r in numbered.groupBy("sid").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("state") > 0, 1).otherwise(0)).alias("p")).collect()}
    passes = {r["sid"]: r["passes"] for r in sources.select("sid", "passes").collect()}
    whole = [counts.get(i, (0, 0))[0] for i in range(len(names))]
    quotas = [passes[i] * whole[i] + counts.get(i, (0, 0))[1] for i in range(len(names))]
    shards = max(1, round(sum(quotas) / shard_blocks))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = Tree(quotas, shards, seed)
        for batch in batches:
            batch["shards"] = [
                [tree.shard(s, p * whole[s] + n) for p in range(times + (state > 0))]
                for s, n, times, state in zip(batch["sid"], batch["number"], batch["passes"], batch["state"])]
            yield batch[["sid", "block", "passes", "state", "shards"]]

    # Blocks of a source go on in order, so a task visits neighbouring nodes of the tree.
    blocks = materialise(numbered.select("sid", "block", "number", "passes", "state").mapInPandas(
        walk, "sid int, block bigint, passes int, state int, shards array<int>"), "walked")

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        """Takes documents in the order of their keys as long as they fit."""
        left, taken = float(group["room"].iloc[0]), []
        items = group.groupby("key", sort=True)["size"].sum()
        for key, size in items.items():
            if size <= left:
                taken.append(key)
                left -= size
        rest = [(abs(left - size), key) for key, size in items.items() if key not in set(taken)]
        if rest and min(rest)[0] < left:  # one document too many may be nearer than one too few
            taken.append(min(rest)[1])
        return pd.DataFrame({"sid": group["sid"].iloc[0], "block": group["block"].iloc[0], "key": taken}).astype(
            {"sid": "int32", "block": "int64", "key": "int64"})

    last = numbered.where("state = 2").select("sid", "block", (F.col("rest") - F.col("start")).alias("room"))
    extra = _placed(rows, sources).select("sid", "block", "key", "size").join(last, ["sid", "block"]).groupBy(
        "sid", "block").applyInPandas(fill, "sid int, block bigint, key bigint")
    return Plan(sources, blocks, materialise(extra, "extra"))


def apply_plan(rows: DataFrame, made: Plan) -> DataFrame:
    """``rows(source, size, key, ...)`` with ``source_size, target, copies`` and the ``shards`` of the copies.

    Columns of the added names are replaced; all others are kept, whatever their names.
    """
    rows, back = set_aside(rows.drop("source_size", "target", "copies", "shards"), "sid", "block", "passes", "rest", "n_blocks", "state", "_extra")
    placed = _placed(rows, made.sources).drop("passes", "rest", "n_blocks")
    extra = made.extra.distinct().withColumn("_extra", F.lit(True))
    # The block table goes on the right; what it lacks are blocks without a document.
    joined = placed.join(made.blocks, ["sid", "block"]).join(extra, ["sid", "block", "key"], "left")
    partial = F.when(F.col("state") == 1, 1).when((F.col("state") == 2) & F.col("_extra"), 1).otherwise(0)
    out = joined.withColumn("copies", (F.col("passes") + partial).cast("int"))
    return out.withColumn("shards", F.slice("shards", 1, F.col("copies"))).drop(
        "sid", "block", "passes", "state", "_extra").withColumnsRenamed(back)


def listing(taken: DataFrame, seed: int = SEED) -> DataFrame:
    """A row per copy of ``apply_plan``'s rows with its ``shard`` and ``position``, shuffled inside the shard."""
    each = taken.select("*", F.posexplode("shards").alias("copy", "shard"))
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "key", "copy"), "key", "copy")
    return each.withColumn("position", F.row_number().over(order)).drop("shards")
