"""Bipartite customer-account graph: edges, nodes, neighbourhoods, selections.

Edges are merged per (customer, account) pair before anything else, so every later step
works on pairs, not on transactions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom import fixed_values as fixed
from riskloom.functions import scoring
from riskloom.plans.lineage import materialise
from riskloom.plans.skew import HOT_ROWS, hot_keys, lookup

#: Neighbours that a search over stored edges names in its filter instead of joining them.
LISTED_NODES = 1000
GRAPH_COLUMNS = [
    "transaction_id", "timestamp", "account_id", "customer_id",
    "amount", "transaction_type", "country", "risk_score",
]


def suspicious(enriched: DataFrame, min_risk: float = fixed.SUSPICIOUS_RISK,
               extra: list[str] | None = None) -> DataFrame:
    """Transactions of at least ``min_risk``, narrowed to the graph's columns."""
    return enriched.where(F.col("risk_score") >= min_risk).select(*GRAPH_COLUMNS, *(extra or []))


def check_bounds(min_risk: float, max_edges: int | None) -> None:
    low, high = fixed.MIN_RISK_RANGE
    if not low <= min_risk <= high:
        raise ValueError(f"min_risk must be between {low} and {high}")
    few, many = fixed.MAX_EDGES_RANGE
    if max_edges is not None and not few <= max_edges <= many:
        raise ValueError(f"max_edges must be between {few} and {many}, or None for all")


def graph_view(enriched: DataFrame, min_risk: float = fixed.SUSPICIOUS_RISK,
               max_edges: int | None = None) -> DataFrame:
    """The transactions behind a graph; with ``max_edges`` only so many, riskiest first, ties by id."""
    check_bounds(min_risk, max_edges)
    chosen = suspicious(enriched, min_risk)
    if max_edges is None:
        return chosen
    return chosen.orderBy(F.desc("risk_score"), "transaction_id").limit(max_edges)


def graph_pull(enriched: DataFrame, rows: int | None = fixed.GRAPH_PULL) -> DataFrame:
    """The cached pull of the graph page: suspicious rows, riskiest first, capped."""
    pulled = suspicious(enriched, extra=["volatility_index"]).orderBy(F.desc("risk_score"), "transaction_id")
    return pulled if rows is None else pulled.limit(rows)


def pairs(tx: DataFrame) -> DataFrame:
    """One row per (customer, account): signed and gross volume, top and summed risk, count.

    Partial aggregation runs before the shuffle, so a hot account costs one row per pair
    and task. Risk is summed in ten-thousandths, so the sum is exact.
    """
    money = F.col("amount").cast("decimal(18,2)")
    points = F.round(F.col("risk_score") * 10_000).cast("bigint")
    return tx.where(F.col("customer_id").isNotNull() & F.col("account_id").isNotNull()).groupBy(
        "customer_id", "account_id"
    ).agg(
        F.sum(money).alias("net"),
        F.sum(F.abs(money)).alias("gross"),
        F.max("risk_score").alias("risk"),
        F.sum(points).alias("risk_points"),
        F.count("risk_score").alias("scored"),
        F.count("*").alias("transactions"),
    )


def edge_table(merged: DataFrame) -> DataFrame:
    """Display edges of merged pairs."""
    weight = F.abs(F.col("net").cast("double"))
    color = F.when(F.col("risk") >= fixed.RISKY_EDGE, fixed.RISKY_EDGE_COLOR).otherwise(fixed.EDGE_COLOR)
    return merged.select(
        F.col("customer_id").alias("from"),
        F.col("account_id").alias("to"),
        weight.alias("weight"),
        (1 + F.log1p(weight) / 2).alias("width"),
        "risk",
        color.alias("color"),
    )


def ends(merged: DataFrame) -> DataFrame:
    """Both ends of each pair, one row per end."""
    sides = F.array(
        F.struct(F.col("customer_id").alias("id"), F.lit("customer").alias("type"), F.col("account_id").alias("other")),
        F.struct(F.col("account_id").alias("id"), F.lit("account").alias("type"), F.col("customer_id").alias("other")),
    )
    return merged.withColumn("_end", F.explode(sides)).select("_end.*", *merged.columns)


def node_degrees(merged: DataFrame) -> DataFrame:
    """Nodes with their type and number of distinct neighbours."""
    return ends(merged).groupBy("id", "type").agg(F.count("*").cast("bigint").alias("degree"))


def node_table(merged: DataFrame, partition: DataFrame, palette: list[str] | None = None) -> DataFrame:
    """Display nodes; a node without a community gets community 0."""
    palette = palette or fixed.COMMUNITY_PALETTE
    community = F.coalesce("community", F.lit(0)).cast("bigint")
    color = F.element_at(
        F.array(*[F.lit(c) for c in palette]), (F.pmod(community, F.lit(len(palette))) + 1).cast("int"))
    size = (fixed.NODE_SIZE_BASE + fixed.NODE_SIZE_PER_DEGREE * F.col("degree")).cast("int")
    return node_degrees(merged).join(partition, "id", "left").select(
        "id", F.col("id").alias("label"), "type", size.alias("size"), color.alias("color"),
        community.alias("community"), "degree")


def node_stats(edges: DataFrame) -> DataFrame:
    """Per node: incident edges, highest risk, total weight. A self-loop counts once."""
    both = F.array_distinct(F.array("from", "to"))
    return edges.withColumn("id", F.explode(both)).groupBy("id").agg(
        F.count("*").alias("edges"),
        F.max("risk").alias("max_risk"),
        F.round(F.sum(F.round(F.col("weight") * 100).cast("decimal(20,0)")).cast("double") / 100, 2)
        .alias("total_weight"),
    )


def links(edges: DataFrame) -> DataFrame:
    """Each edge in both directions as ``id, other``."""
    both = F.array(F.struct(F.col("from").alias("id"), F.col("to").alias("other")),
                   F.struct(F.col("to").alias("id"), F.col("from").alias("other")))
    return edges.select(F.explode(both).alias("l")).select("l.*")


def neighbourhood(edges: DataFrame, seeds: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Nodes one or two links away from any seed, as ``id, distance``; seeds have 0.

    ``seeds`` are the user's selection, so the first hop is a filter, stored as it is small;
    the second joins it to the links, around those of its nodes that are hot.
    """
    step = links(edges)
    chosen = F.col("id").isin(seeds)
    first = materialise(step.where(chosen).select(F.col("other").alias("id")).distinct(), "ring")
    near = step.join(first, "id", "left_semi")
    counts = near.groupBy("id").agg(F.count("*").alias("rows"))
    second = lookup(near, first, "id", hot_keys(counts, "id", hot_rows), "inner", ["other"])
    zero = edges.sparkSession.createDataFrame([(s,) for s in seeds], "id string")
    known = step.select("id").where(chosen).distinct()
    reached = (
        zero.join(known, "id", "left_semi").select("id", F.lit(0).alias("distance"))
        .unionByName(first.select("id", F.lit(1).alias("distance")))
        .unionByName(second.select(F.col("other").alias("id"), F.lit(2).alias("distance")))
    )
    return reached.groupBy("id").agg(F.min("distance").alias("distance"))


def write_adjacency(edges: DataFrame, name: str, buckets: int, path: str | None = None) -> None:
    """Stores both directions of every edge as table ``name(id, other)``, in ``buckets`` by node and sorted in them.

    The rows of a hot node are split over several tasks and files of its bucket.
    """
    writer = links(edges).select("id", "other").hint("rebalance", "id").write.format("parquet").mode("overwrite").bucketBy(
        buckets, "id").sortBy("id", "other")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def neighbourhood_of(adjacency: DataFrame, seeds: list[str], hot_rows: int = HOT_ROWS, listed: int = LISTED_NODES) -> DataFrame:
    """``neighbourhood`` over a table of ``write_adjacency``: reads the buckets of the seeds, then those of their neighbours.

    Up to ``listed`` neighbours are named in the filter, so only their buckets are read; more of them are joined.
    """
    near = adjacency.where(F.col("id").isin(seeds))
    first = materialise(near.select(F.col("other").alias("id")).distinct(), "ring")
    few = first.limit(listed + 1).collect()
    if len(few) <= listed:
        second = adjacency.where(F.col("id").isin([r["id"] for r in few]))
    else:
        met = adjacency.join(first, "id", "left_semi")
        counts = met.groupBy("id").agg(F.count("*").alias("rows"))
        second = lookup(met, first, "id", hot_keys(counts, "id", hot_rows), "inner", ["other"])
    reached = near.select("id", F.lit(0).alias("distance")).unionByName(
        first.select("id", F.lit(1).alias("distance"))).unionByName(
        second.select(F.col("other").alias("id"), F.lit(2).alias("distance")))
    return reached.groupBy("id").agg(F.min("distance").alias("distance"))


def _truthy(column: str) -> Column:
    """A property that is missing, zero, false or empty never matches."""
    c = F.col(column)
    text = c.cast("string")
    return c.isNotNull() & ~text.isin("", "0", "0.0", "false", "NaN")


def select_nodes(nodes: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Ids of nodes whose property is one of ``values``, compared as text."""
    return nodes.where(_truthy(column) & F.col(column).cast("string").isin(values)).select("id")


def select_by_edge(edges: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Both ends of the edges whose property is one of ``values``."""
    match = edges.where(_truthy(column) & F.col(column).cast("string").isin(values))
    return match.select(F.explode(F.array("from", "to")).alias("id")).distinct()


def restrict_nodes(nodes: DataFrame, selected: DataFrame) -> DataFrame:
    """The nodes that stay visible."""
    return nodes.join(selected, "id", "left_semi")


def restrict_edges(edges: DataFrame, selected: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The edges with both ends visible."""
    kept = _attach(edges, selected.select("id").distinct().withColumn("_on", F.lit(1)), "from", hot_rows, "inner")
    kept = _attach(kept.drop("_on"), selected.select("id").distinct().withColumn("_on", F.lit(1)), "to", hot_rows,
                   "inner")
    return kept.select(*edges.columns)


def _hot_ends(edges: DataFrame, end: str, hot_rows: int) -> DataFrame | None:
    return hot_keys(edges.groupBy(end).agg(F.count("*").alias("rows")), end, hot_rows)


def _attach(edges: DataFrame, dim: DataFrame, end: str, hot_rows: int, how: str = "left") -> DataFrame:
    other = "to" if end == "from" else "from"
    return lookup(edges, dim.withColumnRenamed("id", end), end, _hot_ends(edges, end, hot_rows), how, [other])


def cross_ring_edges(edges: DataFrame, partition: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Edges whose ends lie in different communities."""
    part = materialise(partition.select("id", "community"), "partition")  # read once for each end
    by_start, by_end = (_hot_ends(edges, end, hot_rows) for end in ("from", "to"))
    joined = lookup(edges, part.toDF("from", "from_community"), "from", by_start, "inner", ["to"])
    joined = lookup(joined, part.toDF("to", "to_community"), "to", by_end, "inner", ["from"])
    return joined.where(F.col("from_community") != F.col("to_community")).select(
        *edges.columns, "from_community", "to_community")


def ring_members(partition: DataFrame) -> DataFrame:
    """Members per community. One row per member keeps rings of any size whole."""
    return partition.select("community", "id")


def _label(community: str) -> Column:
    return F.concat(F.lit(fixed.RING_LABEL), F.col(community).cast("string"))


def ring_ledger(merged: DataFrame, partition: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Key figures per ring, riskiest first.

    A transaction belongs to the rings of its customer and of its account, once where they
    agree. Sums per pair are enough for volume and mean risk, so transactions are not read
    again.
    """
    part = materialise(partition.select("id", "community"), "partition")  # read for both ends and the sizes
    figures = merged.select("customer_id", "account_id", "gross", "risk_points", "scored")
    by_account = hot_keys(figures.groupBy("account_id").agg(F.count("*").alias("rows")), "account_id", hot_rows)
    by_customer = hot_keys(figures.groupBy("customer_id").agg(F.count("*").alias("rows")), "customer_id", hot_rows)
    joined = lookup(
        figures, part.toDF("customer_id", "_c"), "customer_id", by_customer, "left", ["account_id"])
    joined = lookup(
        joined, part.toDF("account_id", "_a"), "account_id", by_account, "left", ["customer_id"])
    rings = F.array_distinct(F.array_compact(F.array("_c", "_a")))
    volume = (
        joined.withColumn("community", F.explode(rings)).groupBy("community").agg(
            F.sum("gross").cast("double").alias("aggregate_volume"),
            (F.sum("risk_points").cast("double") / (F.sum("scored") * 10_000.0)).alias("vulnerability_risk_rating"),
        )
    )
    size = part.groupBy("community").agg(
        F.count("*").alias("total_nodes"),
        scoring.count_if(F.col("id").startswith(fixed.CUSTOMER_PREFIX)).alias("customer_entities"),
        scoring.count_if(F.col("id").startswith(fixed.ACCOUNT_PREFIX)).alias("associated_bank_accounts"),
    )
    return size.join(volume, "community").select(
        _label("community").alias("community_ring"), "total_nodes", "customer_entities",
        "associated_bank_accounts", "aggregate_volume", "vulnerability_risk_rating",
    ).orderBy(F.desc("vulnerability_risk_rating"), "community_ring")


def single_ring(merged: DataFrame) -> DataFrame:
    """The fallback partition: every node in community 0."""
    return ends(merged).select("id").distinct().withColumn("community", F.lit(0).cast("bigint"))
