"""Maps the TPC-H-like tables to the library's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(scan: DataFrame) -> DataFrame:
    """Spreads a plain file scan that has fewer splits than the cluster has threads.

    For row-wise work that costs far more than reading; large tables are left alone.
    """
    threads = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(threads) if scan.rdd.getNumPartitions() < threads else scan


def _numbered(prefix: str, key: str):
    digits = F.col(key).cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.lit(5), F.length(digits)), F.lit("0")))


def account_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per account, read from one column; lets enrichment look for hot accounts cheaply."""
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy(_numbered("ACC-", "l_suppkey").alias("account_id")).agg(F.count("*").alias("rows"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw transaction per line item; the account is the supplier.

    The order side is narrowed and joined with its small dimensions first, so the line
    items, the only large table, are shuffled once, by order key. The hint keeps them from
    being broadcast where their file looks small.
    """
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    buyer = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    order = order.join(buyer, order.o_custkey == buyer.c_custkey)
    item = table(spark, sf_dir, "lineitem").hint("merge")
    joined = item.join(order, item.l_orderkey == order.o_orderkey)
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    parts = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    parts += [cents, F.col("l_quantity").cast("int")]
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return joined.select(
        F.concat_ws("-", *[p.cast("string") for p in parts]).alias("transaction_id"),
        F.col("l_shipdate").alias("timestamp"),
        _numbered("ACC-", "l_suppkey").alias("account_id"),
        _numbered("CUS-", "o_custkey").alias("customer_id"),
        F.when(F.col("l_returnflag") == "R", -price).otherwise(price).cast("decimal(18,2)").alias("amount"),
        F.col("o_orderpriority").alias("transaction_type"),
        F.col("c_mktsegment").alias("merchant_category"),
        F.col("n_name").alias("country"),
        ((F.col("l_tax") >= 0.08) & (F.col("l_linenumber") >= 6)).cast("int").alias("fraud_flag"),
        F.round(0.2 + 33 * F.col("l_discount"), 4).alias("volatility_index"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as ``filename, content``."""
    return _spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.col("text").alias("content"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as ``query_id, query``."""
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return turns.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"),
        F.col("text").alias("query"),
    )
