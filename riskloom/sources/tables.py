"""Writing, replacing and checking tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Rows of a bucket, about 100 MB of transactions.
BUCKET_ROWS = 1_000_000

TRANSACTION_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("account_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("amount", T.DecimalType(18, 2)),
    T.StructField("transaction_type", T.StringType()),
    T.StructField("merchant_category", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("fraud_flag", T.IntegerType()),
    T.StructField("volatility_index", T.DoubleType()),
])

CHUNK_SCHEMA = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("filename", T.StringType()),
])


def write_files(df: DataFrame, path: str, partition_by: list[str] | None = None, compression: str | None = None) -> str:
    """Parquet at any Hadoop URI, replacing what is there."""
    writer = df.write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def write_by_month(enriched: DataFrame, path: str) -> str:
    """Stores enriched transactions by month.

    Rows are range-partitioned by time first, so a month is split over as many tasks as
    it needs, and each task opens only the folders of its own few months. The month is added behind that shuffle.
    """
    ranged = enriched.repartitionByRange("timestamp", "transaction_id")
    months = ranged.withColumn("month", F.date_format("timestamp", "yyyy-MM"))
    return write_files(months, path, ["month"], "zstd")


def create_namespace(spark: SparkSession, name: str) -> None:
    quoted = name.replace("`", "``")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{quoted}`")


def create_table(spark: SparkSession, name: str, schema: T.StructType, path: str | None = None) -> None:
    """An empty typed table, replacing one of the same name."""
    replace_table(spark.createDataFrame([], schema), name, path)


def replace_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Loads ``df`` into ``name``, replacing the whole table; also the form of CREATE TABLE AS.

    The rows go to a fresh folder below ``path``, or below the warehouse, and then the catalog is pointed
    to it. So a failed load leaves the old rows, and a table may be replaced from itself.
    """
    spark = df.sparkSession
    root = path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name.replace('`', '')}.loads"
    folder = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    quoted = ".".join(f"`{part.strip('`')}`" for part in name.split("."))
    place = folder.replace("'", "\\'")
    if spark.catalog.tableExists(name):
        same = [(f.name, f.dataType) for f in spark.table(name).schema] == [(f.name, f.dataType) for f in df.schema]
        if same and spark.sql(f"DESCRIBE EXTENDED {quoted}").where("col_name = 'Type' AND data_type = 'EXTERNAL'").count():
            spark.sql(f"ALTER TABLE {quoted} SET LOCATION '{place}'")
            spark.catalog.refreshTable(name)
            return
        spark.sql(f"DROP TABLE {quoted}")  # other columns: the old files stay, the entry is made anew
    spark.catalog.createTable(name, path=folder, source="parquet", schema=df.schema)


def load_report(df: DataFrame) -> DataFrame:
    """Row count and column names, as one row."""
    return df.agg(F.count("*").alias("num_rows")).withColumn(
        "column_names", F.lit(", ".join(df.columns)))


def records(df: DataFrame, time_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Each row as one JSON object in ``record``; null fields are kept, times formatted."""
    shown = [
        F.date_format(f.name, time_format).alias(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("record"))


def buckets_for(rows: int, least: int = 1) -> int:
    """Buckets for a table of that many rows: ``least``, or more where one would hold over ``BUCKET_ROWS``."""
    return max(least, -(-rows // BUCKET_ROWS))


def write_by_account(tx: DataFrame, name: str, buckets: int, path: str | None = None) -> None:
    """Stores transactions as table ``name``, in ``buckets`` by account, each sorted by account, time and id.

    What is grouped or windowed by account later needs no exchange. Rows without an account would meet
    in one bucket, so they get spread-out keys of their own in ``account_bucket``, by which the buckets are made; a
    known account's key is its id. One task reads a bucket, so ``buckets`` should grow with the rows: see ``buckets_for``.
    """
    spread = F.concat(F.lit("orphan "), F.pmod(F.xxhash64("transaction_id"), F.lit(64 * buckets)).cast("string"))
    keyed = tx.withColumn("account_bucket", F.coalesce("account_id", spread))
    writer = keyed.repartition(buckets, "account_bucket").write.format("parquet").mode("overwrite").bucketBy(
        buckets, "account_bucket").sortBy("account_bucket", "timestamp", "transaction_id")
    (writer.option("path", path) if path else writer).saveAsTable(name)
