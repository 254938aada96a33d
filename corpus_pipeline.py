"""From raw documents to packed training bins, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. All
but the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.llm import mixing, neardup, packing, quality, secrets
from riskloom.llm.common import only, with_words
from riskloom.plans.lineage import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the fixed rules or the trees reject."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    own = {c: f"_own_{c}" for c in docs.columns if c in quality.ADDED}
    judged = quality.judge(docs.withColumnsRenamed(own), quality.fit(docs, labels)).where("kept")
    return judged.drop(*quality.ADDED).withColumnsRenamed({v: k for k, v in own.items()}).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the smallest id."""
    return neardup.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Covers the values of secrets; documents without one stay as they are."""
    found = materialise(secrets.scan(only(docs, "doc_id", "text")).where(
        "size(base) > 0 OR size(candidates) > 0"), "spans")
    covered = secrets.redact(docs, secrets.learn(found))
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return covered.withColumn("n_chars", F.when(F.col("text").contains("[SECRET]"), length).otherwise(F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents to meet the sources' targets; rows stand in the shuffled order of their shards."""
    made = mixing.plan(materialise(with_words(mixing.keyed(docs).select("source", "key", "text")), "sized"))
    # The document travels as one value, so its columns cannot clash with the plan's.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    key = F.xxhash64("doc_id", "text").alias("key")
    taken = mixing.apply_plan(docs.select(whole, "source", key), made)
    return taken.withColumn("shard", F.explode("shards")).repartition("shard").sortWithinPartitions(
        "shard", F.xxhash64(F.lit(mixing.SEED), "shard", "key")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every word of every document in one bin."""
    return packing.pack(packing.measured(docs))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan),
    ("mixing", mix), ("packing", pack)]
#: Learnt models, hashes of words and seeded draws are not expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; what a stage returns is stored and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
