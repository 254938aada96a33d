"""Registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from riskloom.llm import lexical, lm, mixing, neardup, negatives, packing, quality, repeats, secrets, sharding, topk, toxicity, warc
from riskloom.llm.common import held_out, only, with_words
from riskloom.plans.lineage import materialise


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def op1_lm_score(spark: SparkSession, d: str) -> DataFrame:
    return lm.score(_table(spark, d, "documents").withColumn("held_out", held_out("doc_id", 7, 2)))


def op2_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find_secrets(only(_table(spark, d, "documents"), "doc_id", "text")).drop("mask")


def op3_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = _table(spark, d, "documents"), _table(spark, d, "labels")
    model = toxicity.fit(docs, labels, learnable=~held_out("doc_id", 5, 0))
    scored = toxicity.score(only(docs, "doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.round_trip(_table(spark, d, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.measured(_table(spark, d, "documents")))


def op6_sharding(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    rows = docs.select("doc_id", sharding.hash_bits("doc_id").alias("hash"), F.octet_length("text").alias("bytes"))
    return sharding.shards(rows).drop("hash")


def op7_top_k(spark: SparkSession, d: str) -> DataFrame:
    vectors = topk.integers(_table(spark, d, "embeddings"))
    return topk.top_k(vectors, vectors.where("id % 100 = 0"), 10)


def op8_bagminhash(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(_table(spark, d, "documents"))


def op9_mixing(spark: SparkSession, d: str) -> DataFrame:
    docs = only(_table(spark, d, "documents"), "doc_id", "text", "source")
    rows = materialise(with_words(mixing.keyed(docs)), "sized")
    return mixing.apply_plan(rows, mixing.plan(rows)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "shards")


def op10_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    trees = quality.fit(docs, _table(spark, d, "labels"))
    return quality.judge(only(docs, "doc_id", "text"), trees).drop("text")


def op11_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, d, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_fp_tree_search(spark: SparkSession, d: str) -> DataFrame:
    return lexical.rank_documents(_table(spark, d, "documents"), _table(spark, d, "benchmark"), 20)


def op13_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    noisy = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.integers(_table(spark, d, "embeddings"), 256, noisy), F.col("id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_lm_score, op2_secret_scan, op3_toxicity, op4_warc, op5_packing, op6_sharding, op7_top_k,
        op8_bagminhash, op9_mixing, op10_quality_rules, op11_substring_dedup,
        op12_fp_tree_search, op13_hard_negatives)}


OP4 = """
SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN revisits THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisits THEN first END AS refers_to
FROM (SELECT *, strlen(coalesce(html, '')) >= 100 AND page_id <> first AS revisits
      FROM (SELECT *, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages))
"""

OP6 = """
WITH hashed AS (
    SELECT doc_id, strlen(coalesce(text, '')) AS bytes,
           CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hash
    FROM documents),
buckets AS (
    SELECT depth, hash >> (60 - depth) AS prefix, CAST(sum(bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows
    FROM hashed, (SELECT unnest(range(0, 61)) AS depth) GROUP BY ALL),
shortest AS (
    SELECT h.doc_id, h.bytes, h.hash, min(b.depth) AS depth
    FROM hashed h JOIN buckets b ON b.prefix = h.hash >> (60 - b.depth)
    WHERE b.shard_bytes <= 1048576 OR b.shard_rows = 1 GROUP BY ALL)
SELECT s.doc_id, s.bytes, CAST(s.depth AS INTEGER) AS depth, b.shard_bytes, b.shard_rows,
       CASE WHEN s.depth = 0 THEN '' ELSE lpad(bin(b.prefix), CAST(s.depth AS INTEGER), '0') END AS shard
FROM shortest s JOIN buckets b ON b.depth = s.depth AND b.prefix = s.hash >> (60 - s.depth)
"""

OP7 = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
"""

OP11 = r"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM texts),
windows AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM starts),
later AS (
    SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM windows)
    WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later),
kept AS (
    SELECT t.doc_id, count(*) AS n, string_agg(t.word, ' ' ORDER BY t.p) AS kept
    FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM texts) t
    ANTI JOIN gone g ON g.doc_id = t.doc_id AND g.p = t.p GROUP BY t.doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (doc_id)
"""

OP12 = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents),
asked AS (
    SELECT item_id, term, count(*) AS repeats
    FROM (SELECT item_id, unnest(regexp_extract_all(
              translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
    GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY ALL),
totals AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
measured AS (SELECT doc_id, 75 + (25 * n * docs) // total AS m FROM lengths, totals),
counted AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weighed AS (
    SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM counted, totals GROUP BY term, docs),
scored AS (
    SELECT item_id, doc_id, CAST(sum(w * repeats * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
    FROM asked JOIN counted USING (term) JOIN weighed USING (term) JOIN measured USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""

OP13 = """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
    FROM usable a JOIN usable r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
     AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""


def oracle_sql() -> dict[str, str]:
    piped = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return piped | {"op4_warc": OP4, "op6_sharding": OP6, "op7_top_k": OP7, "op11_substring_dedup": OP11, "op12_fp_tree_search": OP12,
                    "op13_hard_negatives": OP13}
