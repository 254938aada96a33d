"""Knowledge base: chunks, their numbering, embeddings and corpus figures."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from riskloom import fixed_values as fixed
from riskloom.functions import text
from riskloom.plans.lineage import materialise
from riskloom.plans.numbering import running_total

# Python tasks carry this module's helpers with them, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Embedder = Callable[[list[str], str], np.ndarray]
#: Characters of text that an embedder gets at a time.
PART_CHARS = 1_000_000


def chunk_documents(documents: DataFrame, max_words: int = fixed.CHUNK_WORDS,
                    separator: str = text.BLANK_LINE, key: str = "filename") -> DataFrame:
    """Chunks per document as ``key, filename, position, content``; no shuffle.

    The outer explode keeps the optimizer from adding a size filter, which would pack every
    text twice.
    """
    names = list(dict.fromkeys([key, "filename"]))
    packed = documents.select(*names, text.packed(F.col("content"), max_words, separator).alias("parts"))
    return packed.select(*names, F.posexplode_outer("parts").alias("position", "content")).where(
        F.col("position").isNotNull())


def chunk_counts(documents: DataFrame, max_words: int = fixed.CHUNK_WORDS,
                 separator: str = text.BLANK_LINE, key: str = "filename") -> DataFrame:
    """Number of chunks of each document, zeros kept."""
    names = list(dict.fromkeys([key, "filename"]))
    chunks = text.packed_count(F.col("content"), max_words, separator)
    return documents.select(*names, chunks.cast("bigint").alias("chunks"))


def chunk_table(documents: DataFrame, max_words: int = fixed.CHUNK_WORDS,
                separator: str = text.BLANK_LINE, key: str | None = None) -> DataFrame:
    """Chunks numbered through the whole corpus, as ``chunk_id, content, filename``.

    Documents are numbered, not names: equal names are different documents. They come in
    order of ``path`` if there is one, else of ``filename``, or of ``key``; ties by content.
    Every text is packed once, and its chunks are stored with its place.
    """
    order = key or ("path" if "path" in documents.columns else "filename")
    parts = text.packed(F.col("content"), max_words, separator)
    packed = materialise(documents.select(F.col(order).alias("_key"), "filename", parts.alias("_parts"), F.xxhash64(
        "content").alias("_hash")).withColumn("_doc", F.monotonically_increasing_id()), "packed")
    sized = packed.select("_key", "_hash", "_doc", F.greatest(F.size("_parts"), F.lit(0)).cast("bigint").alias("_chunks"))
    # Equal documents stand in any order, which gives the same chunks the same numbers.
    first = running_total(sized, [F.col("_key"), F.col("_hash"), F.col("_doc")], F.col("_chunks"), "_first")
    pieces = packed.select("_doc", "filename", F.posexplode("_parts").alias("_position", "content"))
    number = F.col("_first") + F.col("_position")
    return pieces.join(first.select("_doc", "_first"), "_doc").select(
        F.format_string(fixed.CHUNK_ID_FORMAT, number).alias("chunk_id"), "content", "filename")


def corpus_stats(documents: DataFrame, max_words: int = fixed.CHUNK_WORDS,
                 separator: str = text.BLANK_LINE) -> DataFrame:
    """Documents, words and chunks of the corpus, as one row."""
    sized = documents.select(
        text.word_count(text.stripped(F.col("content"))).alias("words"),
        text.packed_count(F.col("content"), max_words, separator).alias("chunks"))
    return sized.agg(
        F.count("*").alias("documents"),
        F.coalesce(F.sum("words"), F.lit(0)).alias("words"),
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


def document_words(documents: DataFrame) -> DataFrame:
    return documents.select("filename", text.word_count(text.stripped(F.col("content"))).cast("bigint").alias("words"))


def chunks_per_file(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("filename").agg(F.count("*").alias("chunk_count")).orderBy("filename")


def document_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk count of every document, zero where it has none."""
    counts = chunks.groupBy("filename").agg(F.count("*").alias("chunk_count"))
    return documents.select("filename").join(counts, "filename", "left").select(
        "filename", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


def chunk_sample(chunks: DataFrame, rows: int = fixed.LEDGER_ROWS) -> DataFrame:
    """The first chunks with the start of their text."""
    shown = F.substring("content", 1, fixed.PREVIEW_CHARS).alias("content_preview")
    return chunks.orderBy(F.length("chunk_id"), "chunk_id").limit(rows).select("chunk_id", "filename", shown)


def hashed_words(content: Column, dimensions: int = 64) -> Column:
    """Counts of hashed words, scaled to unit length; a deterministic stand-in for a model."""
    slot = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("bigint") % dimensions
    places = F.sequence(F.lit(0), F.lit(dimensions - 1))
    # One-element arrays bind the intermediate arrays, so they are computed once.
    counts = F.transform(F.array(F.transform(text.words(content), slot)), lambda slots: F.transform(
        places, lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double")))
    scaled = F.transform(counts, lambda c: F.transform(F.array(F.sqrt(F.aggregate(
        c, F.lit(0.0), lambda total, x: total + x * x))), lambda length: F.transform(
        c, lambda x: F.when(length > 0, x / length).otherwise(F.lit(0.0)).cast("float"))))
    return F.flatten(scaled)[0]


def embed(rows: DataFrame, embedder: Embedder | None = None, task_type: str = fixed.TASK_DOCUMENT,
          column: str = "content") -> DataFrame:
    """``rows`` plus ``embedding`` and ``embedding_status``, empty on success or the error text.

    Without an ``embedder`` words are hashed, without Python. ``embedder(texts, task_type)``
    runs on parts of Arrow batches of bounded size. Where a part fails, its texts are tried
    one by one, so one bad text does not spoil the others.
    """
    if embedder is None:
        known = F.col(column).isNotNull()
        return rows.withColumn("embedding", F.when(known, hashed_words(F.col(column)))).withColumn(
            "embedding_status", F.when(known, "").otherwise("ValueError: no text"))

    def one(content: str | None) -> tuple:
        try:
            if content is None:
                raise ValueError("no text")
            return np.asarray(embedder([content], task_type)[0], dtype="float32"), ""
        except Exception as error:  # the model's own failure, reported per row
            return None, f"{type(error).__name__}: {error}"

    def part(texts: list) -> list[tuple]:
        try:
            if any(t is None for t in texts):
                raise ValueError("no text")
            vectors = np.asarray(embedder(texts, task_type), dtype="float32")
            if len(vectors) != len(texts):
                raise ValueError("one vector per text expected")
            return [(v, "") for v in vectors]
        except Exception:  # fall back to single texts
            return [one(t) for t in texts]

    def batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            place = frame[column].str.len().fillna(0).cumsum() // PART_CHARS
            pairs = [pair for _, some in frame.groupby(place.to_numpy(), sort=True) for pair in part(some[column].tolist())]
            yield frame.assign(embedding=[v for v, _ in pairs], embedding_status=[s for _, s in pairs])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(batch, f"{schema}, embedding array<float>, embedding_status string")


def embedding_errors(embedded: DataFrame) -> DataFrame:
    """Rows whose embedding failed."""
    return embedded.where((F.col("embedding_status") != "") & F.col("embedding_status").isNotNull())


def embedding_error_count(embedded: DataFrame) -> DataFrame:
    return embedding_errors(embedded).agg(F.count("*").alias("error_count"))
