"""The end-to-end flows: enrichment to marts, fraud rings, knowledge base, grounded questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from riskloom import fixed_values as fixed
from riskloom.functions.text import BLANK_LINE
from riskloom.operators import graph, marts
from riskloom.operators.communities import louvain
from riskloom.operators.knowledge import chunk_table, embed
from riskloom.operators.routing import prompts, route_queries
from riskloom.operators.search import retrieve_context, write_lists
from riskloom.plans.lineage import materialise
from riskloom.sources.versions import read_tables, write_tables

SUMMARIES = {
    "metrics": marts.kpi_of,
    "risk_by_channel": marts.channels_of,
    "temporal_risk": marts.trend_of,
    "geographical_risk": marts.countries_of,
    "risk_distribution": marts.distribution_of,
}
TOPS = {
    "critical_events": marts.critical_events,
    "graph_pull": lambda enriched: graph.graph_pull(enriched).select(*graph.GRAPH_COLUMNS),
}
MARTS = [*SUMMARIES, *TOPS]


def write_marts(enriched: DataFrame, folder: str) -> DataFrame:
    """Replaces all seven marts of ``folder`` together and returns ``mart, num_rows, column_names``.

    Three scans of ``enriched``: one sums up, and five marts are cut from its small stored table; one for each mart of
    top rows, of which a task keeps no more than the mart has. Read them with ``versions.read_tables``.
    """
    summary = materialise(marts.summary(enriched), "summary")
    built = {name: build(summary) for name, build in SUMMARIES.items()} | {name: build(enriched) for name, build in TOPS.items()}
    return write_tables(built, folder).withColumnRenamed("name", "mart")


@dataclass
class FraudRings:
    """Nodes, edges and ring ledger of one graph, with its merged pairs and partition."""

    nodes: DataFrame
    edges: DataFrame
    communities: DataFrame
    pairs: DataFrame
    partition: DataFrame


def fraud_rings(enriched: DataFrame, min_risk: float = fixed.SUSPICIOUS_RISK,
                max_edges: int | None = None, weight: str = "gross") -> FraudRings:
    """The graph page: riskiest transactions, their graph, communities and ledger.

    Every transaction of at least ``min_risk`` takes part unless the caller sets ``max_edges``.
    """
    merged = materialise(graph.pairs(graph.graph_view(enriched, min_risk, max_edges)), "pairs")
    partition = materialise(louvain(merged, weight), "partition")
    return FraudRings(
        graph.node_table(merged, partition), graph.edge_table(merged),
        graph.ring_ledger(merged, partition), merged, partition)


@dataclass
class KnowledgeBase:
    """Stored chunks, their vectors with a status, and the list partitioning of the vectors."""

    chunks: DataFrame
    embedded: DataFrame
    lists: tuple[DataFrame, list[list[float]]]


def build_knowledge_base(documents: DataFrame, folder: str, max_words: int = fixed.CHUNK_WORDS,
                         separator: str = BLANK_LINE, embedder=None, lists: int = fixed.VECTOR_LISTS) -> KnowledgeBase:
    """From documents, such as those of ``read_text_corpus``, to a searchable base below ``folder``.

    Chunks go to ``staging``, their vectors and the status of each to ``embeddings``, and the
    vectors of the usable ones by list to ``lists``. What was there is replaced, the first two together.
    """
    spark = documents.sparkSession
    chunks = materialise(chunk_table(documents, max_words, separator), "chunks")
    write_tables({"staging": chunks, "embeddings": embed(chunks, embedder)}, folder)
    stored = read_tables(spark, folder, "staging", "embeddings")
    usable = stored["embeddings"].where("embedding_status = ''").select(F.col("chunk_id").alias("id"), "embedding")
    centroids = write_lists(usable, f"{folder}/lists", lists)
    return KnowledgeBase(stored["staging"], stored["embeddings"], (spark.read.parquet(f"{folder}/lists"), centroids))


def ask(questions: DataFrame, embedded: DataFrame, top_k: int = fixed.TOP_K, embedder=None,
        lists: tuple[DataFrame, list[list[float]]] | None = None, **prompt_options) -> DataFrame:
    """Questions with route, context for the ``pro`` ones, prompt and model label."""
    routed = materialise(route_queries(questions), "routed")
    deep = routed.where(F.col("model_class") == "pro")
    grounded = retrieve_context(deep, embedded, top_k, embedder, lists)
    quick = routed.where(F.col("model_class") == "flash").withColumns({
        "context": F.lit(None).cast("string"), "sources": F.lit(None).cast("array<string>")})
    return prompts(grounded.unionByName(quick), **prompt_options)
