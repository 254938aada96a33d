"""One callable per operator, over the whole given tables."""

from __future__ import annotations

import functools
import sys
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.errors import SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom import fixed_values as fixed
from riskloom.operators import enrich as enrichment
from riskloom.operators import graph, knowledge, lists, marts, routing, search
from riskloom.operators.communities import MARGIN, louvain, modularity
from riskloom.plans.components import components
from riskloom.plans import lineage, pipelines
from riskloom.plans.lineage import materialise, scratch_path
from riskloom.sources import corpus, tables, tpch, versions

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # for the embedder below

SEPARATOR = "\n"
MAX_WORDS = 60
NEIGHBOUR_SEED = "ACC-00007"
# One question per routing keyword and topic word, and some that only look like one.
LITERAL_QUESTIONS = [
    "Which accounts have the highest risk score?",
    "Give me a quick overview of cash deposits",
    "Are current limits too low?",
    "Write a summary of last week",
    "how much did ACC-00042 move  ",
    "Please calculate exposure per branch",
    "Total outgoing volume by month",
    "Do not discount late payments",
    "On average, who pays late?",
    "Describe blacklisted merchants",
    "  SHOW ME card refunds",
    "What is the reporting deadline?",
    "Any status on case 17?",
    "Unbalanced books since spring",
    "Why do WIRE payments fail?",
    "Explain KYC steps, wired money aside",
    "When must a case be escalated?",
    "Which credit lines shrink?",
    "Early warning of default",
    "Why do shell firms matter?",
    "   ",
]
#: A word some chunks have, on which the registered embedder fails.
REFUSED = "thtion"
#: Words and names that meet every channel, route and topic rule, and some that meet none.
RULE_WORDS = ["structuring", "laundering", "smurfing", "wire", "takeover", "card", "purchase", "layering", "investment",
              "shell", "salary", "kyc", "escalated", "credit", "warning", "list", "balance", "show me", "rent"]
RULE_COUNTRIES = ["Nigeria", "Iran", "Myanmar", "Russia", "China", "United Arab Emirates", "Germany", "United Kingdom",
                  "Singapore", "United States", "Peru", "iran"]
PROMPT_TEXTS = {
    "system_text": "Use only what the context says.", "introduction": "Context follows.",
    "closing": "Name the files you relied on.", "quick_closing": "Answer in one sentence.",
}


def _tx(spark: SparkSession, d: str) -> DataFrame:
    return tpch.transactions(spark, d)


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    return enrichment.enrich(_tx(spark, d), tpch.account_rows(spark, d))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every suspicious transaction, merged per pair."""
    return graph.pairs(graph.suspicious(_enriched(spark, d)))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_table(_pairs(spark, d))


def _plain(df: DataFrame) -> DataFrame:
    """Amounts as double, which every client reads alike."""
    return df.withColumn("amount", F.col("amount").cast("double"))


def _shown_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumn("weight", F.round("weight", 2)).withColumn("width", F.round("width", 6))


def _partition_by_country(merged: DataFrame) -> DataFrame:
    """A partition that SQL can also compute: a node's lowest neighbour number modulo 7."""
    ends = graph.ends(merged)
    number = F.pmod(F.regexp_extract(F.min("other"), r"(\d+)$", 1).cast("bigint"), F.lit(7))
    return ends.groupBy("id").agg(number.alias("community"))


_FOUND: dict[tuple, pipelines.FraudRings] = {}


def _rings(spark: SparkSession, d: str) -> pipelines.FraudRings:
    """Rings of the whole table; found once per session, as several queries show them."""
    key = (spark.sparkContext.applicationId, d, lineage.clearings)
    if key not in _FOUND:
        _FOUND[key] = pipelines.fraud_rings(_enriched(spark, d))
    return _FOUND[key]


def _shown_ledger(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("aggregate_volume", F.round("aggregate_volume", 2)).withColumn(
        "vulnerability_risk_rating", F.round("vulnerability_risk_rating", 6))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.chunk_table(tpch.documents(spark, d), MAX_WORDS, SEPARATOR)


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """All user turns and the literal questions."""
    literal = F.array(*[
        F.struct(F.lit(f"q{i}").alias("query_id"), F.lit(q).alias("query")) for i, q in enumerate(LITERAL_QUESTIONS)])
    extra = spark.range(1).select(F.explode(literal).alias("q")).select("q.*")
    return tpch.questions(spark, d).unionByName(extra)


def _regions(spark: SparkSession, d: str) -> DataFrame:
    """Nation names in another case, and the names of the fallback table."""
    nations = tpch.table(spark, d, "nation").select(F.lower("n_name").alias("region"))
    return nations.unionByName(marts.fallback_regions(spark).select("region"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return tpch.table(spark, d, "embeddings")


def _shown_hits(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


def transactions(spark, d):
    return _plain(_tx(spark, d))


def enriched(spark, d):
    return _plain(_enriched(spark, d)).withColumn("rolling_avg_amount", F.round("rolling_avg_amount", 8))


def enriched_split_accounts(spark, d):
    """The same result with every account above 200 rows cut into time slices."""
    out = enrichment.enrich(_tx(spark, d), tpch.account_rows(spark, d), hot_rows=200)
    return _plain(out).withColumn("rolling_avg_amount", F.round("rolling_avg_amount", 8))


def enriched_from_buckets(spark, d):
    """The same result from a table stored in buckets by account, which is not shuffled again."""
    name, rows = f"by_account_{uuid.uuid4().hex}", tpch.account_rows(spark, d).agg(F.sum("rows")).first()[0] or 0
    tables.write_by_account(_tx(spark, d), name, tables.buckets_for(rows, 8), scratch_path(spark, "by_account"))
    out = materialise(enrichment.enrich_bucketed(spark.table(name)), "enriched")
    spark.sql(f"DROP TABLE {name}")
    return _plain(out).withColumn("rolling_avg_amount", F.round("rolling_avg_amount", 8))


def risk_components(spark, d):
    from riskloom.functions import scoring
    return _enriched(spark, d).select(
        "transaction_id", scoring.volatility_flag().alias("volatility_flag"),
        scoring.deviation_flag().alias("amount_deviation"), scoring.fraud_component().alias("fraud_component"))


def high_risk_transactions(spark, d):
    from riskloom.functions import scoring
    return _enriched(spark, d).where(scoring.is_high_risk()).select("transaction_id", "risk_score")


def critical_ledger(spark, d):
    return marts.critical_ledger(marts.critical_events(_enriched(spark, d)))


def critical_ledger_all(spark, d):
    """Every event, ranked; the "all" form of the ledger."""
    return marts.critical_ledger(_enriched(spark, d))


def _unknowns(spark: SparkSession, d: str) -> DataFrame:
    """Enriched transactions, scores unknown for one type and volatilities for one country."""
    return _enriched(spark, d).withColumns({
        "risk_score": F.when(F.col("transaction_type") != "1-URGENT", F.col("risk_score")),
        "volatility_index": F.when(F.col("country") != "NATION_11", F.col("volatility_index"))})


def ledger_with_unknowns(spark, d):
    return marts.critical_ledger(_unknowns(spark, d))


def compact_ledger_with_unknowns(spark, d):
    return marts.compact_ledger(_unknowns(spark, d), None)


def event_channels(spark, d):
    from riskloom.functions import scoring
    events = tpch.table(spark, d, "events")
    return events.groupBy("event_type").agg(F.count("*").alias("n")).withColumn(
        "channel", scoring.channel("event_type"))


def rolling_describe(spark, d):
    column = materialise(_enriched(spark, d).select("rolling_avg_amount"), "column")
    return marts.describe(column, "rolling_avg_amount", 6)


def score_describe(spark, d):
    column = materialise(_enriched(spark, d).select("risk_score"), "column")
    return marts.describe(column, "risk_score", 6)


def trailing_months(spark, d):
    trend = marts.monthly_trend(_enriched(spark, d))
    out = None
    for months in (3, 6, 12):
        part = marts.trailing_months(trend, months).withColumn("months", F.lit(months))
        out = part if out is None else out.unionByName(part)
    return out


def region_heatmap(spark, d):
    heat = marts.region_heatmap(marts.country_risk(_enriched(spark, d)), _regions(spark, d))
    return heat.withColumn("risk", F.round("risk", 4))


def records(spark, d):
    return tables.records(_enriched(spark, d).select(*marts.LEDGER_COLUMNS))


def load_report(spark, d):
    return tables.load_report(_tx(spark, d))


def graph_edges(spark, d):
    return _shown_edges(_edges(spark, d))


def graph_nodes(spark, d):
    """Nodes of the fallback partition."""
    merged = _pairs(spark, d)
    return graph.node_table(merged, graph.single_ring(merged))


def graph_nodes_partitioned(spark, d):
    merged = materialise(_pairs(spark, d), "pairs")
    return graph.node_table(merged, _partition_by_country(merged), fixed.WEB_PALETTE)


def node_stats(spark, d):
    return graph.node_stats(_edges(spark, d))


def graph_view(spark, d):
    return _plain(graph.graph_view(_enriched(spark, d), 0.3, 500))


def graph_view_all(spark, d):
    return _plain(graph.graph_view(_enriched(spark, d), 0.3, None))


def graph_view_edges(spark, d):
    """Edges of the default graph page."""
    return _shown_edges(graph.edge_table(graph.pairs(
        graph.graph_view(_enriched(spark, d), max_edges=fixed.DEFAULT_MAX_EDGES))))


def neighbours_2hop(spark, d):
    page = graph.edge_table(graph.pairs(graph.graph_pull(_enriched(spark, d))))
    return graph.neighbourhood(materialise(page, "page"), [NEIGHBOUR_SEED])


def neighbours_2hop_all(spark, d):
    return graph.neighbourhood(materialise(_edges(spark, d), "edges"), [NEIGHBOUR_SEED])


def neighbours_from_index(spark, d):
    """The same from edges stored by node, of which only the buckets of the seed and its neighbours are read."""
    name = f"adjacency_{uuid.uuid4().hex}"
    graph.write_adjacency(_edges(spark, d), name, 16, scratch_path(spark, "adjacency"))
    found = materialise(graph.neighbourhood_of(spark.table(name), [NEIGHBOUR_SEED]), "found")
    spark.sql(f"DROP TABLE {name}")
    return found


def select_by_property(spark, d):
    merged = _pairs(spark, d)
    nodes = graph.node_table(merged, graph.single_ring(merged))
    return graph.select_nodes(nodes, "type", ["account"])


def select_by_edge(spark, d):
    return graph.select_by_edge(_edges(spark, d), "color", [fixed.RISKY_EDGE_COLOR])


def restrict_nodes(spark, d):
    edges = materialise(_edges(spark, d), "edges")
    chosen = graph.select_by_edge(edges, "risk", ["1.0"])
    return graph.restrict_nodes(graph.links(edges).select("id").distinct(), chosen)


def restrict_edges(spark, d):
    edges = materialise(_edges(spark, d), "edges")
    return _shown_edges(graph.restrict_edges(edges, graph.select_by_edge(edges, "risk", ["1.0"])))


def ring_ledger(spark, d):
    """Ledger of a partition that SQL can also compute."""
    merged = materialise(_pairs(spark, d), "pairs")
    return _shown_ledger(graph.ring_ledger(merged, _partition_by_country(merged)))


def fallback_ledger(spark, d):
    merged = materialise(_pairs(spark, d), "pairs")
    return _shown_ledger(graph.ring_ledger(merged, graph.single_ring(merged)))


def cross_ring_edges(spark, d):
    merged = materialise(_pairs(spark, d), "pairs")
    return _shown_edges(graph.cross_ring_edges(graph.edge_table(merged), _partition_by_country(merged)))


def ring_members(spark, d):
    return graph.ring_members(_partition_by_country(_pairs(spark, d)))


def louvain_partition(spark, d):
    """Communities over every suspicious transaction."""
    return _rings(spark, d).partition


def louvain_modularity(spark, d):
    rings = _rings(spark, d)
    return modularity(rings.pairs, rings.partition)


def partition_faults(merged: DataFrame, part: DataFrame) -> DataFrame:
    """Violations of a partition by gross volume, recounted by plain joins; all are 0.

    Nodes missing or double, gaps in the numbers, single moves that gain, whole communities that
    gain by moving into another, communities that are not connected inside, and whether
    modularity is below 0. A gain counts from the bound of the search, with room for rounding.
    """
    spark, least = merged.sparkSession, MARGIN * (1 + 1e-6)
    w = merged.select("customer_id", "account_id", F.col("gross").cast("double").alias("w")).where("w > 0")
    ways = w.select(F.col("customer_id").alias("id"), F.col("account_id").alias("other"), "w").unionByName(
        w.select(F.col("account_id").alias("id"), F.col("customer_id").alias("other"), "w"))
    two_m = ways.agg(F.sum("w")).first()[0]
    strength = ways.groupBy("id").agg(F.sum("w").alias("k"))
    placed = materialise(strength.join(part, "id"), "placed")
    total = placed.groupBy("community").agg(F.sum("k").alias("total"))
    toward = ways.join(part.toDF("other", "to"), "other").groupBy("id", "to").agg(F.sum("w").alias("w"))
    there = total.toDF("to", "there")
    own = placed.join(total, "community").join(toward.toDF("id", "community", "inside"), ["id", "community"], "left").select(
        "id", "k", "community", (F.coalesce("inside", F.lit(0.0)) - F.col("k") * (F.col("total") - F.col("k")) / two_m).alias("stay"))
    moves = toward.join(there, "to").join(own, "id").where((F.col("to") != F.col("community")) & (
        F.col("w") - F.col("k") * F.col("there") / two_m - F.col("stay") > least * F.col("k")))
    ends = materialise(w.join(part.toDF("customer_id", "a"), "customer_id").join(part.toDF("account_id", "b"), "account_id"), "ends")
    between = ends.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w"))
    merges = between.join(total.toDF("a", "ta"), "a").join(total.toDF("b", "tb"), "b").where(
        F.col("w") - F.col("ta") * F.col("tb") / two_m > least * F.least("ta", "tb"))
    pieces = components(ends.where("a = b").select(F.col("customer_id").alias("a"), F.col("account_id").alias("b")))
    loose = placed.join(pieces, F.col("id") == F.col("node"), "left").select("community", F.coalesce("component", "id").alias("piece"))
    broken = loose.groupBy("community").agg(F.countDistinct("piece").alias("n")).where("n > 1")
    nodes = graph.ends(merged).select("id").distinct()
    counts = [nodes.join(part, "id", "left_anti").count(), part.groupBy("id").count().where("count > 1").count(),
              moves.count(), merges.count(), broken.count(), int(modularity(merged, part).first()[0] < 0)]
    gaps = part.agg((F.max("community") + 1 - F.countDistinct("community"))).first()[0]
    names = ["missing", "doubled", "gaining_moves", "gaining_merges", "disconnected", "no_better", "gaps"]
    return spark.createDataFrame([tuple(int(c) for c in [*counts, gaps])], ", ".join(f"{n} bigint" for n in names))


def louvain_check(spark, d):
    """Violations of the communities of the whole table."""
    rings = _rings(spark, d)
    return partition_faults(rings.pairs, rings.partition)


def nation_rings(spark, d):
    """Customers and their nations: separate stars, of which each must become one ring."""
    customers = tpch.table(spark, d, "customer")
    tx = customers.select(
        F.concat(F.lit("CUS-"), F.col("c_custkey").cast("string")).alias("customer_id"),
        F.concat(F.lit("ACC-"), F.col("c_nationkey").cast("string")).alias("account_id"),
        F.lit(1).cast("decimal(18,2)").alias("amount"), F.lit(0.5).alias("risk_score"))
    return louvain(materialise(graph.pairs(tx), "pairs"), "count")


def rings_beside_volume(spark, d):
    """The stars of ``nation_rings`` beside one unrelated pair with far more volume than all of them."""
    customers = tpch.table(spark, d, "customer")
    stars = customers.select(
        F.concat(F.lit("CUS-"), F.col("c_custkey").cast("string")).alias("customer_id"),
        F.concat(F.lit("ACC-"), F.col("c_nationkey").cast("string")).alias("account_id"), F.lit("1.00").alias("amount"))
    pair = tpch.table(spark, d, "region").where("r_regionkey = 0").select(
        F.concat(F.lit("CUS-pair-"), F.col("r_regionkey").cast("string")).alias("customer_id"),
        F.concat(F.lit("ACC-pair-"), F.col("r_regionkey").cast("string")).alias("account_id"), F.lit("1000000000000.00").alias("amount"))
    tx = stars.unionByName(pair).withColumns({"amount": F.col("amount").cast("decimal(18,2)"), "risk_score": F.lit(0.5)})
    return louvain(materialise(graph.pairs(tx), "pairs"))


def fraud_ring_totals(spark, d):
    """Sums over the ring ledger of the whole table, the same for every partition."""
    ledger = fraud_rings(spark, d)
    return ledger.agg(*[F.sum(c).alias(c) for c in ("total_nodes", "customer_entities", "associated_bank_accounts")])


def fraud_rings(spark, d):
    """Ring ledger of the whole table."""
    return _rings(spark, d).communities


def fraud_rings_pull(spark, d):
    """Ring ledger of the graph page's pull."""
    merged = materialise(graph.pairs(graph.graph_pull(_enriched(spark, d))), "pairs")
    return graph.ring_ledger(merged, materialise(louvain(merged), "partition"))


def fraud_ring_nodes(spark, d):
    return _rings(spark, d).nodes


def fraud_ring_nodes_check(spark, d):
    """Nodes of the real rings without what depends on the partition."""
    return fraud_ring_nodes(spark, d).select("id", "label", "type", "size", "degree")


def corpus_stats(spark, d):
    return knowledge.corpus_stats(tpch.documents(spark, d), MAX_WORDS, SEPARATOR)


def document_words(spark, d):
    return knowledge.document_words(tpch.documents(spark, d))


def default_chunks(spark, d):
    return knowledge.chunk_table(tpch.documents(spark, d))


def chunks_per_file(spark, d):
    return knowledge.chunks_per_file(_chunks(spark, d))


def document_chunks(spark, d):
    return knowledge.document_chunks(tpch.documents(spark, d), _chunks(spark, d))


def chunk_sample(spark, d):
    return knowledge.chunk_sample(_chunks(spark, d))


def embedded_chunks(spark, d):
    out = knowledge.embed(_chunks(spark, d))
    return out.select("chunk_id", "embedding_status", F.explode(F.transform("embedding", lambda x, i: F.struct(
        i.alias("slot"), F.round(x.cast("double"), 5).alias("value")))).alias("e")).where(
        F.col("e.value") != 0).select("chunk_id", "embedding_status", "e.slot", "e.value")


def embed_status(spark, d):
    return knowledge.embedding_error_count(knowledge.embed(_chunks(spark, d)))


def vector_topk(spark, d):
    vectors = _vectors(spark, d)
    base = vectors.select(F.col("vec_id").alias("id"), "embedding")
    return _shown_hits(search.vector_search(base, base.withColumnRenamed("id", "query_id")))


def vector_topk_blocked(spark, d):
    """The same search with both sides cut into small blocks."""
    vectors = _vectors(spark, d)
    base = vectors.select(F.col("vec_id").alias("id"), "embedding")
    return _shown_hits(search.block_search(base, base.withColumnRenamed("id", "query_id"), block_floats=16_000))


def ivf_topk(spark, d):
    base = _vectors(spark, d).select(F.col("vec_id").alias("id"), "embedding")
    return _shown_hits(lists.search_index(lists.build_index(base), base.withColumnRenamed("id", "query_id")))


def ivf_topk_by_radius(spark, d):
    """Exact: lists are left out only where their radius proves that every row is farther."""
    base = _vectors(spark, d).select(F.col("vec_id").alias("id"), "embedding")
    return _shown_hits(lists.search_index(lists.build_index(base), base.withColumnRenamed("id", "query_id"), share=None))


def list_assignment(spark, d):
    """The two nearest of five given centroids for every vector."""
    base = _vectors(spark, d).select(F.col("vec_id").alias("id"), "embedding")
    centroids = [r["embedding"] for r in base.where("id < 5").orderBy("id").collect()]
    return search.assign_lists(base, centroids, 2).select("id", "list")


def ivf_recall(spark, d):
    """Whether ``ivf_topk`` finds at least 90 % of the true neighbours."""
    base = _vectors(spark, d).select(F.col("vec_id").alias("id"), "embedding")
    queries = base.withColumnRenamed("id", "query_id")
    found = materialise(ivf_topk(spark, d).select("query_id", "id"), "found")
    exact = materialise(search.vector_search(base, queries).select("query_id", "id"), "exact")
    share = exact.join(found, ["query_id", "id"], "left_semi").count() / max(exact.count(), 1)
    return spark.createDataFrame([(int(share >= 0.9),)], "reached int")


def ivf_topk_all_lists(spark, d):
    """Probing every list is exact."""
    base = _vectors(spark, d).select(F.col("vec_id").alias("id"), "embedding")
    queries = base.withColumnRenamed("id", "query_id")
    return _shown_hits(search.list_search(base, queries, probes=fixed.VECTOR_LISTS))


def rag_context(spark, d):
    embedded = materialise(knowledge.embed(_chunks(spark, d)), "embedded")
    out = search.retrieve_context(_questions(spark, d), embedded)
    return out.select("query_id", "query", "context", F.array_join("sources", ",").alias("sources"))


def rag_context_lists(spark, d):
    """The same through stored lists, all of them probed."""
    base = pipelines.build_knowledge_base(tpch.documents(spark, d), scratch_path(spark, "base"), MAX_WORDS, SEPARATOR)
    out = search.retrieve_context(_questions(spark, d), base.embedded, lists=base.lists, probes=fixed.VECTOR_LISTS)
    return out.select("query_id", "query", "context", F.array_join("sources", ",").alias("sources"))


def _refusing(texts, task_type):
    """Fails on texts with a given word, as a model may."""
    if any(REFUSED in t for t in texts):
        raise RuntimeError("refused")
    return np.ones((len(texts), 2))


def embed_failures(spark, d):
    return knowledge.embedding_error_count(knowledge.embed(_chunks(spark, d), _refusing))


def knowledge_base(spark, d):
    """From written text files of a few names to chunks, vectors and their status."""
    rows = tpch.table(spark, d, "documents").select(
        F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("name"), F.col("text").alias("content"))
    folder = scratch_path(spark, "texts")
    corpus.write_text_corpus(rows, folder)
    read = corpus.read_text_corpus(spark, folder)
    docs = read.select(F.regexp_extract("path", r"doc=([^/]+)\.\d+\.txt$", 1).alias("path"), F.concat(
        F.lit("part_"), F.regexp_extract("path", r"(\d)\.\d+\.txt$", 1), F.lit(".txt")).alias("filename"),
        F.regexp_replace("content", r"\n\z", "").alias("content"))
    base = pipelines.build_knowledge_base(docs, scratch_path(spark, "base"), MAX_WORDS, SEPARATOR, _refusing, lists=2)
    listed = base.lists[0].groupBy("id").agg(F.count("*").alias("listed"))
    return base.embedded.join(listed, F.col("chunk_id") == F.col("id"), "left").select(
        "chunk_id", "content", "filename", "embedding_status", F.coalesce("listed", F.lit(0)).alias("listed"))


def blank_line_chunks(spark, d):
    """The default separator and limit on texts that have blank lines."""
    docs = tpch.documents(spark, d).withColumn("content", F.regexp_replace("content", "\n", "\n \n"))
    return knowledge.chunk_table(docs)


def document_routes(spark, d):
    """Route and topic of every document and conversation turn, with words that meet each rule."""
    return routing.answer_topic(routing.route_queries(_sentences(spark, d))).select("query_id", "model_class", "topic")


def _sentences(spark, d):
    words = F.array(*[F.lit(w) for w in RULE_WORDS])
    docs = tpch.table(spark, d, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("query_id"),
        F.concat("text", F.lit(" "), F.element_at(words, (F.col("doc_id") % len(RULE_WORDS) + 1).cast("int"))).alias("query"))
    turns = tpch.table(spark, d, "conversations").select(F.concat_ws(
        "-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), F.col("text").alias("query"))
    return docs.unionByName(turns)


def ruled_ledger(spark, d):
    """Channel and country code where every rule and every default matches."""
    from riskloom.functions import scoring
    words = F.array(*[F.lit(w) for w in RULE_WORDS])
    names = F.array(*[F.lit(n) for n in RULE_COUNTRIES])
    parts = tpch.table(spark, d, "lineitem").select(
        F.concat(F.lit("Case "), F.element_at(words, (F.col("l_suppkey") % len(RULE_WORDS) + 1).cast("int"))).alias("transaction_type"),
        F.element_at(names, (F.col("l_partkey") % len(RULE_COUNTRIES) + 1).cast("int")).alias("country"))
    return parts.groupBy("transaction_type", "country").agg(F.count("*").alias("n")).withColumns(
        {"channel": scoring.channel(), "country_code": scoring.country_code()})


def refused_bounds(spark, d):
    """Which graph limits are refused, next to how many rows the accepted ones give."""
    enriched = materialise(_enriched(spark, d), "enriched")
    rows = []
    for risk, edges in ((0.3, 10), (0.3, 500), (0.3, 9), (0.3, 501), (-0.1, 100), (1.1, 100), (1.0, None)):
        try:
            rows.append((risk, edges, graph.graph_view(enriched, risk, edges).count()))
        except ValueError:
            rows.append((risk, edges, None))
    return spark.createDataFrame(rows, "min_risk double, max_edges int, num_rows bigint")


def empty_rings(spark, d):
    """A graph without edges has no nodes, edges or rings."""
    rings = pipelines.fraud_rings(_enriched(spark, d).where("risk_score < 0.1"), 0.2)
    return rings.nodes.agg(F.count("*").alias("nodes")).crossJoin(rings.edges.agg(F.count("*").alias("edges"))).crossJoin(
        rings.communities.agg(F.count("*").alias("rings")))


def route_queries(spark, d):
    return routing.route_queries(_questions(spark, d))


def answer_topic(spark, d):
    return routing.answer_topic(_questions(spark, d))


def model_class(spark, d):
    routed = routing.route_queries(_questions(spark, d))
    labelled = routed.withColumn("model", routing.model_label(F.col("model_class")))
    return labelled.select("query_id", "model", routing.label_class(F.col("model")).alias("badge"),
                           routing.label_class(F.col("model"), ["Flash"]).alias("old_badge"))


def prompts(spark, d):
    embedded = materialise(knowledge.embed(_chunks(spark, d)), "embedded")
    return pipelines.ask(_questions(spark, d), embedded, **PROMPT_TEXTS).select("query_id", "model_class", "model", "prompt")


def write_marts(spark, d):
    stored = materialise(_enriched(spark, d), "enriched")
    return pipelines.write_marts(stored, scratch_path(spark, "marts"))


def marts_switched(spark, d):
    """Marts of all transactions, replaced by those of one country; the rows of what is then current."""
    stored, folder = materialise(_enriched(spark, d), "enriched"), scratch_path(spark, "marts")
    pipelines.write_marts(stored, folder)
    before = versions.read_tables(spark, folder)
    pipelines.write_marts(stored.where("country = 'NATION_11'"), folder)
    counts = [frame.agg(F.count("*").alias("num_rows")).select(F.lit(f"{when}{name}").alias("mart"), "num_rows")
              for when, frames in (("old ", before), ("", versions.read_tables(spark, folder))) for name, frame in frames.items()]
    return functools.reduce(DataFrame.unionByName, counts)


def replaced_from_itself(spark, d):
    """A table replaced by some of its own rows, in a folder and in the catalog."""
    folder, name = scratch_path(spark, "tables"), f"customers_{uuid.uuid4().hex}"
    customers = tpch.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    versions.write_tables({"customers": customers}, folder)
    versions.write_tables({"customers": versions.read_tables(spark, folder)["customers"].where("c_nationkey < 12")}, folder)
    tables.replace_table(customers, name, f"{folder}-catalog")
    tables.replace_table(spark.table(name).where("c_nationkey >= 12"), name, f"{folder}-catalog")
    both = versions.read_tables(spark, folder)["customers"].unionByName(materialise(spark.table(name), "kept"))
    spark.sql(f"DROP TABLE {name}")
    return both


def failed_replacement(spark, d):
    """The tables that are current after a load of two has failed in the second, and the counts of the first load."""
    folder = scratch_path(spark, "tables")
    orders = tpch.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    report = versions.write_tables({"orders": orders, "keys": orders.select("o_custkey").distinct()}, folder)
    broken = orders.select(F.when(F.col("o_orderkey") > 0, F.raise_error(F.lit("refused"))).otherwise("").alias("x"))
    try:
        versions.write_tables({"orders": orders.limit(1), "keys": broken}, folder)
        raise AssertionError("the load should have failed")
    except SparkRuntimeException:
        pass
    counts = [frame.agg(F.count("*").alias("scanned")).withColumn("name", F.lit(name))
              for name, frame in versions.read_tables(spark, folder).items()]
    return functools.reduce(DataFrame.unionByName, counts).join(report.select("name", "num_rows"), "name")


def write_by_month(spark, d):
    path = tables.write_by_month(_enriched(spark, d), scratch_path(spark, "by_month"))
    return marts.fraud_check(spark.read.parquet(path))


def stored_tables(spark, d):
    """Namespace, typed empty table, replacing load and table-as-select, then a read."""
    tables.create_namespace(spark, "riskloom_check")
    name = "riskloom_check.chunks_staging"
    tables.create_table(spark, name, tables.CHUNK_SCHEMA, scratch_path(spark, "staging"))
    tables.replace_table(_chunks(spark, d), name, scratch_path(spark, "staging"))
    counts = materialise(knowledge.chunks_per_file(spark.read.table(name)), "counts")
    spark.sql(f"DROP TABLE {name}")
    spark.sql("DROP DATABASE riskloom_check")
    return counts


def read_text_corpus(spark, d):
    """Documents written as one text file each, and read back."""
    folder = scratch_path(spark, "corpus")
    docs = tpch.documents(spark, d)
    corpus.write_text_corpus(docs.select(F.regexp_replace("filename", r"\.txt$", "").alias("name"), "content"), folder)
    read = corpus.read_text_corpus(spark, folder)
    return read.select(F.regexp_extract("path", r"doc=([^/]+)\.\d+\.txt$", 1).alias("doc"),
                       F.regexp_replace("content", r"\n\z", "").alias("content"))


def _mart(build):
    return lambda spark, d: build(_enriched(spark, d))


def queries() -> dict:
    named = [
        transactions, enriched, enriched_split_accounts, enriched_from_buckets, risk_components, high_risk_transactions,
        critical_ledger, critical_ledger_all, ledger_with_unknowns, compact_ledger_with_unknowns, event_channels, rolling_describe, score_describe, trailing_months,
        region_heatmap, records, load_report, graph_edges, graph_nodes, graph_nodes_partitioned, node_stats,
        graph_view, graph_view_all, graph_view_edges, neighbours_2hop, neighbours_2hop_all, neighbours_from_index, select_by_property,
        select_by_edge, restrict_nodes, restrict_edges, ring_ledger, fallback_ledger, cross_ring_edges,
        ring_members, louvain_partition, louvain_modularity, louvain_check,
        nation_rings, rings_beside_volume, fraud_ring_totals, fraud_rings, fraud_rings_pull, fraud_ring_nodes, fraud_ring_nodes_check, corpus_stats,
        document_words, default_chunks, chunks_per_file, document_chunks, chunk_sample, embedded_chunks,
        embed_status, embed_failures, knowledge_base, blank_line_chunks, document_routes, ruled_ledger,
        refused_bounds, empty_rings, rag_context_lists, vector_topk, vector_topk_blocked, ivf_topk, list_assignment, ivf_recall, ivf_topk_all_lists, ivf_topk_by_radius, rag_context,
        route_queries, answer_topic, model_class, prompts, write_marts, marts_switched, replaced_from_itself, failed_replacement, write_by_month, stored_tables,
        read_text_corpus,
    ]
    out = {f.__name__: f for f in named}
    out["chunks"] = _chunks
    for build in (
        marts.kpi_summary, marts.risk_by_channel, marts.monthly_trend, marts.country_risk, marts.risk_distribution,
        marts.compact_ledger, marts.etl_summary, marts.score_value_counts,
        marts.trailing_range_kpi, marts.month_over_month, marts.peak_tiles, marts.top_customers,
    ):
        out[build.__name__] = _mart(build)
    for name, build in (("critical_events", marts.critical_events), ("top5_risk", marts.top_risk),
                        ("graph_pull", graph.graph_pull)):
        out[name] = lambda spark, d, build=build: _plain(build(_enriched(spark, d)))
    out["fraud_check"] = lambda spark, d: marts.fraud_check(_tx(spark, d))
    out["recent_sample"] = lambda spark, d: _plain(marts.recent_sample(_tx(spark, d)))
    return out
