"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the tables and the number of threads. Flow as in
use: raw transactions are stored, enriched and stored again, then marts and graphs read
the enriched table.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.operators import graph, knowledge, lists, marts, routing, search
from riskloom.operators.communities import louvain
from riskloom.operators.enrich import enrich
from riskloom.plans.lineage import clear_scratch, materialise, scratch_path
from riskloom.plans.pipelines import write_marts
from riskloom.sources import tpch

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    seconds: dict[str, float] = {}

    def timed(name: str, work):
        start = time.perf_counter()
        result = work()
        seconds[name] = round(time.perf_counter() - start, 3)
        return result

    # Warm-up: class loading and code generation.
    run(enrich(tpch.transactions(spark, SF_DIR), tpch.account_rows(spark, SF_DIR)))

    raw = timed("load_transactions", lambda: materialise(tpch.transactions(spark, SF_DIR), "raw"))
    timed("enrich", lambda: run(enrich(raw)))
    stored = timed("enrich_and_store", lambda: materialise(enrich(raw), "enriched"))
    for build in (marts.kpi_summary, marts.risk_by_channel, marts.monthly_trend, marts.country_risk,
                  marts.risk_distribution, marts.critical_events, marts.trailing_range_kpi, marts.peak_tiles,
                  marts.top_customers):
        timed(build.__name__, lambda: build(stored).collect())
    timed("score_describe", lambda: marts.describe(stored, "risk_score").collect())
    timed("rolling_describe", lambda: marts.describe(stored, "rolling_avg_amount").collect())
    timed("write_marts", lambda: write_marts(stored, scratch_path(spark, "marts")).collect())
    pairs = timed("graph_edges", lambda: materialise(graph.pairs(graph.suspicious(stored)), "pairs"))
    edges = graph.edge_table(pairs)
    timed("node_stats", lambda: run(graph.node_stats(edges)))
    timed("neighbours_2hop", lambda: run(graph.neighbourhood(edges, ["ACC-00007"])))
    pull = materialise(graph.pairs(graph.graph_pull(stored)), "pull")
    timed("louvain_300", lambda: run(louvain(pull)))
    part = timed("louvain_all", lambda: materialise(louvain(pairs), "partition"))
    timed("ring_ledger", lambda: graph.ring_ledger(pairs, part).collect())
    docs = tpch.documents(spark, SF_DIR)
    chunks = timed("chunks", lambda: materialise(knowledge.chunk_table(docs, 60, "\n"), "chunks"))
    embedded = timed("embed", lambda: materialise(knowledge.embed(chunks), "embedded"))
    vectors = tpch.table(spark, SF_DIR, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    queries = vectors.withColumnRenamed("id", "query_id")
    timed("vector_topk", lambda: run(search.vector_search(vectors, queries)))
    timed("ivf_topk", lambda: run(lists.search_index(lists.build_index(vectors), queries)))
    asked = tpch.questions(spark, SF_DIR)
    timed("rag_context", lambda: run(search.retrieve_context(asked, embedded)))
    timed("route_queries", lambda: run(routing.route_queries(asked)))
    clear_scratch(spark)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
