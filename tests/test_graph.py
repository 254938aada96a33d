from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from checks.queries import partition_faults
from riskloom.operators import communities, graph
from riskloom.plans.lineage import materialise
from riskloom.plans.components import components as graph_components
from riskloom.plans.pipelines import fraud_rings
from riskloom.plans.skew import hot_keys, lookup

SCHEMA = ("transaction_id string, timestamp timestamp, account_id string, customer_id string, amount decimal(18,2), "
          "transaction_type string, country string, risk_score double")


def transactions(spark, rows):
    return spark.createDataFrame(
        [(f"t{i:04d}", None, a, c, Decimal(m), "wire", "US", s) for i, (c, a, m, s) in enumerate(rows)], SCHEMA)


RINGS = (
    [(f"CUS-{c}", f"ACC-{a}", "100.00", 0.6) for c in (1, 2, 3) for a in (1, 2)]
    + [(f"CUS-{c}", f"ACC-{a}", "-50.00", 0.4) for c in (7, 8, 9) for a in (8, 9)]
)


def test_pairs_cancel_but_keep_gross(spark):
    tx = transactions(spark, [("CUS-1", "ACC-1", "70.00", 0.4), ("CUS-1", "ACC-1", "-70.00", 0.65)])
    edge = graph.edge_table(graph.pairs(tx)).first()
    assert (edge["weight"], edge["width"], edge["risk"], edge["color"]) == (0.0, 1.0, 0.65, "#f43f5e")
    assert graph.pairs(tx).first()["gross"] == Decimal("140.00")


def test_bounds(spark):
    tx = transactions(spark, RINGS)
    for wrong in ({"min_risk": 1.1}, {"max_edges": 9}, {"max_edges": 501}):
        with pytest.raises(ValueError):
            graph.graph_view(tx, **wrong)
    assert graph.graph_view(tx, 0.5, 10).count() == 6
    assert graph.graph_view(tx, 0.0, None).count() == 12


def test_two_rings(spark):
    merged = graph.pairs(transactions(spark, RINGS))
    part = {r["id"]: r["community"] for r in communities.louvain(merged).collect()}
    assert {part[f"CUS-{c}"] for c in (1, 2, 3)} | {part["ACC-1"], part["ACC-2"]} == {0}
    assert {part[f"CUS-{c}"] for c in (7, 8, 9)} | {part["ACC-8"], part["ACC-9"]} == {1}
    ledger = graph.ring_ledger(merged, communities.louvain(merged)).collect()
    assert [tuple(r) for r in ledger] == [
        ("Fraud Syndicate Ring #0", 5, 3, 2, 600.0, 0.6), ("Fraud Syndicate Ring #1", 5, 3, 2, 300.0, 0.4)]


def test_crossing_transaction_counts_in_both_rings(spark):
    merged = graph.pairs(transactions(spark, RINGS + [("CUS-1", "ACC-8", "10.00", 1.0)]))
    part = spark.createDataFrame(
        [(f"CUS-{c}", 0) for c in (1, 2, 3)] + [("ACC-1", 0), ("ACC-2", 0)]
        + [(f"CUS-{c}", 1) for c in (7, 8, 9)] + [("ACC-8", 1), ("ACC-9", 1)], "id string, community long")
    plain = sorted(tuple(r) for r in graph.ring_ledger(merged, part).collect())
    assert [r[4] for r in plain] == [610.0, 310.0]
    split = sorted(tuple(r) for r in graph.ring_ledger(merged, part, hot_rows=1).collect())
    assert split == plain
    cross = graph.cross_ring_edges(graph.edge_table(merged), part, hot_rows=1).collect()
    assert [(r["from"], r["to"]) for r in cross] == [("CUS-1", "ACC-8")]


def test_empty_graph(spark):
    rings = fraud_rings(transactions(spark, RINGS), min_risk=1.0)
    assert rings.nodes.count() == rings.edges.count() == rings.communities.count() == 0
    assert rings.nodes.columns == ["id", "label", "type", "size", "color", "community", "degree"]


def test_graph_without_weight_is_one_ring(spark):
    merged = graph.pairs(transactions(spark, [("CUS-1", "ACC-1", "0.00", 0.4), ("CUS-2", "ACC-2", "0.00", 0.4)]))
    assert {r["community"] for r in communities.louvain(merged).collect()} == {0}


def components(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for c, a, *_ in rows:
        parent[find(c)] = find(a)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("weight,hot_rows", [("gross", 5_000_000), ("gross", 3), ("net", 5_000_000), ("count", 4)])
def test_partition_invariants(spark, weight, hot_rows):
    import random
    rng = random.Random(11)
    rows = [(f"CUS-{rng.randrange(40)}", f"ACC-{int(rng.random() ** 3 * 12)}", f"{rng.uniform(-90, 200):.2f}", 0.5)
            for _ in range(150)]
    rows += [(f"CUS-{c}", "ACC-77", "30.00", 0.4) for c in range(100, 112)] + [("CUS-200", "ACC-78", "0.00", 0.4)]
    merged = graph.pairs(transactions(spark, rows))
    part = communities.louvain(merged, weight, hot_rows=hot_rows).collect()
    found = {r["id"]: r["community"] for r in part}
    parts = components(rows)
    assert len(part) == len(found) and found.keys() == parts.keys()
    for community in set(found.values()):
        assert len({parts[n] for n, c in found.items() if c == community}) == 1
    sizes = [list(found.values()).count(c) for c in range(max(found.values()) + 1)]
    assert sizes == sorted(sizes, reverse=True) and min(sizes) > 0
    schema = "id string, community long"
    numbers = {c: i for i, c in enumerate(sorted(set(parts.values())))}
    whole = spark.createDataFrame([(n, numbers[c]) for n, c in parts.items()], schema)
    quality = communities.modularity(merged, spark.createDataFrame(part, schema), weight).first()[0]
    assert quality >= communities.modularity(merged, whole, weight).first()[0] - 1e-9


def faults(merged, part):
    return {k: v for k, v in partition_faults(merged, part).first().asDict().items() if v}


def block(c, a, size=4):
    """Every customer with every account, two weights in turn."""
    return [(f"CUS-{c}-{i}", f"ACC-{a}-{j}", "110.00" if (i + j) % 2 else "100.00", 0.5) for i in range(size) for j in range(size)]


@pytest.mark.parametrize("volume", ["1000000000000.00", "9000000000000000.00"])
def test_small_rings_beside_any_volume(spark, volume):
    rows = [r for n in range(10) for r in block(n, n)] + [("CUS-big", "ACC-big", volume, 0.5)]
    merged = graph.pairs(transactions(spark, rows))
    part = communities.louvain(merged)
    sizes = sorted(r["count"] for r in part.groupBy("community").count().collect())
    assert sizes == [2] + [8] * 10
    assert faults(merged, part) == {}


def test_bridge_between_blocks(spark):
    rows = block(1, 1) + block(2, 2) + [("CUS-1-0", "ACC-b", "50.00", 0.5), ("CUS-2-0", "ACC-b", "49.00", 0.5)]
    merged = graph.pairs(transactions(spark, rows))
    part = communities.louvain(merged)
    found = {r["id"]: r["community"] for r in part.collect()}
    assert len(set(found.values())) == 2 and found["ACC-b"] == found["CUS-1-0"] != found["CUS-2-0"]
    assert faults(merged, part) == {}


def test_equal_stars(spark):
    rows = [(f"CUS-{n}-{i}", f"ACC-{n}", "5.00", 0.5) for n in range(1000) for i in range(2)]
    merged = graph.pairs(transactions(spark, rows))
    part = communities.louvain(merged)
    assert part.groupBy("community").count().where("count <> 3").isEmpty()
    assert faults(merged, part) == {}


@pytest.mark.parametrize("weight,hot_rows", [("gross", 7)])
def test_search_in_one_task_is_that_of_the_rounds(spark, monkeypatch, weight, hot_rows):
    """The same partition, but for a graph that fits in a block without a stored table for each step."""
    import random
    rng, steps = random.Random(5), []
    monkeypatch.setattr(communities, "materialise", lambda df, name="step": steps.append(name) or materialise(df, name))
    rows = [(f"CUS-{rng.randrange(60)}", f"ACC-{int(rng.random() ** 2 * 20)}", f"{rng.uniform(-90, 200):.2f}", 0.5) for _ in range(300)]
    rows += block("é", "é", 3) + block("x", "x", 3) + [("ACC-3", "ACC-3", "12.00", 0.5), ("CUS-1", "CUS-2", "900.00", 0.5)]
    merged = materialise(graph.pairs(transactions(spark, rows)), "pairs")
    found = sorted(map(tuple, communities.louvain(merged, weight, hot_rows=hot_rows).collect()))
    assert len(steps) <= 6
    monkeypatch.setattr(communities.whole, "MOST_CENTS", 0)
    steps.clear()
    assert sorted(map(tuple, communities.louvain(merged, weight, hot_rows=hot_rows).collect())) == found and len(steps) > 20


def test_communities_are_split_where_they_fall_apart(spark):
    merged = graph.pairs(transactions(spark, block(1, 1) + block(2, 2) + [("CUS-x", "ACC-x", "7.00", 0.5)]))
    g = communities._graph(merged, "gross", 10)
    one = communities._singletons(g)
    one = communities._State(*[side.withColumn("label", F.when(F.col("id").rlike("x$"), "x").otherwise("both")) for side in (one.customers, one.accounts)])
    state, split = communities._connected(g, one)
    labels = {}
    for r in state.members().collect():
        labels.setdefault(r["label"], set()).add(r["id"].split("-")[1])
    assert split and sorted(map(sorted, labels.values())) == [["1"], ["2"], ["x"]]
    assert not communities._connected(g, state)[1]


def test_groups_move_on_from_group_to_group(spark):
    """Three communities in one group, of which one belongs to another group."""
    rows = block(1, 1) + block(2, 2) + block(3, 3) + block(4, 4) + [
        ("CUS-1-0", "ACC-2-0", "2000.00", 0.5), ("CUS-3-0", "ACC-4-0", "3000.00", 0.5)]
    g = communities._graph(graph.pairs(transactions(spark, rows)), "gross", 1000)
    edges = spark.createDataFrame(
        [("1", "2", Decimal(3680), Decimal(3680), Decimal(2000)), ("3", "4", Decimal(3680), Decimal(3680), Decimal(3000))],
        "a string, b string, ka decimal(38,2), kb decimal(38,2), w decimal(28,2)")
    groups = spark.createDataFrame([(n, "A" if n in "123" else "B", Decimal(3680)) for n in "1234"], "label string, root string, k decimal(38,2)")
    moved, any_moved = communities._move_on(g, edges, groups)
    found = {r["label"]: r["root"] for r in moved.collect()}
    assert any_moved and found["3"] == found["4"] != found["1"] == found["2"]


@pytest.mark.parametrize("block_rows", [1 << 22, 60])
def test_many_communities_move_in_few_turns(spark, monkeypatch, block_rows):
    """Forty communities of one group, each of which belongs with its partner in another group; in one block and in several."""
    steps = []
    monkeypatch.setattr(communities.turns, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(communities, "materialise", lambda df, name="step": steps.append(name) or materialise(df, name))
    rows = [r for n in range(80) for r in block(n, n, 1)]
    g = communities._graph(graph.pairs(transactions(spark, rows)), "gross", 10_000)
    k, w = Decimal(200), Decimal(50)
    edges = spark.createDataFrame([(f"{n:02}", f"{n + 40:02}", k, k, w) for n in range(40)],
                                  "a string, b string, ka decimal(38,2), kb decimal(38,2), w decimal(28,2)")
    groups = spark.createDataFrame([(f"{n:02}", "A" if n < 40 else f"{n:02}", k) for n in range(80)],
                                   "label string, root string, k decimal(38,2)")
    steps.clear()
    found = {r["label"]: r["root"] for r in communities._move_on(g, edges, groups)[0].collect()}
    apart = [n for n in range(40) if found[f"{n:02}"] != found[f"{n + 40:02}"]]
    assert apart == [] and len(steps) <= 50


def test_components_are_found_with_loops(spark):
    links = [("a", "b"), ("b", "c"), ("d", "d"), ("e", "f"), ("g", "f"), ("b", "b")]
    got = {r["node"]: r["component"] for r in graph_components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "e", "g": "e"}
    assert graph_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_modularity_by_hand(spark):
    merged = graph.pairs(transactions(spark, RINGS[:6]))
    part = graph.single_ring(merged)
    assert communities.modularity(merged, part).first()[0] == pytest.approx(0.0)


def test_neighbourhood_around_hot_nodes(spark):
    edges = spark.createDataFrame(
        [("CUS-1", "ACC-1"), ("CUS-2", "ACC-1"), ("CUS-2", "ACC-2"), ("CUS-3", "ACC-2"), ("CUS-4", "ACC-1")],
        "from string, to string")
    wanted = {"CUS-1": 0, "ACC-1": 1, "CUS-2": 2, "CUS-4": 2}
    for hot_rows in (1, 1000):
        found = {r["id"]: r["distance"] for r in graph.neighbourhood(edges, ["CUS-1"], hot_rows).collect()}
        assert found == wanted
    assert graph.neighbourhood(edges, ["CUS-99"]).count() == 0


def test_adjacency_reads_few_buckets(spark, tmp_path):
    edges = spark.createDataFrame([(f"CUS-{i}", f"ACC-{j}") for i in range(200) for j in (i % 40, (i * 7) % 40) if j] +
                                  [("CUS-x", "ACC-x"), ("CUS-y", "ACC-x"), ("CUS-y", "ACC-y")], "from string, to string")
    graph.write_adjacency(edges, "adjacency", 32, str(tmp_path / "adjacency"))
    stored = spark.table("adjacency")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # only then the plan shows the buckets
    plan = stored.where(F.col("id").isin(["CUS-x"]))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 32" in plan
    for seeds in (["CUS-x"], ["ACC-3", "CUS-y"], ["missing"], []):
        wanted = sorted(map(tuple, graph.neighbourhood(edges, seeds).collect())) if seeds else []
        for listed in (1000, 1):
            assert sorted(map(tuple, graph.neighbourhood_of(stored, seeds, hot_rows=3, listed=listed).collect())) == wanted
    spark.sql("DROP TABLE adjacency")


def test_selection(spark):
    merged = graph.pairs(transactions(spark, RINGS))
    nodes = graph.node_table(merged, graph.single_ring(merged))
    edges = graph.edge_table(merged)
    picked = graph.select_nodes(nodes, "degree", ["3"])
    assert {r["id"] for r in picked.collect()} == {"ACC-1", "ACC-2", "ACC-8", "ACC-9"}
    assert graph.select_nodes(nodes, "community", ["0"]).count() == 0
    ends = graph.select_by_edge(edges, "color", ["#f43f5e"])
    assert {r["id"] for r in ends.collect()} == {"CUS-1", "CUS-2", "CUS-3", "ACC-1", "ACC-2"}
    assert graph.restrict_nodes(nodes, ends).count() == 5
    assert graph.restrict_edges(edges, ends, hot_rows=1).count() == 6
    stats = {r["id"]: tuple(r)[1:] for r in graph.node_stats(edges).collect()}
    assert stats["ACC-8"] == (3, 0.4, 150.0)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_lookup_around_hot_keys(spark, how):
    facts = spark.range(300).select(
        F.when(F.col("id") < 200, "a").when(F.col("id") < 290, "b").otherwise("c").alias("k"), "id")
    dim = spark.createDataFrame([("a", 1), ("b", 2), ("d", 3)], "k string, v int")
    hot = hot_keys(facts.groupBy("k").agg(F.count("*").alias("rows")), "k", 20)
    assert {r["k"]: r["parts"] for r in hot.collect()} == {"a": 10, "b": 5}
    plain = sorted(map(tuple, lookup(facts, dim, "k", None, how).select("id").collect()))
    assert sorted(map(tuple, lookup(facts, dim, "k", hot, how).select("id").collect())) == plain


def test_a_partition_is_computed_once(spark):
    """Both ends and the sizes read the stored partition, whatever it costs to compute."""
    merged = graph.pairs(transactions(spark, RINGS))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def ring(name):
        seen.add(1)
        return int(name[-1]) // 5

    nodes = materialise(graph.ends(merged).select("id").distinct(), "nodes")
    part = nodes.withColumn("community", ring("id"))
    for show, rows in ((lambda: graph.ring_ledger(merged, part), 2), (lambda: graph.cross_ring_edges(graph.edge_table(merged), part), 0)):
        seen.value = 0
        assert len(show().collect()) == rows and seen.value == 10
