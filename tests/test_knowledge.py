import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import text
from riskloom.operators import knowledge, lists, search
from riskloom.plans.pipelines import build_knowledge_base
from riskloom.sources import corpus


def packed(content, limit, separator=r"\n\s*\n"):
    """An independent fold over paragraphs."""
    groups, words = [], 0
    for part in (p.strip() for p in re.split(separator, content)):
        size = len(part.split())
        if not size:
            continue
        if groups and words + size <= limit:
            groups[-1].append(part)
            words += size
        else:
            groups.append([part])
            words = size
    return ["\n\n".join(g) for g in groups]


def odd_texts():
    rng = random.Random(2)
    spaces = [" ", "\t", "\u00a0", "\u2003", "\u3000", "\x1c", "\x1f", "\x85", "\r", "  "]
    breaks = ["\n\n", "\n \n", "\n\u2003\n", "\n", "\n\n\n", "\n\x1d\n"]
    texts = ["", "   ", "\n\n\n", "one", "a b c d e f g h i j", "\n\nx\n\n", "\u00a0lead and trail\u2003"]
    for _ in range(80):
        pieces = []
        for _ in range(rng.randrange(1, 25)):
            pieces.append(rng.choice(["w", "wort", "ß", "слово", "字"]))
            pieces.append(rng.choice(breaks) if rng.random() < 0.25 else rng.choice(spaces))
        texts.append("".join(pieces))
    return texts


@pytest.mark.parametrize("limit", [1, 4, 300])
def test_chunks_match_independent_fold(spark, limit):
    texts = odd_texts()
    docs = spark.createDataFrame([(f"d{i:03d}", t) for i, t in enumerate(texts)], "filename string, content string")
    found = {}
    for r in knowledge.chunk_documents(docs, limit).orderBy("filename", "position").collect():
        found.setdefault(r["filename"], []).append(r["content"])
    for i, t in enumerate(texts):
        assert found.get(f"d{i:03d}", []) == packed(t, limit), repr(t)
    sizes = {r["filename"]: r["words"] for r in knowledge.document_words(docs).collect()}
    assert sizes == {f"d{i:03d}": len(t.split()) for i, t in enumerate(texts)}


def test_chunk_numbers_follow_file_order(spark):
    docs = spark.createDataFrame(
        [("b.txt", "1\n\n2\n\n3"), ("a.txt", "4\n\n5"), ("c.txt", " "), ("d.txt", "6")],
        "filename string, content string").repartition(4)
    rows = sorted(tuple(r) for r in knowledge.chunk_table(docs, 1).collect())
    assert rows == [("chunk_0000", "4", "a.txt"), ("chunk_0001", "5", "a.txt"), ("chunk_0002", "1", "b.txt"),
                    ("chunk_0003", "2", "b.txt"), ("chunk_0004", "3", "b.txt"), ("chunk_0005", "6", "d.txt")]
    chunks = knowledge.chunk_table(docs, 1)
    counts = {r["filename"]: r["chunk_count"] for r in knowledge.document_chunks(docs, chunks).collect()}
    assert counts == {"a.txt": 2, "b.txt": 3, "c.txt": 0, "d.txt": 1}
    assert tuple(knowledge.corpus_stats(docs, 1).first()) == (4, 6, 6)


def test_equal_names_are_different_documents(spark):
    docs = spark.createDataFrame([("x/a.txt", "a.txt", "1\n\n2"), ("a.txt", "a.txt", "3\n\n4"), ("b", "a.txt", "3\n\n4")],
                                 "path string, filename string, content string").repartition(3)
    rows = sorted(tuple(r) for r in knowledge.chunk_table(docs, 1).collect())
    assert rows == [(f"chunk_000{i}", c, "a.txt") for i, c in enumerate("343412")]
    same = sorted(r["chunk_id"] for r in knowledge.chunk_table(docs.drop("path"), 1).collect())
    assert same == [f"chunk_000{i}" for i in range(6)]


def test_hashed_words_match_a_plain_count(spark):
    texts = ["a b a", "", "  ", "é\u00a0x x", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    for r in knowledge.embed(rows).collect():
        if r["content"] is None:
            assert r["embedding"] is None and r["embedding_status"] == "ValueError: no text"
            continue
        counts = np.zeros(64)
        for w in r["content"].split():
            counts[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
        length = np.linalg.norm(counts)
        assert r["embedding_status"] == "" and np.allclose(r["embedding"], counts / length if length else counts)


def test_large_document_stays_linear(spark):
    content = "\n\n".join(f"word{i} and more" for i in range(30_000))
    docs = spark.createDataFrame([("big.txt", content)], "filename string, content string")
    chunks = knowledge.chunk_documents(docs, 30)
    assert chunks.count() == 3_000


def test_embedding_status(spark):
    def picky(texts, task_type):
        if any("bad" in t for t in texts):
            raise RuntimeError("refused")
        return np.ones((len(texts), 3)) * len(task_type)

    rows = spark.createDataFrame([("a", "good"), ("b", "bad"), ("c", None), ("d", "fine")], "id string, content string")
    out = {r["id"]: r for r in knowledge.embed(rows.coalesce(1), picky, "ABCD").collect()}
    assert list(out["a"]["embedding"]) == [4.0, 4.0, 4.0] and out["a"]["embedding_status"] == ""
    assert out["b"]["embedding"] is None and out["b"]["embedding_status"] == "RuntimeError: refused"
    assert out["c"]["embedding_status"] == "ValueError: no text"
    assert out["d"]["embedding_status"] == ""
    assert knowledge.embedding_error_count(knowledge.embed(rows, picky)).first()[0] == 2


def vectors(spark, rows, name="id"):
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>")


def brute(base, queries, k):
    out = {}
    for q, v in queries:
        v = np.asarray(v, "float32").astype("float64")
        scored = []
        for b, w in base:
            w = np.asarray(w, "float32").astype("float64")
            length = np.linalg.norm(v) * np.linalg.norm(w)
            if length:
                scored.append((round(1 - float(v @ w) / length, 9), b))
        out[q] = [b for _, b in sorted(scored)[:k]]
    return out


def hits(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def test_search_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    base = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    base += [(1000 + i, base[7][1]) for i in range(6)] + [(2000, [0.0] * 8)]
    queries = [(i, rng.normal(size=8).tolist()) for i in range(30)] + [(50, base[7][1]), (60, [0.0] * 8)]
    wanted = {q: ids for q, ids in brute(base, queries, 5).items() if ids}
    b, q = vectors(spark, base).repartition(5), vectors(spark, queries, "query_id")
    assert hits(search.vector_search(b, q)) == wanted
    assert wanted[50] == [7, 1000, 1001, 1002, 1003]
    assert hits(search.block_search(b, q, block_floats=80)) == wanted
    assert hits(search.list_search(b, q, probes=5, block_floats=160)) == wanted
    near = hits(search.list_search(b, q, probes=3))
    found = sum(len(set(near[k]) & set(v)) for k, v in wanted.items())
    assert found / sum(map(len, wanted.values())) > 0.7


def test_search_small_and_empty(spark):
    base = vectors(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])])
    one = vectors(spark, [(9, [1.0, 1.0])], "query_id")
    assert hits(search.vector_search(base, one)) == {9: [1, 2]}
    assert search.vector_search(vectors(spark, []), one).count() == 0
    assert search.vector_search(base, vectors(spark, [], "query_id")).count() == 0


def test_tasks_return_the_nearest_of_all_their_rows(spark):
    rng = np.random.default_rng(6)
    base = vectors(spark, [(i, rng.normal(size=6).tolist()) for i in range(600)]).repartition(3)
    queries = vectors(spark, [(i, rng.normal(size=6).tolist()) for i in range(20)], "query_id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")  # several batches a task
    try:
        found = search.task_hits(base, queries, 4)
        assert found.count() == 3 * 20 * 4
        assert hits(search.vector_search(base, queries, 4)) == hits(search.block_search(base, queries, 4))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_passes_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = vectors(spark, [(i, rng.normal(size=5).tolist()) for i in range(100)])
    queries = base.withColumnRenamed("id", "query_id")
    wanted = hits(search.vector_search(base, queries, 3))
    monkeypatch.setattr(search, "PASS_QUERIES", 40)
    monkeypatch.setattr(lists, "PASS_QUERIES", 40)
    assert hits(search.vector_search(base, queries, 3)) == wanted
    assert hits(lists.search_index(lists.build_index(base), queries, 3, share=None)) == wanted


def test_a_pass_is_bounded_in_memory():
    """What a task keeps for the queries of one pass, of 64 dimensions and five rows each."""
    assert lists.PASS_QUERIES == search.PASS_QUERIES
    running = search._Running(np.arange(search.PASS_QUERIES), np.ones((search.PASS_QUERIES, 64)), 5)
    assert running.query.nbytes + 2 * running.distance.nbytes + running.bar.nbytes + running.keys.nbytes <= 64 << 20


def test_far_blocks_are_skipped():
    rng = np.random.default_rng(8)
    near, far = search._unit(rng.normal(size=(50, 8)) * .1 + 5), search._unit(rng.normal(size=(50, 8)) * .1 - 5)
    running = search._Running(np.arange(10), near[:10], 3)
    assert not search._beyond(near[:10], running.distance[:, -1].clip(max=2.1), far).any()
    running.meet(np.arange(50), near)
    assert search._beyond(running.query, running.distance[:, -1], far).all()


def clustered(n, centres=40, width=16, spread=.08, seed=9):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, width))
    return [(i, (middle[i % centres if i > n // 3 else 0] + spread * rng.normal(size=width)).tolist()) for i in range(n)]


def test_index_reads_a_quarter_and_finds_nine_of_ten(spark):
    rows = clustered(2000)  # one cluster holds more than a third of all rows
    base = vectors(spark, rows)
    queries = vectors(spark, rows[::7], "query_id")
    index = lists.build_index(base)
    assert index.rows.count() == 2000 and index.lists.count() >= 30
    assert index.lists.agg(F.sum("rows")).first()[0] == 2000
    assert index.lists.agg(F.max("rows")).first()[0] < 600  # the dominant cluster is in many lists
    exact = hits(search.vector_search(base, queries))
    near = hits(lists.search_index(index, queries, share=0.25))
    found = sum(len(set(near[q]) & set(ids)) for q, ids in exact.items())
    assert found >= 0.9 * sum(map(len, exact.values()))
    assert hits(lists.search_index(index, queries, share=None)) == exact


def test_radius_holds_all_rows_of_a_list(spark):
    rows = clustered(400, 10) + [(1000, [0.0] * 16), (1001, None)] + [(2000 + i, [1.0] * 16) for i in range(30)]
    index = lists.build_index(vectors(spark, rows))
    known = {r["list"]: r for r in index.lists.collect()}
    seen = 0
    for r in index.rows.collect():
        centre, v = (search._unit([x])[0] for x in (known[r["list"]]["centroid"], r["embedding"]))
        assert np.arccos(np.clip(centre @ v, -1, 1)) <= known[r["list"]]["radius"] + 1e-9
        seen += 1
    assert seen == index.total == 430


def test_index_of_few_and_no_rows(spark):
    one = vectors(spark, [(9, [1.0, 1.0]), (8, [0.0, 0.0]), (7, None)], "query_id")
    few = lists.build_index(vectors(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])]))
    for share in (None, 1.0):
        assert hits(lists.search_index(few, one, share=share)) == {9: [1, 2]}
        assert lists.search_index(few, one.limit(0), share=share).count() == 0
        assert lists.search_index(lists.build_index(vectors(spark, [])), one, share=share).count() == 0


def test_context(spark):
    chunks = spark.createDataFrame(
        [("c1", "x", "a.txt"), ("c2", "y", "b.txt"), ("c3", "z", "a.txt")],
        "chunk_id string, content string, filename string")
    found = spark.createDataFrame([("q", "c2", 1), ("q", "c1", 2), ("q", "c3", 3)], "query_id string, id string, rank int")
    asked = spark.createDataFrame([("q", "?"), ("none", "?")], "query_id string, query string")
    rows = {r["query_id"]: r for r in search.assemble_context(asked, found, chunks).collect()}
    assert rows["q"]["context"] == "[Source: b.txt]\ny\n\n---\n\n[Source: a.txt]\nx\n\n---\n\n[Source: a.txt]\nz"
    assert rows["q"]["sources"] == ["b.txt", "a.txt"]
    assert rows["none"]["context"].startswith("No relevant context") and rows["none"]["sources"] == []


def test_context_through_an_index(spark):
    texts = ["wire transfers of accounts", "card purchases abroad", "shell companies and layers", "wire fraud in accounts"]
    chunks = spark.createDataFrame([(f"c{i}", t, f"f{i}.txt") for i, t in enumerate(texts)], "chunk_id string, content string, filename string")
    embedded = knowledge.embed(chunks)
    asked = spark.createDataFrame([("q1", "wire accounts"), ("q2", "card purchases"), ("q3", " ")], "query_id string, query string")
    index = lists.build_index(embedded.select(F.col("chunk_id").alias("id"), "embedding"), lists=1)
    plain = sorted(map(str, search.retrieve_context(asked, embedded, 2).collect()))
    assert sorted(map(str, search.retrieve_context(asked, embedded, 2, lists=index).collect())) == plain


def test_texts_of_a_base_are_read_by_few_tasks(spark, tmp_path):
    """Neither tasks nor what the driver knows of them grow with every file."""
    texts = spark.createDataFrame([(f"n{i}", f"word{i} and more") for i in range(400)], "name string, content string")
    corpus.write_text_corpus(texts, str(tmp_path / "texts"))
    docs = corpus.read_text_corpus(spark, str(tmp_path / "texts"))
    assert docs.rdd.getNumPartitions() == 1 and len(docs.inputFiles()) < 300
    base = build_knowledge_base(docs, str(tmp_path / "base"), 60, "\n", lists=2)
    assert base.chunks.count() == base.lists[0].count() == 400 and base.chunks.select("content").distinct().count() == 400


def test_lists_on_disk(spark, tmp_path):
    rng = np.random.default_rng(1)
    base = vectors(spark, [(i, rng.normal(size=4).tolist()) for i in range(60)])
    centroids = search.write_lists(base, str(tmp_path / "lists"), 3)
    stored = spark.read.parquet(str(tmp_path / "lists"))
    queries = base.withColumnRenamed("id", "query_id")
    assert hits(search.search_lists(stored, centroids, queries, probes=3)) == hits(search.vector_search(base, queries))
    assert len(centroids) == 3 and stored.count() == 60 and stored.select("list").distinct().count() == 3


def test_space_class():
    spaces = [c for c in map(chr, range(0x11000)) if c.isspace()]
    pattern = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\u" + m[1].rjust(4, "0"), text.SPACE))
    assert [c for c in map(chr, range(0x11000)) if pattern.fullmatch(c)] == spaces


def test_single_precision_loses_no_neighbour():
    """Rows nearer to each other than single precision tells apart, copies, and rows without a direction."""
    rng = np.random.default_rng(12)
    base = np.repeat(rng.normal(size=(1, 24)), 5000, axis=0) + 1e-5 * rng.normal(size=(5000, 24))
    base[1000:3000], base[40] = base[999], 0.0
    base, query = search._unit(base), search._unit(np.vstack([base[::500], rng.normal(size=(700, 24)), np.zeros((1, 24))]))
    running = search._Running(np.arange(len(query)), query, 5)
    for i in range(0, 5000, 2500):
        running.meet(np.arange(i, i + 2500), base[i:i + 2500])
    found = next(running.hits()).groupby("query_id")["id"].agg(set)
    distance = np.round(1.0 - query @ base.T, search.DIGITS)
    for i in range(len(query) - 1):
        order = np.lexsort((np.arange(5000), distance[i]))[:5]
        # A product of another shape may round the last digit the other way.
        assert np.allclose(sorted(distance[i][list(found[i])]), distance[i][order], atol=2e-9)
    assert len(query) - 1 not in found


def test_blocks_measure_few_pairs(monkeypatch):
    """Once the nearest rows are known, only pairs that can be among them are measured in double precision."""
    rng, measured, einsum = np.random.default_rng(13), [], np.einsum
    monkeypatch.setattr(np, "einsum", lambda *a: measured.append(len(a[1])) or einsum(*a))
    base, query = search._unit(rng.normal(size=(20_000, 32))), search._unit(rng.normal(size=(600, 32)))
    running = search._Running(np.arange(600), query, 5)
    for i in range(0, 20_000, 5_000):
        running.meet(np.arange(i, i + 5_000), base[i:i + 5_000])
    assert 0 < sum(measured) < 600 * 20_000 / 100


def test_lists_are_scanned_in_place(spark, tmp_path):
    """No row of the base or of the queries is shuffled or repeated, only hits are."""
    rng = np.random.default_rng(14)
    base = vectors(spark, [(i, rng.normal(size=6).tolist()) for i in range(300)])
    queries = vectors(spark, [(i, rng.normal(size=6).tolist()) for i in range(40)] + [(99, [0.0] * 6), (98, None)], "query_id")
    centroids = search.write_lists(base, str(tmp_path / "lists"), 4)
    found = search.search_lists(spark.read.parquet(str(tmp_path / "lists")), centroids, queries, 3, probes=4, block_floats=60)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "FlatMapCoGroups" not in plan and "Join" not in plan
    assert hits(found) == hits(search.vector_search(base, queries, 3))
    two = hits(search.search_lists(spark.read.parquet(str(tmp_path / "lists")), centroids, queries, 3, probes=2))
    listed = {r["id"]: r["list"] for r in spark.read.parquet(str(tmp_path / "lists")).collect()}
    probed = {r["query_id"]: set(r["lists"]) for r in search.nearest_lists(queries.where("query_id < 98"), centroids, 2).collect()}
    assert all(listed[i] in probed[q] for q, ids in two.items() for i in ids) and set(two) == set(probed)


def test_blocks_are_shuffled_in_bands(spark, monkeypatch):
    """Small blocks do not repeat a row more often than its band asks for."""
    rng = np.random.default_rng(15)
    base = vectors(spark, [(i, rng.normal(size=4).tolist()) for i in range(600)])
    queries = base.withColumnRenamed("id", "query_id")
    seen, explode = [], F.sequence
    monkeypatch.setattr(search.F, "sequence", lambda low, high: seen.append(str(high)) or explode(low, high))
    found = hits(search.block_search(base, queries, 3, block_floats=40))  # 60 blocks a side
    bands = math.ceil(math.sqrt(spark.sparkContext.defaultParallelism))
    assert len(seen) == 2 and all(str(bands - 1) in s for s in seen)
    monkeypatch.setattr(search, "BAND_ROWS", 100)
    assert hits(search.block_search(base, queries, 3, block_floats=40)) == found == hits(search.vector_search(base, queries, 3))
