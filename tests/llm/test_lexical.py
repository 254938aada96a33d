"""Ranked search against scoring every pair, and edge cases."""

import collections
import math
import random
import re

import numpy as np
import pytest

from riskloom.llm import lexical, queries

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return TERM.findall((text or "").translate(LOWER))


def slow(docs, items, k=20):
    counts = [(i, collections.Counter(cut(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item in {i for i, t in items if i is not None and t is not None}:
        asked = collections.Counter(cut(min(t for i, t in items if i == item and t is not None)))
        found = []
        for doc_id, c in counts:
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t, r in asked.items() if c[t])
            if score > 0 and doc_id is not None:
                found.append((-score, doc_id))
        out += [(item, rank, d, -s) for rank, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def made(seed, n=300):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(12)], [f"Rare{i}" for i in range(150)] + ["été", "ÉTÉ", "naïve"]
    def text(size):
        return rng.choice((" ", "-", "\n", "\x7f")).join(rng.choice(common if rng.random() < .7 else rare) for _ in range(size))
    docs = [(i, text(rng.choice((1, 5, 30, 200)))) for i in rng.sample(range(-1000, 1000), n)]
    docs += [(2000 + i, docs[0][1]) for i in range(60)]  # copies: ties by id
    items = [(i, text(rng.choice((1, 4, 12)))) for i in range(25)] + [(100, docs[0][1]), (101, docs[5][1][:60])]
    return docs, items


@pytest.mark.parametrize("k,few", [(20, 32), (3, 2)])
def test_against_all_pairs(spark, monkeypatch, k, few):
    docs, items = made(k)
    monkeypatch.setattr(lexical, "TREE_DOCS", 100)
    monkeypatch.setattr(lexical, "FEW_DOCS", few)
    monkeypatch.setattr(lexical, "WALK_PAIRS", 60)
    monkeypatch.setattr(lexical, "PASS_PAIRS", 90)
    monkeypatch.setattr(lexical, "WAITING", 50)
    got = lexical.rank_documents(spark.createDataFrame(docs, "doc_id int, text string").repartition(3),
                                 spark.createDataFrame(items, "item_id bigint, text string"), k)
    assert sorted(map(tuple, got.collect())) == slow(docs, items, k)


def test_edges_and_clashing_columns(spark):
    docs = [(None, "apple pear"), (None, None), (3, None), (4, ""), (5, " -- \n"), (6, "Apple"), (7, "apple"), (7, "apple"),
            (8, "pear " * 40_000), (9, "x" * 100_000), (10, "Äpfel äpfel")]
    items = [(None, "apple"), (1, None), (2, ""), (3, "!!"), (4, "apple"), (4, "zebra"), (5, "APPLE pear pear"), (6, "Äpfel"),
             (7, "unknown"), (8, "x" * 100_000)]
    d = spark.createDataFrame([(*r, 1, "t", 2, b"s") for r in docs],
                              "doc_id bigint, text string, n int, terms string, rank int, score binary")
    i = spark.createDataFrame([(*r, 1, "t") for r in items], "item_id bigint, text string, term int, repeats string")
    assert sorted(map(tuple, lexical.rank_documents(d, i).collect())) == slow(docs, items)
    for a, b in ((d.limit(0), i), (d, i.limit(0)), (d.limit(0), i.limit(0))):
        empty = lexical.rank_documents(a, b)
        assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.collect() == []


def test_branches_are_left_out():
    """Documents that share nothing with an item are not scored for it, and later blocks meet a bar."""
    rng = np.random.default_rng(1)
    n, terms = 4000, 40
    places = np.sort(np.argsort(rng.random((n, terms)), axis=1)[:, :6], axis=1).reshape(-1)
    starts = np.arange(0, 6 * n + 1, 6)
    tfs, m = rng.integers(1, 4, 6 * n), rng.integers(80, 200, n)
    weight = np.arange(terms)[::-1] * 50 + 1
    groups = lexical.asked_groups(np.repeat([0, 1], 3), np.array([1, 2, 3, 30, 38, 39]), np.ones(6, np.int64), weight)
    best = lexical.Best(2, 5)
    first = lexical.walk(np.arange(n), m, starts, places, tfs, np.arange(terms), groups, best, 32)
    assert first < n
    best.merge()
    again = lexical.walk(np.arange(n) + n, m + 40, starts, places, tfs, np.arange(terms), groups, best, 32)
    assert again < first


def test_trie_orders_documents_and_covers_all():
    rng = random.Random(2)
    texts = [np.array(sorted(rng.sample(range(30), rng.randrange(1, 9))), ">u4").tobytes() for _ in range(500)]
    texts += [texts[0]] * 300 + [np.arange(i, dtype=">u4").tobytes() for i in range(1, 200)]
    order, root = lexical.trie(texts, 8)
    assert sorted(order.tolist()) == list(range(len(texts)))
    assert [texts[i] for i in order] == sorted(texts)
    depth, level = 0, [root]
    while level:
        depth += 1
        for node in level:
            if node.children:
                assert [c.first for c in node.children][1:] == [c.last for c in node.children][:-1]
                assert (node.children[0].first, node.children[-1].last) == (node.first, node.last)
            else:
                assert node.last - node.first <= 8
        level = [c for node in level for c in node.children]
    assert depth <= 12


def test_registered_query(spark, tmp_path):
    docs, items = made(9, 60)
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.queries()["op12_fp_tree_search"](spark, str(tmp_path))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == slow(docs, items)
