"""Operators on tables of documents, pages and vectors, against brute force and on edge cases."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from riskloom.llm import mixing, neardup, packing, sharding, topk, warc
from riskloom.llm.common import with_words

PAGES = "page_id bigint, url string, html string, digest string"


def test_warc_round_trip_and_revisits(spark, tmp_path):
    big, small = "<p>" + "é" * 200, "tiny"
    rows = [(3, "u3", big), (1, "u1\r\n%0A", big), (2, None, big), (4, "u4", small), (5, "u5", small), (6, "u6", None),
            (7, "u7", ""), (None, "n", big), (8, "u8", "x" * 100), (9, "u9", "x" * 100), (10, "u", "y" * 99), (11, "u", "y" * 99),
            (12, "a", "z" * 500_000), (13, "r", "twice" * 40), (13, "r", "twice" * 40)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], PAGES).repartition(3)
    got = warc.read_archives(warc.write_archives(pages, f"file:{tmp_path}/w"), range_bytes=700).collect()
    assert len(got) == len(rows)
    html = collections.defaultdict(list)
    for i, u, h in rows:
        html[i, u].append((h or "").encode())
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h] = min(i, first.get(h, i))
    for r in got:
        payload = html[r.page_id, r.url][0]
        assert r.payload_bytes == len(payload) and r.payload_digest == hashlib.sha256(payload).hexdigest()
        revisit = len(payload) >= 100 and r.page_id != first[payload.decode()]
        assert (r.record_type, r.refers_to) == (("revisit", first[payload.decode()]) if revisit else ("response", None))
        assert r.payload == (None if revisit else payload)
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("step", [1, 13, 100, 4096])
def test_every_record_has_one_owner(step, tmp_path):
    rng = random.Random(step)
    records = [warc.encode_record(i, "u", "response", None, "d", rng.randbytes(rng.randrange(300)) + warc.GZIP_MAGIC * 3)
               for i in range(30)]
    data = b"junk\x1f\x8b\x08" + b"".join(records[:15]) + warc.GZIP_MAGIC + b"noise" + b"".join(records[15:])
    path = str(tmp_path / "a.warc.gz")
    (tmp_path / "a.warc.gz").write_bytes(data)
    with pafs.LocalFileSystem().open_input_file(path) as source:
        found = [r["X-Page-ID"] for s in range(0, len(data), step)
                 for _, r in warc.records_in(source, len(data), s, min(s + step, len(data)))]
    assert found == [str(i) for i in range(30)]
    assert zlib.decompressobj(31).decompress(records[0]).startswith(warc.VERSION)


def check_packed(rows, capacity, pieces):
    by_bin, by_doc = collections.defaultdict(list), collections.Counter()
    for p in pieces:
        by_doc[p.doc_id] += p.words
        if p.bin is None:
            assert p.words == 0
        else:
            by_bin[p.bin].append(p)
    want = collections.Counter()
    for i, _, _, n in rows:
        want[i] += n or 0
    assert {k: v for k, v in by_doc.items() if v} == {k: v for k, v in want.items() if v}
    assert set(by_doc) == set(want)
    facts = {i: (s, c) for i, s, c, _ in rows}
    for some in by_bin.values():
        some.sort(key=lambda p: p.offset)
        assert all(a.offset + a.words == b.offset for a, b in zip(some, some[1:])) and some[0].offset == 0
        assert some[-1].offset + some[-1].words <= capacity
        sources = [facts[p.doc_id][0] for p in some]
        clusters = [facts[p.doc_id][1] for p in some if facts[p.doc_id][1] is not None]
        assert len(set(sources)) == len(sources) and len(set(clusters)) == len(clusters)


def test_packing_keeps_every_word_and_all_conflicts_apart(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["hot", "hot", "a", "b", "c", None]), rng.choice([None, 1, 2, i]), rng.choice([0, None, 5, 64, 65, 700, rng.randrange(64)]))
            for i in range(300)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, source string, cluster bigint, size bigint, pack int")
    check_packed(rows, 64, packing.pack(df, 64, pack_rows=100).collect())
    assert packing.pack(df.limit(0)).count() == 0
    twice = df.where("doc_id = 1").withColumn("size", F.lit(5)).withColumn("cluster", F.lit(1))
    pieces = packing.pack(twice.unionByName(twice)).collect()
    assert len(pieces) == 2 and len({p.bin for p in pieces}) == 2


def test_best_fit_takes_the_tightest_compatible_bin():
    for seed in range(150):
        rng = random.Random(seed)
        capacity = rng.choice([1, 7, 50, 64])
        sizes = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 120))), reverse=True)
        sources = [rng.choice(["a", "a", "a", "b", "c", None]) for _ in sizes]
        clusters = [rng.randrange(20) if rng.random() < 0.7 else None for _ in sizes]
        bins = []
        for n, s, c, (b, at) in zip(sizes, sources, clusters, packing.best_fit(sizes, sources, clusters, capacity)):
            fits = [i for i, (left, ss, cc) in enumerate(bins) if left >= n and s not in ss and (c is None or c not in cc)]
            if not fits:
                assert (b, at) == (len(bins), 0)
                bins.append([capacity, set(), set()])
            else:
                tightest = min(bins[i][0] for i in fits)
                assert b in fits and bins[b][0] == tightest and at == capacity - tightest
            bins[b][0] -= n
            bins[b][1].add(s)
            bins[b][2].add(c)


def brute_shards(rows, limit):
    hashed = [(i, int(hashlib.md5(b"" if i is None else str(i).encode()).hexdigest()[:15], 16), n or 0) for i, n in rows]
    sums = collections.defaultdict(lambda: [0, 0])
    for _, h, n in hashed:
        for depth in range(61):
            sums[depth, h >> 60 - depth][0] += n
            sums[depth, h >> 60 - depth][1] += 1
    out = []
    for i, h, n in hashed:
        depth = next((d for d in range(61) if sums[d, h >> 60 - d][0] <= limit or sums[d, h >> 60 - d][1] == 1), None)
        out.append((-1 if i is None else i, depth))
    return sorted(out)


def test_shards_are_the_shortest_prefixes_that_fit(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([0, 10, 100, None, rng.randrange(3000)])) for i in range(500)] + [(None, 3), (900, 50_000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, bytes bigint, cell string")
    for limit in (100, 3000, 10**9):
        got = sharding.shards(df.withColumn("hash", sharding.hash_bits("doc_id")), limit).collect()
        assert {r.cell for r in got} == {"c"}
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.depth) for r in got) == brute_shards(rows, limit)
        sizes = collections.Counter()
        for r in got:
            sizes[r.shard] += r.bytes
            assert len(r.shard) == r.depth
        assert all(sizes[r.shard] == r.shard_bytes and (r.shard_bytes <= limit or r.shard_rows == 1) for r in got)
    empty = df.limit(0).withColumn("hash", sharding.hash_bits("doc_id"))
    assert sharding.shards(empty, 100).count() == 0


def test_repeated_ids_are_cut_by_running_total(spark):
    rows = [(7, 30)] * 40 + [(None, 100)] * 3 + [(8, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, bytes bigint").withColumn("hash", sharding.hash_bits("doc_id"))
    got = sharding.shards(df, 100).collect()
    assert len(got) == 44
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard] += r.bytes
    assert all(v <= 100 for v in sizes.values()) and all(sizes[r.shard] == r.shard_bytes for r in got)


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.12, 16)]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2001, [0.0] * 15 + [float("nan")]), (2002, [0.0] * 15 + [None]), (None, rows[1][1]),
             (2100, [0.5, float("inf")] + [0.0] * 14), (2200, [0.0] * 16), (5, rows[5][1]), (2300, [0.1, 0.2]), (2301, [0.3, 0.1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, id int")
    vectors = topk.integers(df)
    got = topk.top_k(vectors, vectors.where("id % 100 = 0"), 10).collect()
    usable = [(i, np.floor(np.float32(v).astype(np.float64) * 1024)) for i, v in rows
              if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for q in sorted({i for i, _ in usable if i % 100 == 0}):
        own = dict(usable)[q]
        best = sorted((-int(own @ v), i) for i, v in usable if i != q and len(v) == len(own))[:10]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(vectors, vectors.limit(0)).count() == 0 and topk.top_k(vectors.limit(0), vectors).count() == 0


def test_top_k_blocks_and_proof(monkeypatch, spark):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 16)
    rng = np.random.default_rng(10)
    rows = [(int(i), [int(x) for x in rng.normal(0, 130, 8)]) for i in range(500)]
    vectors = spark.createDataFrame(rows, "id bigint, v array<bigint>")
    got = topk.top_k(vectors, vectors.where("id % 10 = 0"), 3).collect()
    matrix = np.array([v for _, v in rows])
    scores = matrix @ matrix.T
    want = [(q, r, i, s) for q in range(0, 500, 10)
            for r, (s, i) in enumerate(sorted(((int(scores[q, i]), i) for i in range(500) if i != q), key=lambda x: (-x[0], x[1]))[:3], 1)]
    assert sorted(map(tuple, got)) == want


def brute_groups(texts, similar=0.8):
    split = [tuple((t or "").encode().lower().split()) for t in texts]
    bags = [collections.Counter(zip(*[w[i:] for i in range(5)])) for w in split]
    group = list(range(len(texts)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = sum((bags[a] & bags[b]).values())
            union = sum(bags[a].values()) + sum(bags[b].values()) - both
            if (split[a] and split[a] == split[b]) or (both and both >= similar * union):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return [root(i) for i in range(len(texts))]


def near_texts(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(n):
        words = [word() for _ in range(rng.randrange(0, 120))]
        texts.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 3])):
            changed = list(words)
            for _ in range(rng.randrange(0, 4)):
                if changed:
                    changed[rng.randrange(len(changed))] = word()
            texts.append(" ".join(changed).upper() if rng.random() < 0.3 else " ".join(changed))
    texts += ["one two three", "One  two three", "one two four", "", "", None, None, "la " * 400, "la " * 390, "la " * 300]
    return texts


def test_groups_match_brute_force(spark):
    texts = near_texts(11)
    rows = [(i, t, b"x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, node binary").repartition(3)
    got = {r.doc_id: r for r in neardup.groups(docs).collect()}
    assert [got[i].group_id for i in range(len(texts))] == brute_groups(texts)
    kept = {r.doc_id for r in neardup.deduplicate(docs.drop("node").withColumns({"bands": F.lit(1), "_node": F.lit("x"), "_ID": F.lit(2)})).collect()}
    assert kept == {i for i in range(len(texts)) if got[i].group_id == i}


def test_crowded_buckets_are_settled(spark):
    # Every text shares a long passage, so whole buckets hold texts that are no duplicates.
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(40):
        words = passage + [word() for _ in range(rng.choice([12, 16, 20, 60]))]
        texts.append(" ".join(words))
        if rng.random() < 0.4:
            texts.append(" ".join([*words, word()]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = brute_groups(texts)
    for listed in (1, 16):
        got = {r.doc_id: r.group_id for r in neardup.groups(docs, listed=listed).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_components_match_union_find(spark):
    rng = random.Random(14)
    path = [(1, 5), (5, 3), (3, 6), (6, 2)]  # after one round no centre is a leaf, but 3 has two centres
    order = rng.sample(range(30), 30)
    graphs = [path, list(zip(order, order[1:])), [(10, 11), (12, 10), *path]]
    graphs += [[tuple(rng.sample(range(25), 2)) for _ in range(20)] for _ in range(2)]
    for links in graphs:
        root = {x: x for link in links for x in link}
        for _ in root:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        got = neardup.components(spark.createDataFrame(links, "a int, b int")).collect()
        assert sorted((r.node, r.component) for r in got) == sorted(root.items())


def test_groups_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (6, "x y"), (6, "x y"), (6, "p q r s t u"),
            (None, "only null ids here ok"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((str(r.doc_id), str(r.group_id), r.copies) for r in neardup.groups(docs).collect())
    assert got == sorted([("None", "5", 3), ("None", "5", 3), ("5", "5", 3), ("6", "6", 2), ("6", "6", 2), ("6", "6", 1),
                          ("None", "None", 1), ("None", "None", 1)])
    kept = sorted((str(r.doc_id), str(r.text)) for r in neardup.deduplicate(docs).collect())
    assert kept == sorted([("5", "a b c d e f"), ("6", "x y"), ("6", "p q r s t u"), ("None", "only null ids here ok"), ("None", "None")])
    assert neardup.groups(docs.limit(0)).count() == 0 and neardup.deduplicate(docs.limit(0)).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(13)
    keys = rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
    some = lambda w: (keys[w > 0], w[w > 0])
    h, w = (np.concatenate(x) for x in zip(some(a), some(b)))
    docs = np.repeat([0, 1], [np.count_nonzero(a), np.count_nonzero(b)])
    registers = neardup.signatures(h, w, docs, 2, 4096)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((registers[0] == registers[1]).mean() - want) < 0.03


def test_mix_meets_targets(spark):
    rng = random.Random(14)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)) or None, rng.choice(["hot"] * 5 + ["b", "c", None, "Z", "é"])) for i in range(800)]
    rows += [(9000, "big " * 20, "tiny"), (9001, "", "void"), (9001, "", "void")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, block int")
    sized = with_words(mixing.keyed(docs))
    made = mixing.plan(sized, block_words=200, shard_blocks=4)
    got = mixing.apply_plan(sized, made).collect()
    again = mixing.apply_plan(sized.repartition(3), mixing.plan(sized.repartition(5), block_words=200, shard_blocks=4)).collect()
    assert sorted((r.doc_id, r.copies, r.shards) for r in got) == sorted((r.doc_id, r.copies, r.shards) for r in again)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    names = sorted(s for s in sizes if s is not None) + [None]
    goal = dict(zip(names, mixing.targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], sum(sizes.values()))))
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.copies <= 3 and len(r.shards) == r.copies
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6
        taken[r.source] += r.copies * r.size
    assert len(got) == len(rows)
    assert all(abs(taken[s] - goal[s]) <= max(15, 0.02 * goal[s]) for s in names), (taken, goal)
    listed = mixing.listing(mixing.apply_plan(sized, made)).collect()
    assert len(listed) == sum(r.copies for r in got)
    by_shard = collections.defaultdict(list)
    for r in listed:
        by_shard[r.shard].append(r.position)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in by_shard.values()) and len(by_shard) > 3
    assert mixing.apply_plan(sized.limit(0), mixing.plan(sized.limit(0))).count() == 0


def test_targets_reshare_the_excess():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 300) == [187.5, 75.0, 37.5]
    assert mixing.targets([10, 100, 100], [5, 2, 1], 210) == [30.0, 120.0, 60.0]
    assert mixing.targets([0, 10], [5, 2], 10) == [0.0, 10.0] and mixing.targets([], [], 0) == []


def test_tree_deals_every_block_once():
    tree = mixing.Tree([100, 7, 0, 40], 9)
    dealt = collections.Counter(tree.shard(s, n) for s, q in enumerate([100, 7, 0, 40]) for n in range(q))
    assert sorted(dealt) == list(range(9)) and all(16 <= v <= 17 for v in dealt.values())
    other = mixing.Tree([100, 7, 0, 40], 9)
    assert all(other.shard(0, n) == tree.shard(0, n) for n in reversed(range(100)))
