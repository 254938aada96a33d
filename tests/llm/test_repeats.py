"""Repeated passages against a slow loop, and edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest

from riskloom.llm import queries, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(rows, length=20):
    """Words, removed words and kept text of every row, window by window."""
    order = lambda i: 2**63 - 1 if i is None else i
    texts = [(order(i), WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in texts:
        for p in range(len(w) - length + 1):
            key = tuple(w[p:p + length])
            first[key] = min(first.get(key, (i, p)), (i, p))
    out = []
    for (i, w), (doc_id, _) in zip(texts, rows):
        gone = set()
        for p in range(len(w) - length + 1):
            if first[tuple(w[p:p + length])] != (i, p):
                gone |= set(range(p, p + length))
        out.append((doc_id, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def result(docs, **options):
    rows = repeats.remove_repeats(docs, **options).collect()
    for r in rows:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:]))
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows), key=repr)


def made(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "ß…", "W1"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice((19, 20, 21, 45)))] for _ in range(6)]
    rows = []
    for i in rng.sample(range(-500, 500), n):
        parts = [rng.choice(passages) if rng.random() < .5 else [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
                 for _ in range(rng.randrange(5))]
        rows.append((i, rng.choice((" ", "\n", " \t ")).join(x for p in parts for x in p)))
    return rows


EDGES = [(None, "a " * 30), (None, None), (7, None), (8, ""), (9, " \n\t"), (10, "one"),
         (11, "a " * 25), (11, "a " * 25), (11, "b " + "a " * 40), (12, " ".join(map(str, range(20)))),
         (13, " ".join(map(str, range(20)))), (14, " ".join(map(str, range(19)))), (15, "x y " * 22),
         (16, " ".join(str(i % 50) for i in range(30_000))), (None, " ".join(map(str, range(20))))]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_windows_one_by_one(spark, seed):
    rows = made(seed)
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(5)
    assert result(docs) == sorted(slow(rows), key=repr)
    assert sum(r[2] for r in slow(rows)) > 100
    # The first level is only a filter; so are several.
    assert result(docs, first=20) == result(docs, first=5) == sorted(slow(rows), key=repr)
    assert result(docs, length=8, first=4) == sorted(slow(rows, 8), key=repr)


def test_edges_and_clashing_columns(spark):
    docs = spark.createDataFrame([(*r, 1, "x", "y", b"z", "k") for r in EDGES],
                                 "doc_id bigint, text string, id int, print string, places string, cell binary, kept string")
    assert result(docs.repartition(3)) == sorted(slow(EDGES), key=repr)
    assert result(docs.limit(0)) == []


def test_many_buckets_and_cells(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CELL_BYTES", 500)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 900)
    rows = made(3) + EDGES
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)
    assert result(docs) == sorted(slow(rows), key=repr)


def test_short_form_of_places():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 40, 200):
        places = np.sort(rng.choice(300, n, replace=False))
        assert (repeats.decode(repeats.encode(places)) == places).all()
    assert len(repeats.encode(np.arange(1000))) == 8


def test_registered_query(spark, tmp_path):
    rows = made(4)
    spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id bigint, text string, lang string").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = queries.queries()["op11_substring_dedup"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(
        (i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in slow(rows))
