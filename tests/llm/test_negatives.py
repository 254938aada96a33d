"""Hard negatives against scoring every pair, the bounds, and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import negatives, queries

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def usable(rows):
    return [(i, (l + 1) % 10 if i % 7 == 0 else l, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, l in rows
            if i is not None and v is not None and l is not None and all(x is not None and math.isfinite(x) for x in v)]


def slow(rows, step=50, positives=5, k=3, least=50, most=95):
    rows = usable(rows)
    anchors = {}
    for i, l, v in rows:
        if i % step == 0:
            anchors[i] = min(anchors.get(i, (l, v)), (l, v))
    out = []
    for anchor, (label, vector) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, vector)), i, l) for i, l, v in rows
                        if i != anchor and len(v) == len(vector))
        for s, positive, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and least * -s <= 100 * -x[0] <= most * -s][:k]
            out += [(anchor, positive, rank, i, -s, -n) for rank, (n, i, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, step=50, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    noisy = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = negatives.mine(negatives.integers(df, 256, noisy), F.col("id") % step == 0, **options)
    return sorted(map(tuple, found.collect()))


def clustered(seed, n=700, width=24, spread=.4):
    rng = np.random.default_rng(seed)
    centres = np.repeat(rng.normal(size=(6, width // 4)), 4, axis=1)
    label = rng.integers(0, 6, n)
    vectors = (centres[label] + spread * rng.normal(size=(n, width))).astype(np.float32)
    return [(int(i) - 50, v.tolist(), int(l)) for i, v, l in zip(rng.permutation(n), vectors, label)]


@pytest.mark.parametrize("spread", [.05, .4, 3])
def test_against_all_pairs(spark, monkeypatch, spread):
    rows = clustered(1, spread=spread)
    want = slow(rows)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 90)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 4)
    assert want and mined(spark, rows) == want
    monkeypatch.setattr(negatives, "PASS_ANCHORS", 3)
    assert mined(spark, rows, 60, positives=2, negatives=4, least=20, most=101) == slow(rows, 60, 2, 4, 20, 101)


def test_edges_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0, 1.0], 1), (0, [1.0, .5], 1), (1, [1.0, 1.0], 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1),
            (5, None, 1), (6, [1.0, .5], None), (8, [.7, .3], 2), (9, [.7, .3], 2), (9, [.7, .3], 2), (10, [.7, .3], 3), (11, [0.0, 0.0], 2),
            (50, [0.0, 0.0], 1), (100, [], 1), (101, [], 1), (102, [], 2), (150, [-1.0, -1.0], 4), (151, [1.0, 1.0], 4), (152, [-.5, 0.0], 5),
            (200, [1.0, 1.0, 1.0], 1), (201, [1.0, 1.0, .9], 1), (202, [.6, .6, .6], 2), (250, [3.0, 1.0], 7), (250, [2.0, 1.0], 7), (251, [2.0, 2.0], 7)]
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], SCHEMA + ", id int, v string, score double")
    noisy = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    assert sorted(map(tuple, negatives.mine(negatives.integers(df, 256, noisy), F.col("id") % 50 == 0).collect())) == slow(rows)
    assert mined(spark, rows) == slow(rows)
    assert mined(spark, rows[:1]) == []
    assert negatives.mine(negatives.integers(df.limit(0)), F.col("id") % 50 == 0).collect() == []


def test_copies_and_large_numbers(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0] * 8, i % 3) for i in range(400)]  # one vector holds most rows
    rows += [(i, rng.normal(size=8).tolist(), int(rng.integers(0, 3))) for i in range(400, 600)]
    assert mined(spark, rows) == slow(rows)
    rows = [(i, (4e5 * rng.normal(size=8)).tolist(), int(rng.integers(0, 3))) for i in range(300)]
    assert mined(spark, rows) == slow(rows)


def test_bounds_hold_and_leave_pairs_out():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.integers(-200, 200, (300, 16)), 4, axis=1) + rng.integers(-5, 6, (300, 64))
    rows, asked = (negatives.Vectors.of(np.arange(len(v)), np.zeros(len(v)), v) for v in (x, x[:40]))
    exact = x @ x[:40].T
    for own, other in zip(rows.levels, asked.levels):
        middle, around = (own.means * own.sizes) @ other.means.T, own.deviations @ other.deviations.T
        assert (np.abs(exact - middle) <= around + 1e-3).all()
    assert [v.means.shape[1] for v in rows.levels] == [1, 2, 4, 8, 16]
    bar = np.sort(exact, axis=0)[-5]
    r, a = negatives.possible_pairs(rows, asked, lambda low, high, r, a: high >= bar[a])
    assert len(r) < 0.1 * exact.size
    assert {*zip(*np.nonzero(exact >= bar))} <= {*zip(r, a)}
    assert (negatives.exact_scores(rows, asked, r, a) == exact[r, a]).all()


def test_registered_query(spark, tmp_path):
    rows = clustered(3, 400)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.queries()["op13_hard_negatives"](spark, str(tmp_path))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == slow(rows)
