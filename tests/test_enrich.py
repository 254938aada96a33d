import datetime as dt
import random
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import enrich, marts
from riskloom.sources import tables
from riskloom.sources.tables import TRANSACTION_SCHEMA

START = dt.datetime(2025, 1, 1)


def row(i, account="ACC-00001", minutes=None, amount="10.00", fraud=0, volatility=1.0, score_free=True):
    at = None if minutes is None else START + dt.timedelta(minutes=minutes)
    return (f"t{i:05d}", at, account, f"CUS-{i % 7:05d}", None if amount is None else Decimal(amount),
            "wire", "retail", "US", fraud, volatility)


def sample(accounts):
    rng = random.Random(5)
    rows, i = [], 0
    for account, size in accounts.items():
        for _ in range(size):
            money = None if rng.random() < 0.02 else f"{rng.uniform(-900, 900):.2f}"
            rows.append(row(i, account, rng.randrange(size), money))
            i += 1
    rng.shuffle(rows)
    return rows


def expected(rows):
    frame = pd.DataFrame(rows, columns=TRANSACTION_SCHEMA.names).sort_values(
        ["account_id", "timestamp", "transaction_id"], na_position="first")
    frame["amount"] = frame["amount"].astype(float)
    rolled = frame.groupby("account_id")["amount"].transform(lambda x: x.rolling(50, min_periods=1).mean())
    return dict(zip(frame["transaction_id"], rolled))


def averages(df):
    return {r["transaction_id"]: r["rolling_avg_amount"] for r in df.collect()}


def same(found, wanted):
    assert found.keys() == wanted.keys()
    for key, value in wanted.items():
        if value != value:
            assert found[key] is None
        else:
            assert found[key] == pytest.approx(value, abs=1e-9)


def test_rolling_average_matches_pandas(spark):
    rows = sample({"A1": 1, "A50": 50, "A51": 51, "A300": 300, None: 20})
    tx = spark.createDataFrame(rows, TRANSACTION_SCHEMA)
    same(averages(enrich.rolling_average(tx)), expected(rows))


@pytest.mark.parametrize("hot_rows", [50, 70, 120])
def test_split_accounts_match_pandas(spark, hot_rows):
    rows = sample({"hot": 900, "warm": 130, "cold": 7, None: 15})
    rows += [row(90_000 + i, "hot", None, "5.00") for i in range(3)]
    rows += [row(91_000 + i, "hot", 400, f"{i}.25") for i in range(150)]
    tx = spark.createDataFrame(rows, TRANSACTION_SCHEMA)
    same(averages(enrich.rolling_average(tx, hot_rows=hot_rows)), expected(rows))


def test_split_accounts_without_zone(spark):
    rows = sample({"hot": 400})
    tx = spark.createDataFrame(rows, TRANSACTION_SCHEMA).withColumn(
        "timestamp", F.col("timestamp").cast("timestamp_ntz"))
    same(averages(enrich.rolling_average(tx, hot_rows=60)), expected(rows))


@pytest.mark.parametrize("minutes", [
    [5] * 1000, [int(1.013 ** i) for i in range(1000)], list(range(1000)), [0] * 10 + [10**6] * 990])
def test_slices_are_bounded(spark, monkeypatch, minutes):
    """One timestamp, log-spread times and strays: no slice above twice its share of one account."""
    rows = [row(i, "hot", m, f"{i % 90}.25") for i, m in enumerate(minutes)]
    tx = spark.createDataFrame(rows, TRANSACTION_SCHEMA)
    hot = spark.createDataFrame([("hot", len(rows), 10)], "account_id string, rows long, parts long")
    base = tx.withColumn("_money", F.col("amount"))
    sliced = enrich._with_halo(base, hot, 49, F.lit(0))
    sizes = [r["count"] for r in sliced.where(~F.col("_halo")).groupBy("_slice").count().collect()]
    assert sum(sizes) == 1000 and len(sizes) >= 9 and max(sizes) <= 200
    assert all(r["count"] == 49 for r in sliced.where("_halo").groupBy("_slice").count().collect())
    same(averages(enrich.rolling_average(tx, hot_rows=100)), expected(rows))


def test_small_slices_take_their_halo_from_several(spark):
    rows = sample({"hot": 400, "other": 60})
    tx = spark.createDataFrame(rows, TRANSACTION_SCHEMA)
    hot = spark.createDataFrame([("hot", 400, 40)], "account_id string, rows long, parts long")
    sliced = enrich._with_halo(tx.withColumn("_money", F.col("amount")), hot, 49, F.lit(0)).where("account_id = 'hot'")
    order = ["timestamp", "transaction_id"]
    by_slice = {}
    for r in sliced.orderBy(F.col("_slice"), *order).collect():
        by_slice.setdefault(r["_slice"], ([], []))[r["_halo"]].append(r["transaction_id"])
    seen = []
    for number in sorted(by_slice):
        own, halo = by_slice[number]
        assert halo == seen[-49:]
        seen += own
    same(averages(enrich.rolling_average(tx, hot_rows=50)), expected(rows))


def test_many_hot_accounts_share_range_partitions(spark):
    """As many accounts above the limit as one likes: the files of the slices grow with the rows alone."""
    rows = sample({f"A{i:03d}": 120 for i in range(150)} | {"cold": 40, None: 9})
    tx = spark.createDataFrame(rows, TRANSACTION_SCHEMA)
    found = enrich.rolling_average(tx, hot_rows=50)
    assert len([f for f in found.inputFiles() if "/slices/" in f]) <= 4
    same(averages(found), expected(rows))


def test_repeated_rows_stay_in_one_slice(spark):
    """Equal keys have no order of their own, so a cut between them would give both the same place."""
    rows = [r for r in sample({"hot": 500, "warm": 130}) for _ in range(2)]
    tx = spark.createDataFrame(rows, TRANSACTION_SCHEMA)
    found = enrich.rolling_average(tx, hot_rows=51)
    shown = lambda df: sorted((r["transaction_id"], str(r["rolling_avg_amount"])) for r in df.collect())
    assert shown(found) == shown(enrich.rolling_average(tx))


def test_flags_and_score(spark):
    rows = [
        row(1, "A", 1, "10.00", 0, 1.5), row(2, "B", 1, "10.00", 1, 1.6), row(3, "C", 1, "10.00", 0, float("nan")),
        row(4, "D", 1, "10.00", 0, None), row(5, "E", 1, "10.00", None, 3.0), row(6, None, 1, "10.00", 1, 0.3),
    ]
    rows += [row(100 + i, "F", i, "1.00") for i in range(49)] + [row(200, "F", 60, "1000.00", 1, 2.0)]
    out = {r["transaction_id"]: r["risk_score"]
           for r in enrich.enrich(spark.createDataFrame(rows, TRANSACTION_SCHEMA)).collect()}
    assert out["t00001"] == 0.0 and out["t00002"] == 0.65 and out["t00003"] == 0.0
    assert out["t00004"] == 0.0 and out["t00005"] is None and out["t00006"] == 0.25
    assert out["t00200"] == 1.0 and out["t00100"] == 0.0


def test_double_amounts_with_nan(spark):
    tx = spark.createDataFrame(
        [("a", START, "A", 1.25), ("b", START, "A", float("nan")), ("c", START, "A", 3.75)],
        "transaction_id string, timestamp timestamp, account_id string, amount double")
    assert averages(enrich.rolling_average(tx)) == {"a": 1.25, "b": 1.25, "c": 2.5}


def test_hot_rows_below_window(spark):
    with pytest.raises(ValueError):
        enrich.rolling_average(spark.createDataFrame([], TRANSACTION_SCHEMA), hot_rows=10)


def test_buckets_at_their_edges(spark):
    scores = [0.0, 0.25, 0.2501, 0.5, 0.5001, 0.75, 0.7501, None, -0.1]
    df = spark.createDataFrame([(s,) for s in scores], "risk_score double")
    counts = {r["risk_bucket"]: r["transaction_count"] for r in marts.risk_distribution(df).collect()}
    assert counts == {"0.00 (No Risk)": 1, "0.01–0.25 (Low)": 1, "0.26–0.50 (Medium)": 2,
                      "0.51–0.75 (High)": 2, "0.76–1.00 (Critical)": 3}


def test_buckets_need_no_exchange(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"t{i:04d}", dt.datetime(2025, 1, 1 + rng.randrange(20)), rng.choice(["a", "b", "c", "hot", "hot", "hot", None, "orphan 1"]),
             Decimal(rng.randrange(-9000, 9000)) / 100, 0, 1.0) for i in range(900)]
    tx = spark.createDataFrame(rows, "transaction_id string, timestamp timestamp, account_id string, amount decimal(18,2), "
                                     "fraud_flag int, volatility_index double")
    tables.write_by_account(tx, "by_account", 4, str(tmp_path / "by_account"))
    stored = spark.table("by_account")
    found = enrich.enrich_bucketed(stored)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" in plan
    wanted = sorted(map(str, enrich.enrich(tx).collect()))
    assert sorted(map(str, found.collect())) == wanted
    assert sorted(map(str, enrich.enrich_bucketed(stored, hot_rows=100).collect())) == wanted
    spark.sql("DROP TABLE by_account")


def test_buckets_grow_with_the_rows():
    assert tables.buckets_for(0) == 1 and tables.buckets_for(0, 8) == tables.buckets_for(8_000_000, 8) == 8
    for rows in (8_000_001, 36_000_000, 216_000_000):
        assert rows / tables.buckets_for(rows, 8) <= tables.BUCKET_ROWS


def test_amounts_are_shuffled_once(spark):
    """Amounts that are decimals already are summed as they are, without a copy beside them."""
    tx = spark.range(20).select(
        F.col("id").cast("string").alias("transaction_id"), F.timestamp_seconds("id").alias("timestamp"), F.lit("a").alias("account_id"),
        F.col("id").cast("decimal(18,2)").alias("amount"), F.lit(0).alias("fraud_flag"), F.lit(1.0).alias("volatility_index"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "_money" not in plan(enrich.enrich(tx)) and "_money" in plan(enrich.enrich(tx.withColumn("amount", F.col("amount").cast("double"))))
