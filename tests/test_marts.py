import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import scoring
from riskloom.operators import marts
from riskloom.plans import selection


def test_quantiles_by_refinement(spark, monkeypatch):
    monkeypatch.setattr(selection, "SMALL", 20)
    monkeypatch.setattr(selection, "CELLS", 16)
    rng = random.Random(3)
    values = [round(rng.lognormvariate(4, 2), 2) * rng.choice([1, -1]) for _ in range(700)] + [5.0] * 300
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 4, "v double")
    shares = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    assert selection.quantiles(df, "v", shares) == pytest.approx(np.quantile(values, shares).tolist())


def test_quantiles_of_nothing_and_one_value(spark):
    empty = spark.createDataFrame([], "v double")
    assert selection.quantiles(empty, "v", [0.5]) == [None]
    assert selection.quantiles(spark.createDataFrame([(3.0,)], "v double"), "v", [0.25, 0.5]) == [3.0, 3.0]


def test_quantiles_read_the_input_twice(spark, monkeypatch):
    rng = np.random.default_rng(5)
    values = np.round(np.exp(rng.normal(size=60_000) * 3), 4)
    read = spark.sparkContext.accumulator(0)

    def watched(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4).mapInPandas(watched, "v double")
    shares = [0.01, 0.25, 0.5, 0.75, 0.999]
    wanted = np.quantile(values, shares).tolist()
    assert selection.quantiles(df, "v", shares) == pytest.approx(wanted)
    assert read.value == 2 * len(values)
    read.value = 0
    described = {r["statistic"]: r["value"] for r in marts.describe(df, "v").collect()}
    assert described["50%"] == pytest.approx(round(wanted[2], 6)) and read.value == 2 * len(values)
    # Brackets without reach miss their ranks, which are then searched in the whole input.
    monkeypatch.setattr(selection, "REACH", 0.0)
    assert selection.quantiles(df, "v", shares) == pytest.approx(wanted)


def test_describe_matches_pandas(spark):
    import pandas as pd
    values = [1.5, 2.0, 2.0, 7.25, None, float("nan")]
    found = {r["statistic"]: r["value"] for r in marts.describe(
        spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()}
    wanted = pd.Series(values, dtype=float).describe()
    assert found == pytest.approx({k: round(v, 6) for k, v in wanted.items()})


def test_kpi_of_empty_table(spark):
    empty = spark.createDataFrame([], "fraud_flag int, risk_score double")
    assert tuple(marts.kpi_summary(empty).first()) == (0, 0, 0.0, 0)


def test_top_risk_skips_unknown_scores(spark):
    df = spark.createDataFrame(
        [("a", None), ("b", float("nan")), ("c", 0.4), ("d", 0.4)], "transaction_id string, risk_score double")
    for name, kind in (("account_id", "string"), ("amount", "double"), ("volatility_index", "double"),
                       ("fraud_flag", "int")):
        df = df.withColumn(name, F.lit(None).cast(kind))
    assert [r["transaction_id"] for r in marts.top_risk(df).collect()] == ["c", "d"]


def test_formats(spark):
    df = spark.createDataFrame([(-1234567.5, "2025-06-05T10:42:00"), (999.5, "no time")], "a double, t string")
    rows = df.select(scoring.dollars(F.col("a")).alias("d"), scoring.dollars(F.col("a"), 2).alias("e"),
                     scoring.ledger_time(F.col("t")).alias("t")).collect()
    assert [tuple(r) for r in rows] == [
        ("-$1,234,568", "-$1,234,567.50", "Jun 05, 2025 10:42 AM"), ("$1,000", "$999.50", "no time")]


def test_channels_and_codes(spark):
    df = spark.createDataFrame([("Wire card", "Iran"), ("card_purchase", "X"), ("investment", None), (None, "China")],
                               "transaction_type string, country string")
    rows = df.select(scoring.channel().alias("c"), scoring.country_code().alias("k")).collect()
    assert [tuple(r) for r in rows] == [
        ("Wire Transfer", "ir"), ("Card Purchase", "us"), ("Shell Transfer", "us"), ("Transfer", "cn")]


def test_heatmap_match_fallback_and_default(spark):
    risk = spark.createDataFrame([("INDIA", 7, 0.6), ("Narnia", 2500, 1.0)],
                                 "country string, transaction_count long, avg_risk_score double")
    regions = spark.createDataFrame([("India",), ("narnia",), ("Japan",), ("Nowhere",)], "region string")
    rows = {r["region"]: tuple(r)[1:] for r in marts.region_heatmap(risk, regions).collect()}
    assert rows["India"] == (0.6, 7, "rgb(247, 147, 147)", "rgba(59, 130, 246, 0.04)")
    assert rows["narnia"] == (1.0, 2500, "rgb(239, 68, 68)", "rgba(59, 130, 246, 1.000)")
    assert rows["Japan"][:2] == (0.25, 620)
    assert rows["Nowhere"] == (0.15, 150, "rgba(239, 68, 68, 0.04)", "rgba(59, 130, 246, 0.112)")


def test_ranges_and_changes(spark):
    day = dt.datetime(2025, 12, 31, 12)
    data = [(day - dt.timedelta(days=d), f, s) for d, f, s in
            ((0, 1, 1.0), (6, 0, 0.25), (7, 0, 0.0), (29, 1, 0.65), (40, 0, 0.0), (364, 0, 0.4), (365, 1, 0.4))]
    df = spark.createDataFrame(data, "timestamp timestamp, fraud_flag int, risk_score double")
    rows = [tuple(r) for r in marts.trailing_range_kpi(df).collect()]
    assert rows == [("7d", 7, 2, 1, 0.625, 1), ("30d", 30, 4, 2, 0.475, 2), ("1y", 365, 6, 2, 0.3833, 2)]
    months = marts.month_over_month(df).collect()
    assert months[0]["transaction_count_change"] is None
    assert months[-1]["month"] == "2025-12" and months[-1]["transaction_count"] == 4
