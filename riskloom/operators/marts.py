"""Risk marts over enriched transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom import fixed_values as fixed
from riskloom.functions import scoring
from riskloom.plans.numbering import numbered
from riskloom.plans.selection import measured_quantiles

LEDGER_COLUMNS = [
    "transaction_id", "timestamp", "account_id", "customer_id", "amount", "transaction_type",
    "merchant_category", "country", "fraud_flag", "volatility_index", "risk_score",
]


def _mean4() -> Column:
    return F.round(scoring.mean_score(), 4).alias("avg_risk_score")


def _count() -> Column:
    return F.count("*").alias("transaction_count")


def _month() -> Column:
    return F.date_format("timestamp", "yyyy-MM").alias("month")


def measures(enriched: DataFrame, *keys: Column) -> DataFrame:
    """Counts and exact sums per group, from which the aggregate marts follow."""
    return enriched.groupBy(*keys).agg(
        F.count("*").alias("n"),
        scoring.count_if(F.col("fraud_flag") == 1).alias("fraud"),
        F.sum(F.round(F.col("risk_score") * 10_000).cast("bigint")).alias("points"),
        F.count("risk_score").alias("scored"),
        scoring.count_if(scoring.is_high_risk()).alias("high"))


def summary(enriched: DataFrame) -> DataFrame:
    """``measures`` by type, month, country and severity: the one scan behind five marts."""
    return measures(enriched, F.col("transaction_type"), _month(), F.col("country"), scoring.severity().alias("risk_bucket"))


def _sum(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0))


def _mean() -> Column:
    return F.sum("points").cast("double") / (F.sum("scored") * 10_000.0)


def _figures() -> list[Column]:
    return [_sum("n").alias("transaction_count"), F.round(_mean(), 4).alias("avg_risk_score")]


def kpi_of(parts: DataFrame) -> DataFrame:
    return parts.agg(
        _sum("n").alias("total_transactions"), _sum("fraud").alias("fraud_count"),
        F.coalesce(_mean(), F.lit(0.0)).alias("avg_risk_score"), _sum("high").alias("high_risk_count"))


def channels_of(parts: DataFrame) -> DataFrame:
    return parts.groupBy("transaction_type").agg(*_figures()).orderBy(F.desc("transaction_count"), "transaction_type")


def trend_of(parts: DataFrame) -> DataFrame:
    return parts.groupBy("month").agg(*_figures()).orderBy("month")


def countries_of(parts: DataFrame) -> DataFrame:
    return parts.groupBy("country").agg(*_figures(), _sum("high").alias("high_risk_count")).orderBy(
        F.desc("avg_risk_score"), "country")


def distribution_of(parts: DataFrame) -> DataFrame:
    return parts.groupBy("risk_bucket").agg(_sum("n").alias("transaction_count")).orderBy("risk_bucket")


def kpi_summary(enriched: DataFrame) -> DataFrame:
    return kpi_of(measures(enriched))


def risk_by_channel(enriched: DataFrame) -> DataFrame:
    return channels_of(measures(enriched, F.col("transaction_type")))


def monthly_trend(enriched: DataFrame) -> DataFrame:
    return trend_of(measures(enriched, _month()))


def country_risk(enriched: DataFrame) -> DataFrame:
    return countries_of(measures(enriched, F.col("country")))


def risk_distribution(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy(scoring.severity().alias("risk_bucket")).agg(_count()).orderBy("risk_bucket")


def riskiest(enriched: DataFrame, rows: int | None) -> DataFrame:
    """Highest score first, then largest amount, then id; all rows when ``rows`` is None."""
    ranked = enriched.orderBy(F.desc("risk_score"), F.desc("amount"), "transaction_id")
    return ranked if rows is None else ranked.limit(rows)


def critical_events(enriched: DataFrame, rows: int | None = fixed.LEDGER_ROWS) -> DataFrame:
    return riskiest(enriched.select(*LEDGER_COLUMNS), rows)


def compact_ledger(enriched: DataFrame, rows: int | None = fixed.LEDGER_ROWS) -> DataFrame:
    """The shorter ledger of the older screen, with formatted numbers; unknown ones stay unknown."""
    top = critical_events(enriched, rows)
    return top.select(
        "transaction_id", "timestamp", "account_id",
        scoring.dollars(F.col("amount"), 2).alias("amount"),
        "transaction_type", "country",
        scoring.fixed_decimals(F.col("volatility_index"), 2).alias("volatility_index"),
        scoring.fixed_decimals(F.col("risk_score"), 4).alias("risk_score"),
    )


def critical_ledger(events: DataFrame) -> DataFrame:
    """Display rows of any number of events, ranked; the rank comes from totals of sorted ranges.

    Only the columns that are shown take part in the sort.
    """
    order = [F.desc("risk_score"), F.desc("amount"), F.col("transaction_id")]
    shown = events.select("transaction_id", "timestamp", "amount", "transaction_type", "country", "risk_score")
    time_text = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    return numbered(shown, order, "rank").select(
        "rank",
        "transaction_id",
        "transaction_type",
        scoring.channel().alias("channel"),
        "country",
        scoring.country_code().alias("country_code"),
        scoring.fixed_decimals(F.col("risk_score"), 2).alias("score"),
        scoring.dollars(F.col("amount")).alias("amount"),
        scoring.ledger_time(time_text).alias("time"),
        F.lit(fixed.LEDGER_STATUS).alias("status"),
    )


def top_risk(enriched: DataFrame, rows: int = fixed.TOP_ROWS) -> DataFrame:
    """The rows with the largest known scores."""
    known = enriched.where(F.col("risk_score").isNotNull() & ~F.isnan("risk_score"))
    return known.orderBy(F.desc("risk_score"), "transaction_id").limit(rows).select(
        "transaction_id", "account_id", "amount", "volatility_index", "fraud_flag", "risk_score")


def recent_sample(tx: DataFrame, rows: int = fixed.LEDGER_ROWS) -> DataFrame:
    """The first rows in time order."""
    return tx.orderBy("timestamp", "transaction_id").limit(rows)


def etl_summary(enriched: DataFrame) -> DataFrame:
    high = scoring.count_if(scoring.is_high_risk())
    return enriched.agg(
        F.count("*").alias("total_rows"),
        high.alias("high_risk_rows"),
        F.round(100 * high / F.count("*"), 2).alias("high_risk_percent"),
        F.sum("fraud_flag").alias("fraud_cases"),
        F.round(scoring.mean_score(), 4).alias("avg_risk_score"),
        F.max("risk_score").alias("max_risk_score"),
    )


def fraud_check(tx: DataFrame) -> DataFrame:
    """Row and fraud counts after a load, and the fraud rate."""
    return tx.agg(
        F.count("*").alias("cnt"),
        F.sum("fraud_flag").alias("fraud_cnt"),
        F.round(F.avg("fraud_flag"), 4).alias("fraud_rate"),
    )


def describe(table: DataFrame, column: str, decimals: int = 6) -> DataFrame:
    """count, mean, std, min, quartiles and max of a column, one row per statistic.

    NaN counts as missing. The quartiles are exact but never gather the column in one
    task, unlike ``percentile``. The table is read twice.
    """
    v = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    known = table.select(v.alias("v"))
    v = F.col("v")
    stats, (q1, q2, q3) = measured_quantiles(
        known, "v", [0.25, 0.5, 0.75], F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    pairs = [("count", stats["_rows"]), ("mean", stats["mean"]), ("std", stats["std"]), ("min", stats["min"]),
             ("25%", q1), ("50%", q2), ("75%", q3), ("max", stats["max"])]
    rows = [F.struct(F.lit(n).alias("statistic"), F.round(F.lit(c).cast("double"), decimals).alias("value")) for n, c in pairs]
    return table.sparkSession.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def score_value_counts(enriched: DataFrame, rows: int = 10) -> DataFrame:
    counts = enriched.where(F.col("risk_score").isNotNull()).groupBy("risk_score").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "risk_score").limit(rows)


def trailing_months(trend: DataFrame, months: int) -> DataFrame:
    """The last months of the trend, oldest first. ``trend`` has one row per month."""
    return trend.orderBy(F.desc("month")).limit(months).orderBy("month")


def trailing_range_kpi(enriched: DataFrame) -> DataFrame:
    """Key figures of the last 7 days, 30 days and year of the table.

    One scan counts by day; the ranges are then taken from that small table.
    """
    daily = enriched.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count("*").alias("n"),
        scoring.count_if(F.col("fraud_flag") == 1).alias("fraud"),
        F.sum(F.round(F.col("risk_score") * 10_000).cast("bigint")).alias("points"),
        F.count("risk_score").alias("scored"),
        scoring.count_if(scoring.is_high_risk()).alias("high"),
    ).where(F.col("day").isNotNull())
    age = F.datediff(F.max("day").over(Window.partitionBy(F.lit(1))), F.col("day"))
    ranges = F.array(*[
        F.struct(F.lit(name).alias("range"), F.lit(days).alias("days"))
        for name, days in (("7d", 7), ("30d", 30), ("1y", 365))
    ])
    member = daily.withColumn("age", age).withColumn("r", F.explode(ranges)).where(F.col("age") < F.col("r.days"))
    return member.groupBy(F.col("r.range").alias("range"), F.col("r.days").alias("days")).agg(
        F.sum("n").alias("total_transactions"),
        F.sum("fraud").alias("fraud_count"),
        F.round(F.sum("points").cast("double") / (F.sum("scored") * 10_000.0), 4).alias("avg_risk_score"),
        F.sum("high").alias("high_risk_count"),
    ).orderBy("days")


def month_over_month(enriched: DataFrame) -> DataFrame:
    """Each month's key figures and their change against the month before, in percent."""
    monthly = enriched.groupBy(_month()).agg(
        _count(), scoring.count_if(F.col("fraud_flag") == 1).alias("fraud_count"), _mean4(),
        scoring.count_if(scoring.is_high_risk()).alias("high_risk_count"),
    )
    in_time = Window.orderBy("month")
    out = monthly
    for name in ("transaction_count", "fraud_count", "high_risk_count"):
        prior = F.lag(name).over(in_time)
        change = F.when(prior != 0, F.round(100.0 * (F.col(name) - prior) / prior, 1))
        out = out.withColumn(f"{name}_change", change)
    moved = F.round(F.col("avg_risk_score") - F.lag("avg_risk_score").over(in_time), 4)
    return out.withColumn("avg_risk_score_change", moved).orderBy("month")


def peak_tiles(enriched: DataFrame) -> DataFrame:
    """Riskiest channel, riskiest month and busiest month, as one row.

    One scan groups by channel and month together; the tiles come from that small table.
    """
    small = enriched.groupBy("transaction_type", _month()).agg(
        F.count("*").alias("n"),
        F.sum(F.round(F.col("risk_score") * 10_000).cast("bigint")).alias("points"),
        F.count("risk_score").alias("scored"),
    )
    sides = F.array(
        F.struct(F.lit("channel").alias("kind"), F.col("transaction_type").alias("name")),
        F.struct(F.lit("month").alias("kind"), F.col("month").alias("name")),
    )
    mean = F.round(F.sum("points").cast("double") / (F.sum("scored") * 10_000.0), 4)
    named = (
        small.withColumn("side", F.explode(sides))
        .groupBy("side.kind", "side.name")
        .agg(F.sum("n").alias("n"), mean.alias("risk"))
    )

    def peak(kind: str, value: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.struct(F.col(value).alias("v"), F.col("name").alias("name"))))

    tiles = named.agg(
        peak("channel", "risk").alias("c"), peak("month", "risk").alias("m"), peak("month", "n").alias("b"))
    return tiles.select(
        F.col("c.name").alias("top_risk_channel"), F.col("c.v").alias("top_channel_risk"),
        F.col("m.name").alias("peak_risk_month"), F.col("m.v").alias("peak_month_risk"),
        F.col("b.name").alias("busiest_month"), F.col("b.v").alias("busiest_month_count"),
    )


def top_customers(enriched: DataFrame, rows: int = 10) -> DataFrame:
    by_customer = enriched.groupBy("customer_id").agg(_count(), _mean4())
    return by_customer.orderBy(F.desc("avg_risk_score"), "customer_id").limit(rows)


def fallback_regions(spark) -> DataFrame:
    """The fixed fallback figures, one row per country name."""
    rows = [F.struct(F.lit(n).alias("region"), F.lit(r).alias("risk"), F.lit(c).alias("count"))
            for n, (r, c) in fixed.COUNTRY_FALLBACK.items()]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def region_heatmap(risk: DataFrame, regions: DataFrame) -> DataFrame:
    """Figures and fill colours per map region.

    Names match without regard to case; regions without transactions take the fallback
    table, then the defaults. ``risk`` is the country mart.
    """
    measured = risk.select(
        F.lower("country").alias("_name"), "transaction_count", "avg_risk_score"
    ).groupBy("_name").agg(F.max_by("transaction_count", "avg_risk_score").alias("_count"),
                           F.max("avg_risk_score").alias("_risk"), F.lit(True).alias("_seen"))
    fallback = fallback_regions(regions.sparkSession).withColumnRenamed("region", "_region")
    joined = (
        regions.select("region").withColumn("_name", F.lower("region"))
        .join(measured, "_name", "left")
        .join(fallback, F.col("region") == F.col("_region"), "left")
    )
    score = F.when(F.col("_seen"), F.col("_risk")).otherwise(
        F.coalesce("risk", F.lit(fixed.REGION_RISK_DEFAULT)))
    count = F.when(F.col("_seen"), F.col("_count")).otherwise(
        F.coalesce("count", F.lit(fixed.REGION_COUNT_DEFAULT)))
    return joined.select(
        "region", score.alias("risk"), count.cast("bigint").alias("transactions"),
    ).withColumn("risk_color", scoring.risk_color(F.col("risk"))).withColumn(
        "count_color", scoring.count_color(F.col("transactions")))
