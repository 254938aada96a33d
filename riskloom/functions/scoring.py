"""Risk flags, score, severity bucket and ledger formatting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskloom import fixed_values as fixed


def volatility_flag(volatility="volatility_index") -> Column:
    """1.0 above the limit; a missing or NaN index gives 0.0."""
    v = F.col(volatility).cast("double")
    return F.when(~F.isnan(v) & (v > fixed.VOLATILITY_LIMIT), 1.0).otherwise(0.0)


def deviation_flag(amount="amount", average="rolling_avg_amount") -> Column:
    """1.0 where the amount is more than three times its rolling average, signs ignored."""
    size = F.abs(F.col(amount).cast("double"))
    usual = F.abs(F.col(average).cast("double"))
    far = ~F.isnan(size) & ~F.isnan(usual) & (size > fixed.DEVIATION_FACTOR * usual)
    return F.when(far, 1.0).otherwise(0.0)


def fraud_component(flag="fraud_flag") -> Column:
    return F.col(flag).cast("double")


def risk_score() -> Column:
    """Weighted sum of the three flags; an unknown fraud flag leaves the score unknown."""
    total = (
        fixed.WEIGHT_VOLATILITY * volatility_flag()
        + fixed.WEIGHT_DEVIATION * deviation_flag()
        + fixed.WEIGHT_FRAUD * fraud_component()
    )
    return F.round(total, 4)


def is_high_risk(score="risk_score") -> Column:
    return F.col(score) >= fixed.HIGH_RISK


def severity(score="risk_score") -> Column:
    """Severity label; unknown and negative scores count as critical."""
    s = F.col(score)
    label = F.when(s == 0, fixed.NO_RISK_LABEL)
    lower = 0.0
    for name, upper in fixed.SEVERITY_BUCKETS:
        label = label.when((s > lower) & (s <= upper), name)
        lower = upper
    return label.otherwise(fixed.CRITICAL_LABEL)


def mean_score(score="risk_score") -> Column:
    """Mean of a score with at most four decimals, summed exactly in any order."""
    points = F.sum(F.round(F.col(score) * 10_000).cast("bigint"))
    return points.cast("double") / (F.count(score) * 10_000.0)


def count_if(condition: Column) -> Column:
    """How often ``condition`` holds; 0 over no rows."""
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0))


def _contains_any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def first_rule(text: Column, rules: list, default: str) -> Column:
    """Name of the first ``(name, words)`` rule with a word contained in lower-cased ``text``."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    (name, words), *rest = rules
    chosen = F.when(_contains_any(lowered, words), name)
    for name, words in rest:
        chosen = chosen.when(_contains_any(lowered, words), name)
    return chosen.otherwise(default)


def channel(transaction_type="transaction_type") -> Column:
    return first_rule(F.col(transaction_type), fixed.CHANNEL_RULES, fixed.CHANNEL_DEFAULT)


def country_code(country="country") -> Column:
    pairs = [F.lit(x) for item in fixed.COUNTRY_CODES.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(country)), F.lit(fixed.COUNTRY_CODE_DEFAULT))


def ledger_time(text: Column) -> Column:
    """``Jun 05, 2025 10:42 AM``; text that is no time is returned as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(text), "MMM dd, yyyy hh:mm a"), text)


def dollars(amount: Column, decimals: int = 0) -> Column:
    """``-$1,234``: rounded half up, with thousands separators."""
    sign = F.when(amount < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.lit("$"), F.format_number(F.round(F.abs(amount), decimals), decimals))


def fixed_decimals(value: Column, decimals: int) -> Column:
    """The value with that many decimals; null stays null."""
    return F.when(value.isNotNull(), F.format_string(f"%.{decimals}f", value))


def risk_color(score: Column) -> Column:
    """Fill colour of a country by its mean risk."""
    share = (score - fixed.RISK_RAMP_START) / (1 - fixed.RISK_RAMP_START)
    rgb = [
        F.floor(start - (start - end) * share + 0.5).cast("string")
        for start, end in zip(fixed.RISK_RAMP_FROM, fixed.RISK_RAMP_TO)
    ]
    strong = F.concat(F.lit("rgb("), F.concat_ws(", ", *rgb), F.lit(")"))
    return F.when(score >= fixed.RISK_RAMP_START, strong).otherwise(fixed.RISK_FAINT)


def count_color(count: Column) -> Column:
    """Fill colour of a country by its number of transactions."""
    r, g, b = fixed.COUNT_RGB
    share = F.least(F.lit(1.0), count / fixed.COUNT_RAMP_END)
    opacity = fixed.FAINT_OPACITY + (1 - fixed.FAINT_OPACITY) * share
    strong = F.concat(F.lit(f"rgba({r}, {g}, {b}, "), fixed_decimals(opacity, 3), F.lit(")"))
    return F.when(count >= fixed.COUNT_RAMP_START, strong).otherwise(f"rgba({r}, {g}, {b}, {fixed.FAINT_OPACITY})")
