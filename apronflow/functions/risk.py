"""Risk buckets and scores.

Four bucketings exist side by side and differ at their boundaries; each keeps its own name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from apronflow.functions.columns import as_column, flag, lookup
from apronflow.functions.fixed_values import (
    DELAY_ADVICE,
    WEATHER_CODE,
    WEATHER_DELAY_MINUTES,
    WEATHER_FACTOR,
)


def delay_risk(delay: Column | str, low: float = 15, medium: float = 30) -> Column:
    """Low up to and including ``low``, Medium up to ``medium``, else High (null is High)."""
    delay = as_column(delay)
    return F.when(delay <= low, "Low").when(delay <= medium, "Medium").otherwise("High")


def predicted_risk(delay: Column | str, low: float = 15, medium: float = 30) -> Column:
    """LOW strictly below ``low``, MEDIUM strictly below ``medium``, else HIGH."""
    delay = as_column(delay)
    return F.when(delay < low, "LOW").when(delay < medium, "MEDIUM").otherwise("HIGH")


def delay_advice(level: Column | str) -> Column:
    return lookup(level, DELAY_ADVICE, None)


def binned(value: Column | str, edges: list[float], names: list[str]) -> Column:
    """Right-closed bins; null outside the edges."""
    value = as_column(value)
    chain = F
    for low, high, name in zip(edges, edges[1:], names):
        chain = chain.when((value > low) & (value <= high), name)
    return chain


def training_risk(delay: Column | str) -> Column:
    """Training label of a delay in minutes."""
    return binned(delay, [-1, 15, 40, 9999], ["LOW", "MEDIUM", "HIGH"])


def binary_risk(delayed: Column | str) -> Column:
    """Training label of a 0/1 delay flag; other values are null."""
    delayed = as_column(delayed)
    return F.when(delayed == 0, "LOW").when(delayed == 1, "HIGH")


def probability_risk(percent: Column | str) -> Column:
    """Level of a delay probability in percent; exactly 0 is null."""
    return binned(percent, [0, 40, 70, 100], ["LOW", "MEDIUM", "HIGH"])


def score_risk(score: Column | str, low: float = 40, medium: float = 70) -> Column:
    score = as_column(score)
    return F.when(score < low, "LOW").when(score < medium, "MEDIUM").otherwise("HIGH")


def delay_probability(delay: Column | str, full_at: float = 90) -> Column:
    """Percent, linear in the delay (floored at 0) and capped at 100."""
    floored = F.greatest(as_column(delay), F.lit(0.0))
    return F.least(F.lit(100.0), floored / full_at * 100)


def is_delayed(delay: Column | str, after: float = 15) -> Column:
    return flag(as_column(delay) > after)


def on_time(delay: Column | str, within: float = 15) -> Column:
    return flag(as_column(delay) <= within)


def weather_code(weather: Column | str) -> Column:
    return lookup(weather, WEATHER_CODE, 0)


def weather_factor(weather: Column | str) -> Column:
    return lookup(weather, WEATHER_FACTOR, 40)


def weather_delay(weather: Column | str) -> Column:
    return lookup(weather, WEATHER_DELAY_MINUTES, 0)


def weighted_risk(delay_factor, peak, weather, weekend) -> Column:
    """Weighted 0..100 score of a delay factor, peak flag, weather name and weekend flag."""
    peak_factor = F.when(as_column(peak) == 1, 70.0).otherwise(30.0)
    weekend_factor = F.when(as_column(weekend) == 1, 40.0).otherwise(20.0)
    score = (
        as_column(delay_factor) * 0.40
        + peak_factor * 0.25
        + weather_factor(weather) * 0.25
        + weekend_factor * 0.10
    )
    return F.least(score, F.lit(100.0))
