"""Hourly series: gap filling and the figures a forecast starts from.

A series is at most 24 rows, so windows over one series are bounded; many series (``by``)
spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def series_window(by: list[str]):
    return Window.partitionBy(*(by or [F.lit(0)])).orderBy("hour")


def interpolate_hours(series: DataFrame, by: list[str] | None = None, default: float = 20.0) -> DataFrame:
    """Fill nulls of (hour, value): linear inside, last value after, first value before.

    A series without any value becomes ``default`` throughout.
    """
    w = series_window(by or [])
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    future = w.rowsBetween(0, Window.unboundedFollowing)
    known_hour = F.when(F.col("value").isNotNull(), F.col("hour"))
    sides = series.withColumns(
        {
            "_v0": F.last("value", ignorenulls=True).over(past),
            "_h0": F.last(known_hour, ignorenulls=True).over(past),
            "_v1": F.first("value", ignorenulls=True).over(future),
            "_h1": F.first(known_hour, ignorenulls=True).over(future),
        }
    )
    step = (F.col("hour") - F.col("_h0")) / (F.col("_h1") - F.col("_h0"))
    between = F.when(
        F.col("_h1") > F.col("_h0"), F.col("_v0") + (F.col("_v1") - F.col("_v0")) * step
    )
    filled = F.coalesce("value", between, "_v0", "_v1", F.lit(float(default)))
    return sides.select(*(by or []), "hour", filled.alias("value"))


def last_mean_and_trend(series: DataFrame, by: list[str] | None = None, last: int = 6) -> DataFrame:
    """Mean of the last hours of the day and the mean step between their ends."""
    first_hour = 24 - last
    at = lambda hour: F.max(F.when(F.col("hour") == hour, F.col("value")))
    return series.groupBy(*(by or [])).agg(
        F.avg(F.when(F.col("hour") >= first_hour, F.col("value"))).alias("mean"),
        ((at(23) - at(first_hour)) / last).alias("trend"),
    )
