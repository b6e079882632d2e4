"""Hourly and weekly delay forecasts for one or many series.

``by`` names the series keys (terminal, airline, gate ...); without keys there is one series
for the whole table. The only large step is the group mean per key and hour; after it a series
is 24 rows, and many series are computed side by side.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apronflow.functions.columns import lookup, text
from apronflow.functions.fixed_values import PEAK_WARNING, WEATHER_TREND_MULTIPLIER
from apronflow.operators.joins import reindex_days, reindex_hours
from apronflow.operators.prepare import require_hour
from apronflow.operators.series import interpolate_hours, last_mean_and_trend

# standard normal quantile of a two-sided 80 % interval
Z80 = 1.2815515655446004


def hourly_series(flights: DataFrame, by: list[str] | None = None) -> DataFrame:
    """24 rows (hour, value) per series: mean delay per hour, gaps interpolated."""
    by = by or []
    means = (
        require_hour(flights.dropna(subset=by) if by else flights)
        .groupBy(*by, F.col("departure_hour").alias("hour"))
        .agg(F.avg("delay_minutes").alias("value"))
    )
    return interpolate_hours(reindex_hours(means, "hour", "value", by), by)


def _label(as_of: dt.datetime, hours: Column) -> Column:
    at = F.lit(as_of.replace(tzinfo=None)) + F.make_dt_interval(hours=hours)
    return F.date_format(at, "HH:mm")


def history_labels(series: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The series as the last 24 hours before ``as_of``: time label and rounded value."""
    return series.withColumns(
        {"time": _label(as_of, F.col("hour") - 24), "value": F.bround("value", 1)}
    )


def trend_forecast(
    series: DataFrame,
    hours_ahead: int = 12,
    weather: str = "Clear",
    by: list[str] | None = None,
) -> DataFrame:
    """step, value and bounds: last mean plus trend; weather scales the trend only."""
    by = by or []
    steps = min(max(hours_ahead, 1), 24)
    start = last_mean_and_trend(series, by)
    ahead = start.select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    factor = WEATHER_TREND_MULTIPLIER.get(weather, 1.0)
    value = F.greatest(F.lit(0.0), F.col("mean") + F.col("trend") * F.col("step") * factor)
    return ahead.select(*by, "step", value.alias("value")).withColumns(
        {"lower_bound": F.col("value") * 0.75, "upper_bound": F.col("value") * 1.25}
    )


def _regression(values: Column) -> Column:
    """Sums for d[t] on d[t-1] and d[t-2], where d are the first differences."""
    diffs = F.transform(
        F.sequence(F.lit(1), F.size(values) - 1),
        lambda i: F.element_at(values, i + 1) - F.element_at(values, i),
    )
    triples = F.transform(
        F.sequence(F.lit(3), F.size(diffs)),
        lambda i: F.struct(
            F.element_at(diffs, i).alias("y"),
            F.element_at(diffs, i - 1).alias("a"),
            F.element_at(diffs, i - 2).alias("b"),
        ),
    )
    return F.struct(
        F.element_at(values, -1).alias("level"),
        F.element_at(diffs, -1).alias("d1"),
        F.element_at(diffs, -2).alias("d2"),
        triples.alias("triples"),
    )


def ar_forecast(
    series: DataFrame,
    hours_ahead: int = 12,
    weather: str = "Clear",
    by: list[str] | None = None,
) -> DataFrame:
    """step, value and 80 % bounds from an AR(2) on first differences.

    Least squares without intercept has a closed 2x2 form, and the recursion folds over the
    steps, so everything stays in native array expressions: one row per series. This is an
    approximation of a full ARIMA fit, with the variance of the integrated AR process for the
    bounds. A series whose differences carry no information forecasts its last level.
    """
    by = by or []
    steps = min(max(hours_ahead, 1), 24)
    factor = F.lit(WEATHER_TREND_MULTIPLIER.get(weather, 1.0))

    ordered = series.groupBy(*by).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("hour", "value"))), lambda p: p["value"]
        ).alias("_values")
    )
    fitted = ordered.select(*by, _regression(F.col("_values")).alias("_r"))

    def total(term) -> Column:
        return F.aggregate(F.col("_r.triples"), F.lit(0.0), lambda acc, t: acc + term(t))

    sums = fitted.select(
        "*",
        total(lambda t: t["a"] * t["a"]).alias("_aa"),
        total(lambda t: t["b"] * t["b"]).alias("_bb"),
        total(lambda t: t["a"] * t["b"]).alias("_ab"),
        total(lambda t: t["a"] * t["y"]).alias("_ay"),
        total(lambda t: t["b"] * t["y"]).alias("_by"),
    )
    det = F.col("_aa") * F.col("_bb") - F.col("_ab") * F.col("_ab")
    solvable = F.abs(det) > 1e-9
    solved = sums.select(
        *by,
        "_r",
        F.when(solvable, (F.col("_ay") * F.col("_bb") - F.col("_by") * F.col("_ab")) / det)
        .otherwise(0.0)
        .alias("_p1"),
        F.when(solvable, (F.col("_by") * F.col("_aa") - F.col("_ay") * F.col("_ab")) / det)
        .otherwise(0.0)
        .alias("_p2"),
    )
    p1, p2 = F.col("_p1"), F.col("_p2")
    residual = F.aggregate(
        F.col("_r.triples"),
        F.lit(0.0),
        lambda acc, t: acc + F.pow(t["y"] - p1 * t["a"] - p2 * t["b"], 2),
    )
    scaled = solved.withColumn(
        "_sigma", F.sqrt(residual / F.greatest(F.size("_r.triples") - 2, F.lit(1)))
    )

    # state per step: level and last two differences; psi weights of the differences, their
    # running sum (weights of the level) and the variance so far; and the points produced
    points_type = "array<struct<step:int,level:double,variance:double>>"
    start = F.struct(
        F.col("_r.level").alias("level"),
        F.col("_r.d1").alias("d1"),
        F.col("_r.d2").alias("d2"),
        F.lit(1.0).alias("psi1"),
        F.lit(0.0).alias("psi2"),
        F.lit(1.0).alias("weight"),
        F.lit(0.0).alias("variance"),
        F.array().cast(points_type).alias("points"),
    )

    def advance(s: Column, i: Column) -> Column:
        change = p1 * s["d1"] + p2 * s["d2"]
        variance = s["variance"] + s["weight"] * s["weight"]
        psi = p1 * s["psi1"] + p2 * s["psi2"]
        level = s["level"] + change
        point = F.struct(i.alias("step"), level.alias("level"), variance.alias("variance"))
        return F.struct(
            level.alias("level"),
            change.alias("d1"),
            s["d1"].alias("d2"),
            psi.alias("psi1"),
            s["psi1"].alias("psi2"),
            (s["weight"] + psi).alias("weight"),
            variance.alias("variance"),
            F.concat(s["points"], F.array(point)).alias("points"),
        )

    folded = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, advance, lambda s: s["points"])
    points = scaled.select(*by, "_sigma", F.inline(folded))
    half = F.col("_sigma") * F.sqrt("variance") * Z80
    positive = lambda v: F.greatest(F.lit(0.0), v * factor)
    return points.select(
        *by,
        "step",
        positive(F.col("level")).alias("value"),
        positive(F.col("level") - half).alias("lower_bound"),
        positive(F.col("level") + half).alias("upper_bound"),
    )


def label_forecast(forecast: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Time label per step and figures rounded to one decimal."""
    rounded = {c: F.bround(c, 1) for c in ("value", "lower_bound", "upper_bound")}
    return forecast.withColumns({"time": _label(as_of, F.col("step")), **rounded})


def peak_warnings(
    forecast: DataFrame, as_of: dt.datetime, high: float = 45, critical: float = 60
) -> DataFrame:
    """Steps above ``high`` minutes; compared before rounding."""
    value = F.col("value")
    label = _label(as_of, F.col("step"))
    keys = [c for c in forecast.columns if c not in ("value", "lower_bound", "upper_bound", "step")]
    return forecast.filter(value > high).select(
        *keys,
        "step",
        label.alias("time"),
        F.bround(value, 1).alias("delay"),
        F.when(value > critical, "CRITICAL").otherwise("HIGH").alias("level"),
        text(PEAK_WARNING, F.bround(value, 1), label).alias("message"),
    )


def first_warnings(warnings: DataFrame, k: int = 4, by: list[str] | None = None) -> DataFrame:
    """The earliest k warnings, of each key where ``by`` is given (a key has one warning per step at most)."""
    if not by:
        return warnings.orderBy("step").limit(k)
    place = F.row_number().over(Window.partitionBy(*by).orderBy("step"))
    return warnings.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


def forecast_summary(forecast: DataFrame, by: list[str] | None = None, high: float = 45) -> DataFrame:
    """Mean and maximum of the rounded values, and the number of warnings."""
    rounded = F.bround("value", 1)
    return forecast.groupBy(*(by or [])).agg(
        F.bround(F.avg(rounded), 1).alias("forecast_avg"),
        F.bround(F.max(rounded), 1).alias("forecast_max"),
        F.count(F.when(F.col("value") > high, 1)).alias("peak_warnings_count"),
    )


def weekly_series(flights: DataFrame, by: list[str] | None = None, default: float = 25.0) -> DataFrame:
    """Mon..Sun mean delay per series, floored at 0; ``default`` for days without flights."""
    by = by or []
    keys = [*by, "day_of_week"]
    means = flights.dropna(subset=keys).groupBy(*keys).agg(F.avg("delay_minutes").alias("value"))
    week = reindex_days(means, "day_of_week", "value", by, default)
    return week.withColumn("value", F.greatest(F.lit(0.0), F.col("value")))


def weekly_outlook(flights: DataFrame, by: list[str] | None = None, default: float = 25.0) -> DataFrame:
    """Per series: the rounded week, its mean, and the first day with the largest value."""
    by = by or []
    week = weekly_series(flights, by, default)
    days = F.array_sort(F.collect_list(F.struct("day_no", "day_of_week", F.bround("value", 1).alias("value"))))
    return week.groupBy(*by).agg(
        F.transform(days, lambda d: F.struct(d["day_of_week"].alias("day"), d["value"].alias("value"))).alias("days"),
        F.bround(F.avg("value"), 1).alias("avg"),
        F.max_by("day_of_week", F.struct("value", -F.col("day_no"))).alias("peak_day"),
    )


def weather_multiplier(weather: Column | str) -> Column:
    """Forecast multiplier of a weather name."""
    return lookup(weather, WEATHER_TREND_MULTIPLIER, 1.0)


def forecast_run(
    flights: DataFrame, as_of: dt.datetime, hours_ahead: int = 12, weather: str = "Clear"
) -> DataFrame:
    """One forecast_runs history row."""
    steps = min(max(hours_ahead, 1), 24)
    summary = forecast_summary(trend_forecast(hourly_series(flights), steps, weather))
    return summary.select(
        F.lit(as_of).alias("created_at"),
        F.lit(weather).alias("weather"),
        F.lit(steps).alias("hours_ahead"),
        "forecast_avg",
        "forecast_max",
        "peak_warnings_count",
    )
