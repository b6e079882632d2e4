"""Alert checks over flights, passenger flow and weather.

Every check yields zero or more rows of one schema; ``as_of`` stands for the current time.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apronflow.functions.columns import lookup, text
from apronflow.functions.fixed_values import (
    ALERT_WEATHER,
    CONGESTION_ALERT,
    DELAY_ALERT,
    GATE_ALERT,
    PRIORITY_RANK,
    WEATHER_ALERT,
)
from apronflow.operators.gates import gate_load
from apronflow.operators.kpis import congestion_stats
from apronflow.operators.prepare import union_all
from apronflow.sources.scratch import materialize


def _alert(
    df: DataFrame,
    prefix: str,
    kind: str,
    rule: dict,
    as_of: dt.datetime,
    title: tuple[Column, ...] = (),
    message: tuple[Column, ...] = (),
    details: tuple[Column, ...] = (),
    subject: Column | None = None,
) -> DataFrame:
    """Rows of ``df`` as alerts, texts filled from the given columns."""
    actions = [text(a, subject) if "%s" in a else F.lit(a) for a in rule["actions"]]
    return df.select(
        F.lit(f"{prefix}_{as_of:%H%M}").alias("id"),
        F.lit(kind).alias("type"),
        F.lit(rule["priority"]).alias("priority"),
        text(rule["title"], *title).alias("title"),
        text(rule["message"], *message).alias("message"),
        text(rule["details"], *details).alias("details"),
        F.lit(as_of).cast("timestamp").alias("timestamp"),
        F.array(*actions).alias("actions"),
    )


def first_airlines(per_airline: DataFrame, k: int = 3) -> DataFrame:
    """One row: names of the first k airlines by first appearance, joined by commas."""
    chosen = per_airline.orderBy("first", "airline").limit(k)
    ordered = F.array_sort(F.collect_list(F.struct("first", "airline")))
    return chosen.agg(F.array_join(F.transform(ordered, lambda a: a["airline"]), ", ").alias("airlines"))


def late_airlines(flights: DataFrame, threshold: float, order: str) -> DataFrame:
    """Late flights and first appearance per airline; a written table, one row per airline."""
    late = flights.filter(F.col("delay_minutes") > threshold)
    return materialize(
        late.groupBy("airline").agg(F.count(F.lit(1)).alias("late"), F.min(order).alias("first")),
        "late-airlines",
    )


def first_three_airlines(flights: DataFrame, threshold: float = 30, order: str = "seq") -> DataFrame:
    return first_airlines(late_airlines(flights, threshold, order).dropna(subset=["airline"]), 3)


def delay_alert(
    flights: DataFrame,
    as_of: dt.datetime,
    threshold: int = 30,
    at_least: int = 3,
    order: str = "seq",
) -> DataFrame:
    """One alert when enough flights are late."""
    per_airline = late_airlines(flights, threshold, order)
    names = first_airlines(per_airline.dropna(subset=["airline"])).scalar()
    found = per_airline.agg(F.sum("late").alias("late")).filter(F.col("late") >= at_least)
    named = found.select("late", names.alias("airlines"))
    return _alert(
        named, "DELAY", "DELAY", DELAY_ALERT, as_of,
        message=(F.col("late"), F.lit(threshold)), details=(F.col("airlines"),),
    )


def congestion_alert(
    flow: DataFrame, as_of: dt.datetime, hour: int | None = None, threshold: float = 100
) -> DataFrame:
    """One alert when the mean passenger count of the hour is above the threshold."""
    stats = congestion_stats(flow, as_of.hour if hour is None else hour)
    crowded = stats.filter(F.col("avg_passengers") > threshold)
    return _alert(
        crowded, "CONGEST", "CONGESTION", CONGESTION_ALERT, as_of,
        message=(F.bround("avg_passengers", 0),), details=(F.col("max_passengers"),),
    )


def weather_alert(
    conditions: DataFrame, as_of: dt.datetime, adverse: list[str] = ALERT_WEATHER
) -> DataFrame:
    """One alert per adverse weather value that occurs."""
    seen = conditions.select("weather").filter(F.col("weather").isin(adverse)).distinct()
    return _alert(seen, "WEATHER", "WEATHER", WEATHER_ALERT, as_of, title=(F.col("weather"),))


def gate_overuse_alert(flights: DataFrame, as_of: dt.datetime, factor: float = 2) -> DataFrame:
    """One alert when the busiest gate is far above the mean."""
    overused = gate_load(flights).filter(F.col("max_flights") > F.col("avg_flights") * factor)
    gate = F.col("busiest_gate")
    return _alert(
        overused, "GATE", "RESOURCE", GATE_ALERT, as_of, title=(gate,),
        message=(F.col("max_flights"), F.bround("avg_flights", 1)), subject=gate,
    )


def all_alerts(
    flights: DataFrame,
    flow: DataFrame,
    conditions: DataFrame,
    as_of: dt.datetime,
    congestion_threshold: float = 100,
    gate_factor: float = 2,
) -> DataFrame:
    """The four checks in their fixed sequence (``seq``)."""
    checks = [
        delay_alert(flights, as_of),
        congestion_alert(flow, as_of, threshold=congestion_threshold),
        weather_alert(conditions, as_of),
        gate_overuse_alert(flights, as_of, gate_factor),
    ]
    return union_all([c.withColumn("seq", F.lit(i)) for i, c in enumerate(checks)])


def priority_rank(priority: Column | str) -> Column:
    return lookup(priority, PRIORITY_RANK, 4)


def alert_order(alerts: DataFrame) -> DataFrame:
    """Most urgent first; equal priorities keep the sequence of the checks."""
    return alerts.orderBy(priority_rank("priority"), "seq", "title")


def top_alert(alerts: DataFrame) -> DataFrame:
    """The banner: the first alert in order."""
    return alert_order(alerts).limit(1)


def recent_alerts(log: DataFrame, as_of: dt.datetime, hours: int = 24) -> DataFrame:
    """Logged alerts younger than the given number of hours."""
    return log.filter(F.col("timestamp") > F.lit(as_of - dt.timedelta(hours=hours)).cast("timestamp"))
