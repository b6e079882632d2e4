"""Capacity evaluation of tables of what-if cases.

A case is (case_id, terminal, weather, flight_count, start_hour, end_hour). Terminal and weather
figures are fixed tables inside the expressions; only the mean delay per terminal is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apronflow.functions.columns import lookup, text
from apronflow.functions.fixed_values import (
    CASE_ADVICE,
    DEFAULT_GATES,
    FLIGHTS_PER_GATE_HOUR,
    PASSENGERS_PER_FLIGHT,
    TERMINAL_GATES,
    TURNAROUND_MINUTES,
    WEATHER_CASE_CANCEL,
    WEATHER_CASE_CASCADE,
    WEATHER_CASE_DELAY,
)
from apronflow.operators.joins import join_group_mean


def load_status(load: Column) -> Column:
    return F.when(load > 1, "OVERLOADED").when(load > 0.8, "HIGH").otherwise("NORMAL")


def gate_count(terminal: Column | str) -> Column:
    return lookup(terminal, TERMINAL_GATES, DEFAULT_GATES)


def terminal_hour_load(flights: DataFrame, per_gate: float = FLIGHTS_PER_GATE_HOUR) -> DataFrame:
    """Flights per terminal, date and hour against the terminal's hourly gate capacity."""
    counts = (
        flights.dropna(subset=["terminal", "date", "departure_hour"])
        .groupBy("terminal", "date", "departure_hour")
        .agg(F.count(F.lit(1)).alias("flights"))
    )
    capacity = gate_count("terminal") * per_gate
    return counts.select(
        "*",
        capacity.alias("capacity"),
        F.bround(F.col("flights") / capacity, 4).alias("load"),
        load_status(F.col("flights") / capacity).alias("status"),
    )


def case_level(delay: Column, overload: Column) -> Column:
    """CRITICAL, HIGH, MEDIUM or LOW from total delay minutes and overload ratio."""
    limits = [("CRITICAL", 60, 1.2), ("HIGH", 35, 0.9), ("MEDIUM", 20, 0.7)]
    chain = F
    for level, minutes, ratio in limits:
        chain = chain.when((delay > minutes) | (overload > ratio), level)
    return chain.otherwise("LOW")


def case_impact(cases: DataFrame, flights: DataFrame, default_delay: float = 25.0) -> DataFrame:
    """Unrounded impact figures per case; the base delay is the terminal's mean delay."""
    known = join_group_mean(cases, flights, ["terminal"], "delay_minutes", default_delay, "base_delay")
    n = F.col("flight_count")
    hours = F.greatest(F.lit(1), F.col("end_hour") - F.col("start_hour"))
    sized = known.withColumns(
        {
            "gate_count": gate_count("terminal"),
            "window_hours": hours,
            "capacity": gate_count("terminal") * FLIGHTS_PER_GATE_HOUR * hours,
            "adjusted_delay": F.col("base_delay") * lookup("weather", WEATHER_CASE_DELAY, 1.0),
        }
    )
    loaded = sized.withColumn("overload", n / F.greatest(F.col("capacity"), F.lit(1)))
    excess = (F.col("overload") - 0.8) * n
    spread = TURNAROUND_MINUTES * lookup("weather", WEATHER_CASE_CASCADE, 1.0)
    cascade = F.when(
        F.col("overload") > 0.8, excess * spread / F.greatest(F.col("gate_count"), F.lit(1))
    ).otherwise(0.0)
    cancel = n * lookup("weather", WEATHER_CASE_CANCEL, WEATHER_CASE_CANCEL["Clear"])
    return (
        loaded.withColumn("cascade_delay", cascade)
        .withColumn("total_delay", F.col("adjusted_delay") + F.col("cascade_delay"))
        .withColumns(
            {
                "cancellations": F.bround(cancel, 0).cast("long"),
                "diversions": F.bround(cancel * 0.4, 0).cast("long"),
                "affected_passengers": n * PASSENGERS_PER_FLIGHT,
                "risk_level": case_level(F.col("total_delay"), F.col("overload")),
            }
        )
    )


def case_report(impact: DataFrame) -> DataFrame:
    """Rounded report columns of ``case_impact``."""
    total, overload, n = F.col("total_delay"), F.col("overload"), F.col("flight_count")
    window = F.format_string("%d:00 – %d:00", F.col("start_hour"), F.col("end_hour"))
    return impact.select(
        "case_id", "terminal", "weather", "flight_count", window.alias("window"),
        "gate_count", "capacity", "risk_level",
        F.bround(total, 1).alias("avg_delay_min"),
        F.bround(total * n, 0).cast("long").alias("total_delay_minutes"),
        F.bround("cascade_delay", 1).alias("cascade_delay_min"),
        F.bround(F.least(overload * 85, F.lit(99.0)), 1).alias("gate_overload_pct"),
        F.bround(F.least(overload * 100, F.lit(100.0)), 1).alias("terminal_capacity_pct"),
        "cancellations", "diversions", "affected_passengers",
    )


def case_hourly(impact: DataFrame) -> DataFrame:
    """One row per hour of a case's window; none when the window is empty."""
    hourly = F.col("flight_count") / F.col("window_hours")
    load = hourly / (F.col("gate_count") * FLIGHTS_PER_GATE_HOUR)
    delay = F.col("adjusted_delay") * (1 + F.greatest(F.lit(0.0), load - 0.7) * 0.5)
    hours = F.sequence(F.col("start_hour"), F.col("end_hour") - 1)
    return impact.filter("end_hour > start_hour").select(
        "case_id",
        F.explode(hours).alias("hour"),
        F.bround(hourly, 1).alias("flights"),
        F.bround(delay, 1).alias("avg_delay"),
        F.bround(F.least(load * 100, F.lit(100.0)), 1).alias("gate_load_pct"),
        load_status(load).alias("status"),
    )


def case_recommendations(impact: DataFrame) -> DataFrame:
    """Ordered advice per case; one LOW row when nothing applies."""
    overload, total, n = F.col("overload"), F.col("total_delay"), F.col("flight_count")
    terminal, weather = F.col("terminal"), F.col("weather")
    whole = lambda value: F.bround(value, 0).cast("long")
    extra = F.greatest(F.lit(1), whole((overload - 0.8) * F.col("gate_count")))

    def advice(key: str, action: tuple = (), impact_args: tuple = ()) -> Column:
        priority, action_text, impact_text = CASE_ADVICE[key]
        return F.struct(
            F.lit(priority).alias("priority"),
            text(action_text, *action).alias("action"),
            text(impact_text, *impact_args).alias("impact"),
        )

    rules = [
        (overload > 1.0, advice("redistribute", (whole((overload - 1) * n),))),
        (weather.isin("Rain", "Storm"), advice("weather", (terminal,), (weather,))),
        (total > 40, advice("notify", (), (whole(total),))),
        (overload > 0.8, advice("gates", (extra, terminal))),
        (F.col("cancellations") > 0, advice("rebook", (F.col("cancellations"),))),
        ((F.col("window_hours") <= 2) & (n > 8), advice("stagger")),
    ]
    given = F.filter(F.array(*[F.when(c, a) for c, a in rules]), lambda a: a.isNotNull())
    listed = F.when(F.size(given) > 0, given).otherwise(F.array(advice("none")))
    return impact.select("case_id", F.posexplode(listed).alias("position", "advice")).select(
        "case_id", "position", "advice.priority", "advice.action", "advice.impact"
    )
