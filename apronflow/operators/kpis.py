"""Aggregated metrics of flights and passenger flow.

Every metric is one partial aggregation: combined on the map side, one row per group and task
in the shuffle. Null group keys are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apronflow.functions.risk import delay_risk
from apronflow.operators.joins import reindex_days
from apronflow.operators.quantiles import exact_quantiles, sketched_quantiles


def share_of(condition: Column) -> Column:
    """Percent of all rows of the group for which the condition holds."""
    return F.try_divide(F.count(F.when(condition, 1)), F.count("*")) * 100


def home_kpis(flights: DataFrame) -> DataFrame:
    delay = F.col("delay_minutes")
    return flights.agg(
        F.count("*").alias("total_flights"),
        F.bround(F.avg(delay), 1).alias("avg_delay"),
        F.count(F.when(delay_risk(delay) == "High", 1)).alias("high_risk"),
        F.bround(share_of(delay <= 15), 1).alias("on_time_pct"),
    )


def daily_summary(flights: DataFrame) -> DataFrame:
    return (
        flights.dropna(subset=["date"])
        .groupBy("date")
        .agg(
            F.count("flight_id").alias("total_flights"),
            F.avg("delay_minutes").alias("avg_delay"),
            F.max("delay_minutes").alias("max_delay"),
            F.sum("delay_minutes").alias("total_delay"),
        )
    )


def airline_summary(flights: DataFrame) -> DataFrame:
    """The on-time rate counts every row of the airline, also those without a flight id."""
    return (
        flights.dropna(subset=["airline"])
        .groupBy("airline")
        .agg(
            F.count("flight_id").alias("total_flights"),
            F.avg("delay_minutes").alias("avg_delay"),
            F.max("delay_minutes").alias("max_delay"),
            share_of(F.col("delay_minutes") <= 15).alias("on_time_rate"),
        )
    )


def terminal_flights(flights: DataFrame) -> DataFrame:
    return (
        flights.dropna(subset=["terminal"])
        .groupBy("terminal")
        .agg(F.count("flight_id").alias("total_flights"), F.avg("delay_minutes").alias("avg_delay"))
    )


def terminal_passengers(flow: DataFrame) -> DataFrame:
    return (
        flow.dropna(subset=["terminal"])
        .groupBy("terminal")
        .agg(F.sum("passenger_count").alias("total_passengers"))
    )


def terminal_summary(flights: DataFrame, flow: DataFrame) -> DataFrame:
    """Both sides aggregated before the join; terminals known to one side only are dropped."""
    return terminal_flights(flights).join(terminal_passengers(flow), "terminal")


def avg_delay_by(flights: DataFrame, key: str) -> DataFrame:
    return flights.dropna(subset=[key]).groupBy(key).agg(F.avg("delay_minutes").alias("avg_delay"))


def avg_delay_by_airline(flights: DataFrame) -> DataFrame:
    return avg_delay_by(flights, "airline").orderBy(F.desc("avg_delay"), "airline")


def avg_delay_by_hour(flights: DataFrame) -> DataFrame:
    return avg_delay_by(flights, "departure_hour").orderBy("departure_hour")


def avg_delay_by_day(flights: DataFrame) -> DataFrame:
    """Mon..Sun, null for days without flights."""
    return reindex_days(avg_delay_by(flights, "day_of_week"), "day_of_week", "avg_delay").orderBy("day_no")


def risk_distribution(flights: DataFrame) -> DataFrame:
    """Count and percent per delay risk (three rows, so the total is a three-row window)."""
    counts = flights.groupBy(delay_risk("delay_minutes").alias("risk")).agg(F.count("*").alias("flights"))
    total = F.sum("flights").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("share", F.bround(F.col("flights") / total * 100, 2))


def delay_histogram(flights: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width bins between minimum and maximum; the maximum falls in the last bin."""
    delays = flights.select("delay_minutes").dropna()
    span = delays.select(
        F.struct(F.min("delay_minutes").alias("low"), F.max("delay_minutes").alias("high"))
    ).scalar()
    low, high = span.getField("low"), span.getField("high")
    numbered = delays.select(
        F.when(low == high, 1)
        .otherwise(F.least(F.width_bucket("delay_minutes", low, high, F.lit(bins)), F.lit(bins)))
        .cast("int")
        .alias("bin")
    )
    counts = numbered.groupBy("bin").agg(F.count("*").alias("flights"))
    width = (high - low) / bins
    return counts.select(
        "bin",
        F.bround(low + width * (F.col("bin") - 1), 6).alias("bin_start"),
        F.bround(low + width * F.col("bin"), 6).alias("bin_end"),
        "flights",
    )


QUARTILES = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}


def delay_quartiles(flights: DataFrame, by: str, approximate: bool = False) -> DataFrame:
    """Box-plot figures per group; ``approximate`` trades exactness for a single pass."""
    method = sketched_quantiles if approximate else exact_quantiles
    return method(flights, "delay_minutes", QUARTILES, [by])


def passenger_heatmap(flow: DataFrame) -> DataFrame:
    return (
        flow.dropna(subset=["hour", "gate"])
        .groupBy("hour", "gate")
        .agg(F.sum("passenger_count").alias("passengers"))
    )


def hourly_passenger_totals(flow: DataFrame) -> DataFrame:
    return flow.dropna(subset=["hour"]).groupBy("hour").agg(F.sum("passenger_count").alias("passengers"))


def peak_hours(flow: DataFrame, k: int = 3) -> DataFrame:
    """The k hours with most passengers; ties go to the earlier hour."""
    return hourly_passenger_totals(flow).orderBy(F.desc("passengers"), "hour").limit(k)


def congestion_stats(flow: DataFrame, hour: int) -> DataFrame:
    return flow.filter(F.col("hour") == hour).agg(
        F.max("passenger_count").alias("max_passengers"),
        F.avg("passenger_count").alias("avg_passengers"),
    )


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.dropna(subset=[label]).groupBy(label).agg(F.count("*").alias("rows"))


def sample_points(flights: DataFrame, n: int = 500) -> DataFrame:
    """A reproducible sample of n flights: the smallest id hashes (a distributed top-n)."""
    return (
        flights.select("flight_id", "departure_hour", "delay_minutes", "weather")
        .orderBy(F.md5("flight_id"), "flight_id")
        .limit(n)
    )
