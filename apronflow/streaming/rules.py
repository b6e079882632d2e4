"""Alert rules on event-time windows.

The rules are those of the batch checks; windows and watermarks bound the state. A window is
final once the watermark passes its end, so a rule fires once per window (append mode).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_delay_alerts(
    flights: DataFrame,
    threshold: float = 30,
    at_least: int = 3,
    window: str = "1 hour",
    lateness: str = "1 hour",
) -> DataFrame:
    """Windows and terminals with enough late flights."""
    late = F.count(F.when(F.col("delay_minutes") > threshold, 1))
    counts = (
        flights.withWatermark("departure_time", lateness)
        .groupBy(F.window("departure_time", window), "terminal")
        .agg(F.count(F.lit(1)).alias("flights"), late.alias("late_flights"))
    )
    return counts.filter(F.col("late_flights") >= at_least).select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "terminal",
        "flights",
        "late_flights",
        F.lit("HIGH").alias("priority"),
    )


def stream_congestion(
    flow: DataFrame,
    threshold: float = 75,
    window: str = "2 hours",
    slide: str = "30 minutes",
    lateness: str = "1 hour",
) -> DataFrame:
    """Sliding windows whose mean congestion stays above the threshold."""
    means = (
        flow.withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", window, slide), "terminal")
        .agg(F.avg("congestion").alias("avg_congestion"))
    )
    return means.filter(F.col("avg_congestion") > threshold).select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "terminal",
        "avg_congestion",
        F.lit("MEDIUM").alias("priority"),
    )


def stream_dedupe(
    rows: DataFrame, keys: list[str], time: str, lateness: str = "1 hour", salts: int = 16
) -> DataFrame:
    """First arrival of each key; a key is remembered until the watermark passes it.

    Copies are first removed per key and salt, where the salt is the number of the map task:
    a key that floods the stream is spread over ``salts`` tasks, and the final step sees at
    most that many copies of it per batch.
    """
    salted = rows.withColumn("_salt", F.spark_partition_id() % salts).withWatermark(time, lateness)
    thinned = salted.dropDuplicatesWithinWatermark([*keys, "_salt"])
    return thinned.dropDuplicatesWithinWatermark(keys).drop("_salt")


def gate_window_counts(
    flights: DataFrame, window: str = "1 hour", lateness: str = "1 hour"
) -> DataFrame:
    """Flights per final window and gate."""
    return (
        flights.withWatermark("departure_time", lateness)
        .groupBy(F.window("departure_time", window), "gate")
        .agg(F.count(F.lit(1)).alias("flights"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "gate",
            "flights",
        )
    )


def overused_gates(counts: DataFrame, factor: float = 2) -> DataFrame:
    """Windows whose busiest gate is far above the mean; all gates of a window arrive together."""
    loads = counts.groupBy("window_start", "window_end").agg(
        F.max("flights").alias("max_flights"),
        F.avg("flights").alias("avg_flights"),
        F.min_by("gate", F.struct(-F.col("flights"), F.col("gate"))).alias("busiest_gate"),
    )
    return loads.filter(F.col("max_flights") > F.col("avg_flights") * factor)
