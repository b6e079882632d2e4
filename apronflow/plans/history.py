"""Analytics over the history tables. Rounding is half away from zero here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recent(table: DataFrame, limit: int = 50) -> DataFrame:
    """Newest rows first.

    A top-n over two columns finds the oldest wanted time; only rows from that time on are read
    in full, and row groups before it are skipped.
    """
    newest = [F.desc("created_at"), F.desc("id")]
    keys = table.select("created_at", "id").orderBy(*newest).limit(limit)
    oldest = keys.select(F.min("created_at")).scalar()
    return table.filter(F.col("created_at") >= oldest).orderBy(*newest).limit(limit)


def prediction_stats(predictions: DataFrame) -> DataFrame:
    level = lambda name: F.sum((F.col("risk_level") == name).cast("int"))
    return predictions.agg(
        F.count("*").alias("total"),
        F.round(F.avg("predicted_delay"), 1).alias("avg_delay"),
        F.round(F.avg("delay_probability"), 1).alias("avg_probability"),
        level("HIGH").alias("high_risk_count"),
        level("MEDIUM").alias("medium_risk_count"),
        level("LOW").alias("low_risk_count"),
    )


def predictions_by_airline(predictions: DataFrame) -> DataFrame:
    return (
        predictions.groupBy("airline")
        .agg(
            F.count("*").alias("total"),
            F.round(F.avg("predicted_delay"), 1).alias("avg_delay"),
            F.round(F.avg("delay_probability"), 1).alias("avg_probability"),
        )
        .orderBy(F.desc("avg_delay"), "airline")
    )


def predictions_by_hour(predictions: DataFrame) -> DataFrame:
    return (
        predictions.groupBy("hour")
        .agg(F.count("*").alias("total"), F.round(F.avg("predicted_delay"), 1).alias("avg_delay"))
        .orderBy("hour")
    )
