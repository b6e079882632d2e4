"""Rule-based risk and delay scores for whole tables of flights."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apronflow.functions.calendar import is_peak, is_weekend_name, is_weekend_number
from apronflow.functions.risk import (
    delay_advice,
    delay_probability,
    predicted_risk,
    score_risk,
    weather_delay,
    weighted_risk,
)
from apronflow.operators.joins import join_group_mean


def statistical_risk(df: DataFrame) -> DataFrame:
    """risk_score and risk_level from hour, weather and numeric day_of_week (Monday = 0)."""
    score = weighted_risk(F.lit(30.0), is_peak("hour"), "weather", is_weekend_number("day_of_week"))
    return df.withColumn("risk_score", score).withColumn("risk_level", score_risk("risk_score"))


def operational_risk(df: DataFrame, flights: DataFrame, as_of: dt.date) -> DataFrame:
    """Risk with the terminal's mean delay as a factor; the weekend flag is that of ``as_of``."""
    known = join_group_mean(df, flights, ["terminal"], "delay_minutes", 15.0, "_mean")
    # an unseen terminal counts with factor 30, which is twice the default mean
    factor = F.least(F.col("_mean") * 2, F.lit(100.0))
    weekend = F.lit(int(as_of.weekday() >= 5))
    score = weighted_risk(factor, is_peak("hour"), "weather", weekend)
    return (
        known.withColumn("risk_score", score)
        .withColumn("risk_level", score_risk("risk_score"))
        .drop("_mean")
    )


def statistical_delay(df: DataFrame, flights: DataFrame) -> DataFrame:
    """predicted_delay from airline mean, weather, terminal and weekend (full day name)."""
    known = join_group_mean(df, flights, ["airline"], "delay_minutes", 20.0, "_mean")
    delay = (
        F.col("_mean") * 0.6
        + weather_delay("weather")
        + F.when(F.col("terminal") == "T3", 15).otherwise(5)
        + F.when(is_weekend_name("day") == 1, 10).otherwise(0)
    )
    return known.withColumn("predicted_delay", F.greatest(F.lit(0.0), delay)).drop("_mean")


def describe_prediction(df: DataFrame) -> DataFrame:
    """Probability, level and advice for a predicted_delay column (floored at 0)."""
    floored = df.withColumn("predicted_delay", F.greatest(F.lit(0.0), F.col("predicted_delay")))
    return floored.withColumns(
        {
            "delay_probability": delay_probability("predicted_delay"),
            "risk_level": predicted_risk("predicted_delay"),
        }
    ).withColumn("recommendation", delay_advice("risk_level"))
