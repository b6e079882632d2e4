"""Feature tables for the delay and risk models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apronflow.functions.calendar import is_night, is_peak, is_weekend_number
from apronflow.functions.risk import binary_risk, training_risk, weather_code
from apronflow.operators.dimensions import label_dim
from apronflow.operators.joins import encode
from apronflow.operators.prepare import impute_median, with_default_columns
from apronflow.sources.scratch import materialize

DELAY_FEATURES = [
    "airline_code", "weather_code", "terminal_code", "departure_hour", "is_peak_hour", "is_weekend",
]
WEATHER_DELAY_FEATURES = [
    "weather_code", "departure_hour", "is_peak_hour", "is_weekend", "airline_code",
]
RISK_FEATURES = [
    "airline_code", "terminal_code", "weather_code", "hour", "is_peak", "is_night",
    "is_weekend", "dow", "flight_length",
]
SENSOR_FEATURES = ["temperature", "wind_speed", "rain", "humidity"]
ONEHOT_FEATURES = ["carrier", "terminal", "day_of_week", "weather"]


def code_dims(df: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """Alphabetical code tables of the given columns, written once for training and scoring."""
    return {c: materialize(label_dim(df, c), f"codes-{c}") for c in columns}


def delay_features(flights: DataFrame, dims: dict[str, DataFrame] | None = None) -> DataFrame:
    """Codes for airline, weather and terminal added to hour, peak and weekend flags."""
    dims = dims or code_dims(flights, ["airline", "weather", "terminal"])
    coded = flights
    for column in ("airline", "weather", "terminal"):
        coded = encode(coded, dims[column], column, f"{column}_code")
    return coded


def risk_features(flights: DataFrame, dims: dict[str, DataFrame] | None = None) -> DataFrame:
    """Nine features and the training label; absent columns fall back to constants.

    ``day_of_week`` must be numeric here (Monday = 0).
    """
    d = with_default_columns(flights)
    have = set(flights.columns)
    if "delay_minutes" in have:
        d = d.withColumn("risk_label", training_risk("delay_minutes"))
    elif "delay" in have:
        d = d.withColumn("risk_label", binary_risk("delay"))
    else:
        raise ValueError("a delay_minutes or delay column is required")
    d = d.withColumns(
        {
            "is_peak": is_peak("hour"),
            "is_night": is_night("hour"),
            "is_weekend": is_weekend_number("dow"),
            "weather_code": weather_code("weather") if "weather" in have else F.lit(0),
        }
    )
    wanted = [c for c in ("carrier", "terminal") if c in d.columns]
    dims = dims or code_dims(d, wanted)
    for column, code in (("carrier", "airline_code"), ("terminal", "terminal_code")):
        d = encode(d, dims[column], column, code) if column in wanted else d.withColumn(code, F.lit(0))
    if "length" in have:
        d = impute_median(d, "length").withColumnRenamed("length", "flight_length")
    else:
        d = d.withColumn("flight_length", F.lit(120.0))
    return d
