"""Table schemas. Types are declared, never inferred from data."""

from __future__ import annotations

from pyspark.sql.types import StructType


def _schema(columns: str) -> StructType:
    """Struct of comma-separated ``name type`` entries; works before a session exists."""
    struct = StructType()
    for column in columns.split(","):
        name, kind = column.split()
        struct.add(name, kind)
    return struct


FLIGHTS = _schema(
    """flight_id string, airline string, terminal string, gate string, weather string,
    day_of_week string, departure_time string, arrival_time string, departure_hour integer,
    is_peak_hour integer, is_weekend integer, delay_minutes double, delay_risk string"""
)
BTS_FLIGHTS = _schema(
    """Carrier string, Origin string, Dest string, FlightDate date, CRSDepTime integer,
    DepDelay double, ArrDelay double"""
)
PASSENGER_FLOW = _schema(
    """timestamp string, terminal string, gate string, passenger_count integer,
    congestion string, hour integer"""
)
PASSENGERS = _schema("passenger_id string, terminal string, gate string, timestamp string")
BAGGAGE = _schema("baggage_id string, passenger_id string, status string")
WEATHER_OBSERVATIONS = _schema(
    "temperature double, wind_speed double, rain double, humidity double, is_delayed integer"
)

RAW_TABLES = {
    "flights": FLIGHTS,
    "bts_flights": BTS_FLIGHTS,
    "passenger_flow": PASSENGER_FLOW,
    "passengers": PASSENGERS,
    "baggage": BAGGAGE,
    "weather_observations": WEATHER_OBSERVATIONS,
}

PREDICTIONS = _schema(
    """id long, created_at timestamp, airline string, terminal string,
    weather string, day string, hour integer, predicted_delay double, delay_probability double,
    risk_level string, recommendation string, model_used string, explanation string"""
)
RISK_EVENTS = _schema(
    """id long, created_at timestamp, terminal string, hour integer, weather string,
    risk_score double, risk_level string"""
)
FORECAST_RUNS = _schema(
    """id long, created_at timestamp, weather string, hours_ahead integer,
    forecast_avg double, forecast_max double, peak_warnings_count long"""
)

HISTORY_TABLES = {
    "predictions": PREDICTIONS,
    "risk_events": RISK_EVENTS,
    "forecast_runs": FORECAST_RUNS,
}
