"""The library's input tables, derived from the supplied tables.

Each view exists twice: as a DataFrame for the operators, and as SQL text (common table
expressions) for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apronflow.functions.calendar import day_name, day_short, is_peak, is_weekend_time
from apronflow.functions.columns import lookup
from apronflow.functions.risk import delay_risk
from apronflow.plans.risk_scores import describe_prediction, statistical_delay

# Carriers by user_id % 5 and weather by event type
AIRLINES = ["TunisAir", "Air France", "Emirates", "Lufthansa", "Qatar Airways"]
EVENT_WEATHER = {
    "view": "Clear", "signup": "Clear", "click": "Cloudy", "purchase": "Rain", "error": "Storm",
}
BAG_STATUS = {"N": "delivered", "A": "delayed", "R": "lost"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def props_k() -> Column:
    """The number in ``{"k": n}``; the objects are flat, so no JSON parser is needed."""
    return F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("int")


def flights_from(events: DataFrame) -> DataFrame:
    gate_no = props_k() % 5 + 1
    ts = F.col("ts").cast("timestamp")
    base = events.select(
        F.col("event_id").alias("seq"),
        F.col("event_id").cast("string").alias("flight_id"),
        F.element_at(F.array(*[F.lit(a) for a in AIRLINES]), (F.col("user_id") % 5 + 1).cast("int")).alias("airline"),
        F.concat(F.lit("T"), F.col("user_id") % 3 + 1).alias("terminal"),
        gate_no.alias("gate_no"),
        lookup("event_type", EVENT_WEATHER, None).alias("weather"),
        ts.alias("departure_time"),
        (ts + F.make_dt_interval(mins=F.lit(60) + gate_no * 30)).alias("arrival_time"),
        F.hour(ts).alias("departure_hour"),
        day_short(ts).alias("day_of_week"),
        day_name(ts).alias("day"),
        F.to_date(ts).alias("date"),
        (F.col("value") * gate_no * 0.25).alias("delay_minutes"),
    )
    return base.withColumns(
        {
            "gate": F.concat("terminal", F.lit("-G"), "gate_no"),
            "is_peak_hour": is_peak("departure_hour"),
            "is_weekend": is_weekend_time("departure_time"),
            "delay_risk": delay_risk("delay_minutes"),
        }
    )


def flights(spark: SparkSession, folder: str) -> DataFrame:
    return flights_from(table(spark, folder, "events"))


def flow_from(lineitem: DataFrame) -> DataFrame:
    hour = (F.col("l_partkey") % 24).cast("int")
    terminal = F.concat(F.lit("T"), F.col("l_suppkey") % 3 + 1)
    return lineitem.select(
        (F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(hours=hour)).alias("timestamp"),
        terminal.alias("terminal"),
        F.concat(terminal, F.lit("-G"), F.col("l_linenumber") % 5 + 1).alias("gate"),
        F.col("l_quantity").cast("int").alias("passenger_count"),
        F.round(F.col("l_discount") * 1000).cast("int").alias("congestion"),
        hour.alias("hour"),
        F.to_date("l_shipdate").alias("date"),
    )


def passenger_flow(spark: SparkSession, folder: str) -> DataFrame:
    return flow_from(table(spark, folder, "lineitem"))


def baggage_from(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("baggage_id"),
        F.col("l_orderkey").cast("string").alias("passenger_id"),
        lookup("l_returnflag", BAG_STATUS, None).alias("status"),
        "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice",
    )


def baggage(spark: SparkSession, folder: str) -> DataFrame:
    return baggage_from(table(spark, folder, "lineitem"))


def passengers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("passenger_id"),
        F.concat(F.lit("T"), F.col("o_custkey") % 3 + 1).alias("terminal"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
    )


def weather_observations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_quantity").alias("temperature"),
        (F.col("l_tax") * 100).alias("wind_speed"),
        (F.col("l_discount") * 100).alias("rain"),
        (F.col("l_partkey") % 101).cast("double").alias("humidity"),
        (F.col("l_returnflag") == "R").cast("int").alias("is_delayed"),
    )


def bts_flights(spark: SparkSession, folder: str) -> DataFrame:
    """Public flight record shape: carriers, airports and delays from flights."""
    f = flights(spark, folder)
    return f.select(
        F.col("airline").alias("carrier"),
        F.col("terminal").alias("origin"),
        F.col("gate").alias("dest"),
        F.col("date").alias("flightdate"),
        (F.col("departure_hour") * 100).alias("crsdeptime"),
        F.col("delay_minutes").alias("depdelay"),
        (F.col("delay_minutes") * 0.5).alias("arrdelay"),
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    f = flights(spark, folder)
    scored = describe_prediction(statistical_delay(f, f))
    return scored.select(
        F.col("seq").alias("id"),
        F.col("departure_time").alias("created_at"),
        "airline", "terminal", "weather", "day",
        F.col("departure_hour").alias("hour"),
        "predicted_delay", "delay_probability", "risk_level", "recommendation",
    )


def cases(spark: SparkSession, folder: str, hours: int = 3) -> DataFrame:
    """What-if cases: the flights of each terminal, weather and start hour over all dates."""
    counts = (
        flights(spark, folder)
        .groupBy("terminal", "weather", F.col("departure_hour").alias("start_hour"))
        .agg(F.count(F.lit(1)).alias("flight_count"))
    )
    return counts.select(
        F.concat_ws("-", "terminal", "weather", "start_hour").alias("case_id"),
        "terminal", "weather", "flight_count", "start_hour",
        (F.col("start_hour") + hours).alias("end_hour"),
    )


def case_flights(spark: SparkSession, folder: str) -> DataFrame:
    """All flights: the base delay of the cases."""
    return flights(spark, folder)


# The same views as SQL -------------------------------------------------------------------

FLIGHTS_SQL = """
keyed AS (
  SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 5 + 1 AS gate_no FROM events
),
flights AS (
  SELECT event_id AS seq,
    CAST(event_id AS VARCHAR) AS flight_id,
    CASE user_id % 5 WHEN 0 THEN 'TunisAir' WHEN 1 THEN 'Air France' WHEN 2 THEN 'Emirates'
      WHEN 3 THEN 'Lufthansa' ELSE 'Qatar Airways' END AS airline,
    'T' || (user_id % 3 + 1) AS terminal,
    gate_no,
    CASE event_type WHEN 'view' THEN 'Clear' WHEN 'signup' THEN 'Clear' WHEN 'click' THEN 'Cloudy'
      WHEN 'purchase' THEN 'Rain' WHEN 'error' THEN 'Storm' END AS weather,
    ts AS departure_time,
    ts + to_minutes(60 + gate_no * 30) AS arrival_time,
    CAST(hour(ts) AS INTEGER) AS departure_hour,
    strftime(ts, '%a') AS day_of_week,
    dayname(ts) AS day,
    CAST(ts AS DATE) AS date,
    value * gate_no * CAST(0.25 AS DOUBLE) AS delay_minutes,
    'T' || (user_id % 3 + 1) || '-G' || gate_no AS gate,
    CASE WHEN hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 17 AND 19 THEN 1 ELSE 0 END AS is_peak_hour,
    CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
    CASE WHEN value * gate_no * CAST(0.25 AS DOUBLE) <= 15 THEN 'Low'
      WHEN value * gate_no * CAST(0.25 AS DOUBLE) <= 30 THEN 'Medium' ELSE 'High' END AS delay_risk
  FROM keyed
)"""

FLOW_SQL = """
flow AS (
  SELECT l_shipdate + to_hours(CAST(l_partkey % 24 AS INTEGER)) AS timestamp,
    'T' || (l_suppkey % 3 + 1) AS terminal,
    'T' || (l_suppkey % 3 + 1) || '-G' || (l_linenumber % 5 + 1) AS gate,
    CAST(l_quantity AS INTEGER) AS passenger_count,
    CAST(round(l_discount * 1000) AS INTEGER) AS congestion,
    CAST(l_partkey % 24 AS INTEGER) AS hour,
    CAST(l_shipdate AS DATE) AS date
  FROM lineitem
)"""

BAGGAGE_SQL = """
baggage AS (
  SELECT l_orderkey || '-' || l_linenumber AS baggage_id,
    CAST(l_orderkey AS VARCHAR) AS passenger_id,
    CASE l_returnflag WHEN 'N' THEN 'delivered' WHEN 'A' THEN 'delayed' WHEN 'R' THEN 'lost' END AS status,
    l_shipdate, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem
)"""

PASSENGERS_SQL = """
passengers AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS passenger_id,
    'T' || (o_custkey % 3 + 1) AS terminal,
    o_orderdate AS timestamp
  FROM orders
)"""

BTS_SQL = """
bts AS (
  SELECT airline AS carrier, terminal AS origin, gate AS dest, date AS flightdate,
    departure_hour * 100 AS crsdeptime, delay_minutes AS depdelay,
    delay_minutes * CAST(0.5 AS DOUBLE) AS arrdelay
  FROM flights
)"""

# statistical delay, probability, level and advice of every flight
PREDICTIONS_SQL = """
airline_means AS (SELECT airline, avg(delay_minutes) AS mean FROM flights GROUP BY airline),
delays AS (
  SELECT f.*, greatest(CAST(0 AS DOUBLE), m.mean * CAST(0.6 AS DOUBLE)
    + CASE weather WHEN 'Cloudy' THEN 5 WHEN 'Rain' THEN 15 WHEN 'Storm' THEN 30 ELSE 0 END
    + CASE WHEN terminal = 'T3' THEN 15 ELSE 5 END
    + CASE WHEN day IN ('Saturday', 'Sunday') THEN 10 ELSE 0 END) AS predicted_delay
  FROM flights f JOIN airline_means m USING (airline)
),
predictions AS (
  SELECT seq AS id, departure_time AS created_at, airline, terminal, weather, day,
    departure_hour AS hour, predicted_delay,
    least(CAST(100 AS DOUBLE), predicted_delay / 90 * 100) AS delay_probability,
    CASE WHEN predicted_delay < 15 THEN 'LOW' WHEN predicted_delay < 30 THEN 'MEDIUM'
      ELSE 'HIGH' END AS risk_level,
    CASE WHEN predicted_delay < 15 THEN 'Normal operations'
      WHEN predicted_delay < 30 THEN 'Monitor closely, prepare for minor delays'
      ELSE 'Consider schedule adjustment, notify passengers' END AS recommendation
  FROM delays
)"""

CASES_SQL = """
cases AS (
  SELECT terminal || '-' || weather || '-' || departure_hour AS case_id, terminal, weather,
    count(*) AS flight_count, departure_hour AS start_hour, departure_hour + 3 AS end_hour
  FROM flights GROUP BY terminal, weather, departure_hour
),
base AS (SELECT terminal, avg(delay_minutes) AS base_delay FROM flights GROUP BY terminal),
sized AS (
  SELECT c.*, base_delay,
    CASE terminal WHEN 'T1' THEN 8 WHEN 'T2' THEN 6 WHEN 'T3' THEN 5 ELSE 6 END AS gate_count,
    greatest(1, end_hour - start_hour) AS window_hours,
    base_delay * CAST(CASE weather WHEN 'Cloudy' THEN 1.15 WHEN 'Rain' THEN 1.40 WHEN 'Storm' THEN 1.85
      ELSE 1.0 END AS DOUBLE) AS adjusted_delay,
    CAST(CASE weather WHEN 'Cloudy' THEN 1.1 WHEN 'Rain' THEN 1.3 WHEN 'Storm' THEN 1.8 ELSE 1.0 END
      AS DOUBLE) AS cascade_factor,
    CAST(CASE weather WHEN 'Cloudy' THEN 0.03 WHEN 'Rain' THEN 0.08 WHEN 'Storm' THEN 0.22 ELSE 0.01 END
      AS DOUBLE) AS cancel_share
  FROM cases c JOIN base USING (terminal)
),
loaded AS (
  SELECT *, gate_count * 3 * window_hours AS capacity,
    flight_count / CAST(gate_count * 3 * window_hours AS DOUBLE) AS overload
  FROM sized
),
cascaded AS (
  SELECT *, CASE WHEN overload > CAST(0.8 AS DOUBLE)
    THEN (overload - CAST(0.8 AS DOUBLE)) * flight_count * (45 * cascade_factor) / gate_count
    ELSE CAST(0 AS DOUBLE) END AS cascade_delay
  FROM loaded
),
totalled AS (
  SELECT *, adjusted_delay + cascade_delay AS total_delay,
    CAST(round_even(flight_count * cancel_share, 0) AS BIGINT) AS cancellations,
    CAST(round_even(flight_count * cancel_share * CAST(0.4 AS DOUBLE), 0) AS BIGINT) AS diversions,
    flight_count * 180 AS affected_passengers
  FROM cascaded
),
impact AS (
  SELECT *, CASE WHEN total_delay > 60 OR overload > CAST(1.2 AS DOUBLE) THEN 'CRITICAL'
      WHEN total_delay > 35 OR overload > CAST(0.9 AS DOUBLE) THEN 'HIGH'
      WHEN total_delay > 20 OR overload > CAST(0.7 AS DOUBLE) THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
  FROM totalled
)"""


def with_views(*parts: str) -> str:
    return "WITH " + ",".join(parts)
