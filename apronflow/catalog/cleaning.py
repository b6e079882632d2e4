"""Queries: profiles, parsing, flags, buckets, filters and preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from apronflow.catalog import views
from apronflow.catalog.metrics import stable
from apronflow.catalog.registry import query
from apronflow.catalog.views import (
    BAGGAGE_SQL,
    BTS_SQL,
    FLIGHTS_SQL,
    FLOW_SQL,
    PASSENGERS_SQL,
    with_views,
)
from apronflow.functions import calendar, risk
from apronflow.operators import prepare
from apronflow.plans import star_schema

FLIGHTS = with_views(FLIGHTS_SQL)


@query(
    FLIGHTS
    + """, sparse AS (SELECT flight_id, airline, CASE WHEN weather = 'Storm' THEN NULL ELSE gate END AS gate,
           delay_minutes FROM flights)
    SELECT count(*) AS row_count, 4 AS column_count, 0 AS position, 'flight_id' AS column_name,
      count(*) FILTER (flight_id IS NULL) AS null_count FROM sparse
    UNION ALL SELECT count(*), 4, 1, 'airline', count(*) FILTER (airline IS NULL) FROM sparse
    UNION ALL SELECT count(*), 4, 2, 'gate', count(*) FILTER (gate IS NULL) FROM sparse
    UNION ALL SELECT count(*), 4, 3, 'delay_minutes', count(*) FILTER (delay_minutes IS NULL) FROM sparse"""
)
def table_profile(spark, d):
    f = views.flights(spark, d)
    gate = F.when(F.col("weather") != "Storm", F.col("gate")).alias("gate")
    return prepare.table_profile(f.select("flight_id", "airline", gate, "delay_minutes"))


@query(
    """SELECT CAST(event_id AS VARCHAR) AS flight_id,
      CASE WHEN event_type = 'error' THEN NULL ELSE date_trunc('second', ts) END AS departure_time
    FROM events"""
)
def parse_timestamp(spark, d):
    events = views.table(spark, d, "events")
    written = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    as_text = events.select(
        F.col("event_id").cast("string").alias("flight_id"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("?"), written)).otherwise(written).alias("departure_time"),
    )
    return prepare.parse_timestamp(as_text, "departure_time")


@query(
    FLIGHTS
    + """SELECT flight_id, date, CAST(month(departure_time) AS INTEGER) AS month,
      monthname(departure_time) AS month_name, CAST(year(departure_time) AS INTEGER) AS year,
      departure_hour AS hour, dayname(departure_time) AS day_name FROM flights"""
)
def add_calendar(spark, d):
    f = views.flights(spark, d).select("flight_id", "departure_time")
    return prepare.add_calendar(f, "departure_time").drop("departure_time")


@query(
    """SELECT CAST((l_partkey // 60) % 24 AS INTEGER) AS hour, count(*) AS rows
    FROM lineitem GROUP BY 1"""
)
def hour_from_minutes(spark, d):
    hours = views.table(spark, d, "lineitem").select(calendar.hour_from_minutes("l_partkey").alias("hour"))
    return hours.groupBy("hour").agg(F.count(F.lit(1)).alias("rows"))


@query(
    FLIGHTS
    + """SELECT flight_id,
      CASE WHEN departure_hour BETWEEN 7 AND 9 OR departure_hour BETWEEN 17 AND 19 THEN 1 ELSE 0 END AS is_peak
    FROM flights"""
)
def is_peak(spark, d):
    return views.flights(spark, d).select("flight_id", calendar.is_peak("departure_hour").alias("is_peak"))


@query(
    FLIGHTS
    + """SELECT flight_id, CASE WHEN departure_hour < 6 OR departure_hour > 22 THEN 1 ELSE 0 END AS is_night
    FROM flights"""
)
def is_night(spark, d):
    return views.flights(spark, d).select("flight_id", calendar.is_night("departure_hour").alias("is_night"))


@query(
    FLIGHTS
    + """SELECT flight_id, CASE WHEN day IN ('Saturday', 'Sunday') THEN 1 ELSE 0 END AS by_name,
      CASE WHEN isodow(departure_time) - 1 IN (5, 6) THEN 1 ELSE 0 END AS by_number,
      CASE WHEN isodow(departure_time) >= 6 THEN 1 ELSE 0 END AS by_time
    FROM flights"""
)
def is_weekend(spark, d):
    return views.flights(spark, d).select(
        "flight_id",
        calendar.is_weekend_name("day").alias("by_name"),
        calendar.is_weekend_number(F.weekday("departure_time")).alias("by_number"),
        calendar.is_weekend_time("departure_time").alias("by_time"),
    )


@query(
    FLIGHTS
    + """SELECT flight_id, CASE WHEN delay_minutes <= 15 THEN 'Low' WHEN delay_minutes <= 30 THEN 'Medium'
      ELSE 'High' END AS risk FROM flights"""
)
def delay_risk(spark, d):
    return views.flights(spark, d).select("flight_id", risk.delay_risk("delay_minutes").alias("risk"))


@query(
    FLIGHTS
    + """SELECT flight_id, CASE WHEN delay_minutes < 15 THEN 'LOW' WHEN delay_minutes < 30 THEN 'MEDIUM'
      ELSE 'HIGH' END AS level,
      CASE WHEN delay_minutes < 15 THEN 'Normal operations'
        WHEN delay_minutes < 30 THEN 'Monitor closely, prepare for minor delays'
        ELSE 'Consider schedule adjustment, notify passengers' END AS recommendation FROM flights"""
)
def predicted_risk(spark, d):
    level = risk.predicted_risk("delay_minutes")
    return views.flights(spark, d).select(
        "flight_id", level.alias("level"), risk.delay_advice(level).alias("recommendation")
    )


@query(
    FLIGHTS
    + """, shifted AS (SELECT flight_id, delay_minutes - 5 AS delay FROM flights)
    SELECT flight_id, CASE WHEN delay > -1 AND delay <= 15 THEN 'LOW' WHEN delay > 15 AND delay <= 40 THEN 'MEDIUM'
      WHEN delay > 40 AND delay <= 9999 THEN 'HIGH' END AS risk_label
    FROM shifted WHERE delay > -1 AND delay <= 9999"""
)
def training_risk(spark, d):
    f = views.flights(spark, d)
    labelled = f.select("flight_id", risk.training_risk(F.col("delay_minutes") - 5).alias("risk_label"))
    return labelled.dropna(subset=["risk_label"])


@query(
    FLIGHTS
    + """SELECT flight_id, CASE WHEN gate_no = 1 THEN NULL WHEN delay_minutes > 15 THEN 'HIGH' ELSE 'LOW' END AS risk_label
    FROM flights"""
)
def binary_risk(spark, d):
    delayed = F.when(F.col("gate_no") == 1, 7).otherwise(risk.is_delayed("delay_minutes"))
    return views.flights(spark, d).select("flight_id", risk.binary_risk(delayed).alias("risk_label"))


@query(
    """SELECT event_id, CASE WHEN p > 0 AND p <= 40 THEN 'LOW' WHEN p > 40 AND p <= 70 THEN 'MEDIUM'
      WHEN p > 70 AND p <= 100 THEN 'HIGH' END AS level
    FROM (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS p FROM events)"""
)
def probability_risk(spark, d):
    percent = views.props_k()
    return views.table(spark, d, "events").select("event_id", risk.probability_risk(percent).alias("level"))


@query(
    """SELECT event_id, CASE WHEN p < 40 THEN 'LOW' WHEN p < 70 THEN 'MEDIUM' ELSE 'HIGH' END AS level
    FROM (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS p FROM events)"""
)
def score_risk(spark, d):
    score = views.props_k()
    return views.table(spark, d, "events").select("event_id", risk.score_risk(score).alias("level"))


@query(
    FLIGHTS
    + """SELECT flight_id, CAST(CAST(least(CAST(100 AS DOUBLE),
      greatest(delay_minutes - 10, CAST(0 AS DOUBLE)) / 90 * 100) AS FLOAT) AS DOUBLE) AS probability FROM flights"""
)
def delay_probability(spark, d):
    probability = risk.delay_probability(F.col("delay_minutes") - 10)
    return stable(views.flights(spark, d).select("flight_id", probability.alias("probability")), "probability")


@query(
    FLIGHTS
    + """SELECT flight_id, CASE WHEN delay_minutes > 15 THEN 1 ELSE 0 END AS is_delayed,
      CASE WHEN delay_minutes <= 15 THEN 1 ELSE 0 END AS on_time FROM flights"""
)
def is_delayed(spark, d):
    return views.flights(spark, d).select(
        "flight_id",
        risk.is_delayed("delay_minutes").alias("is_delayed"),
        risk.on_time("delay_minutes").alias("on_time"),
    )


MIXED_WEATHER_SQL = FLIGHTS + """, mixed AS (
  SELECT flight_id, CASE WHEN gate_no = 1 THEN NULL WHEN gate_no = 2 THEN 'Hail' ELSE weather END AS weather
  FROM flights)"""


def _mixed_weather(spark, d):
    """Weather with nulls and a value outside the tables."""
    mixed = F.when(F.col("gate_no") == 2, "Hail").when(F.col("gate_no") > 2, F.col("weather"))
    return views.flights(spark, d).select("flight_id", mixed.alias("weather"))


@query(
    MIXED_WEATHER_SQL
    + """SELECT flight_id, CASE weather WHEN 'Cloudy' THEN 1 WHEN 'Rain' THEN 2 WHEN 'Storm' THEN 3 ELSE 0 END AS code
    FROM mixed"""
)
def weather_code(spark, d):
    return _mixed_weather(spark, d).select("flight_id", risk.weather_code("weather").alias("code"))


@query(
    MIXED_WEATHER_SQL
    + """SELECT flight_id, CASE weather WHEN 'Clear' THEN 20 WHEN 'Cloudy' THEN 40 WHEN 'Rain' THEN 65
      WHEN 'Storm' THEN 85 ELSE 40 END AS factor FROM mixed"""
)
def weather_factor(spark, d):
    return _mixed_weather(spark, d).select("flight_id", risk.weather_factor("weather").alias("factor"))


@query(FLIGHTS + "SELECT flight_id, airline FROM flights WHERE airline IN ('TunisAir', 'Emirates')")
def filter_airlines(spark, d):
    return prepare.filter_airlines(views.flights(spark, d), ["TunisAir", "Emirates"]).select("flight_id", "airline")


@query(FLIGHTS + "SELECT flight_id, terminal FROM flights WHERE terminal = 'T2'")
def filter_terminal(spark, d):
    return prepare.filter_terminal(views.flights(spark, d), "T2").select("flight_id", "terminal")


@query(FLIGHTS + "SELECT flight_id, gate FROM flights WHERE weather <> 'Storm'")
def drop_incomplete(spark, d):
    sparse = F.when(F.col("weather") != "Storm", F.col("gate"))
    return prepare.drop_incomplete(views.flights(spark, d).select("flight_id", sparse.alias("gate")))


@query(
    FLIGHTS
    + """, sparse AS (SELECT flight_id, CASE WHEN gate_no = 1 THEN NULL ELSE delay_minutes END AS length FROM flights)
    SELECT flight_id, CAST(CAST(coalesce(length, (SELECT quantile_cont(length, CAST(0.5 AS DOUBLE)) FROM sparse)) AS FLOAT) AS DOUBLE) AS length
    FROM sparse"""
)
def impute_median(spark, d):
    sparse = F.when(F.col("gate_no") > 1, F.col("delay_minutes"))
    f = views.flights(spark, d).select("flight_id", sparse.alias("length"))
    return stable(prepare.impute_median(f, "length"), "length")


@query(
    with_views(FLIGHTS_SQL, BTS_SQL)
    + """SELECT carrier, origin, dest, crsdeptime, depdelay, arrdelay, dayname(flightdate) AS day_of_week,
      CASE WHEN depdelay > 15 THEN 1 ELSE 0 END AS delayed
    FROM bts WHERE carrier IN ('Qatar Airways', 'TunisAir', 'Emirates', 'Lufthansa')"""
)
def prepare_bts(spark, d):
    return prepare.prepare_bts(views.bts_flights(spark, d))


@query(
    FLIGHTS
    + """SELECT flight_id, airline, terminal, weather, day_of_week, departure_time, arrival_time, delay_minutes,
      delay_risk, departure_hour, is_peak_hour, is_weekend, date FROM flights"""
)
def fact_flights(spark, d):
    return star_schema.fact_flights(views.flights(spark, d))


@query(
    with_views(FLOW_SQL)
    + "SELECT timestamp, terminal, gate, passenger_count, congestion, hour, date FROM flow"
)
def fact_passengers(spark, d):
    return star_schema.fact_passengers(views.passenger_flow(spark, d))


@query(FLIGHTS + "SELECT flight_id, departure_hour FROM flights WHERE gate_no > 1")
def require_hour(spark, d):
    sparse = F.when(F.col("gate_no") > 1, F.col("departure_hour").cast("double"))
    return prepare.require_hour(views.flights(spark, d).select("flight_id", sparse.alias("departure_hour")))


ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "status"]


@query(
    with_views(BAGGAGE_SQL)
    + """SELECT baggage_id, passenger_id, status FROM (
      SELECT *, row_number() OVER (PARTITION BY baggage_id
        ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, status) AS rn FROM baggage) WHERE rn = 1"""
)
def dedupe_baggage(spark, d):
    return prepare.dedupe_first(views.baggage(spark, d), ["baggage_id"], ORDER).select(
        "baggage_id", "passenger_id", "status"
    )


@query(
    with_views(PASSENGERS_SQL)
    + """SELECT passenger_id, terminal, timestamp FROM (
      SELECT *, row_number() OVER (PARTITION BY passenger_id ORDER BY timestamp, terminal) AS rn
      FROM passengers) WHERE rn = 1"""
)
def dedupe_passengers(spark, d):
    return prepare.dedupe_first(views.passengers(spark, d), ["passenger_id"], ["timestamp", "terminal"])
