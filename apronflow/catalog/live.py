"""Queries: the streaming rules, run over the supplied tables until everything is consumed.

A window is emitted once the watermark (latest event time minus lateness) has passed its end,
so the SQL counts the same rows and keeps the closed windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampType

from apronflow.catalog import views
from apronflow.catalog.metrics import stable
from apronflow.catalog.registry import query
from apronflow.catalog.views import FLIGHTS_SQL, FLOW_SQL, with_views
from apronflow.functions.risk import predicted_risk
from apronflow.sources.scratch import scratch_path
from apronflow.streaming import rules, sinks


def source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = views.table(spark, folder, name).schema
    # a glob, since a stream takes a single file only through a pattern
    return sinks.stream_files(spark, f"{folder}/{name}.{{parquet}}", schema)


def finished(spark: SparkSession, start, schema) -> DataFrame:
    """Run a stream to the end of its input and read its output table."""
    path = scratch_path(spark, "stream")
    start(path, scratch_path(spark, "stream-state")).awaitTermination()
    return spark.read.schema(schema).parquet(path)


def table_of(stream: DataFrame) -> DataFrame:
    spark = stream.sparkSession
    return finished(spark, lambda p, c: sinks.start_table(stream, p, c, once=True), stream.schema)


@query(
    with_views(FLIGHTS_SQL)
    + """, counts AS (SELECT date_trunc('hour', departure_time) AS window_start, terminal, count(*) AS flights,
      count(*) FILTER (delay_minutes > 30) AS late_flights FROM flights GROUP BY 1, 2)
    SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, terminal, flights, late_flights, 'HIGH' AS priority
    FROM counts WHERE late_flights >= 3
      AND window_start + INTERVAL 1 HOUR <= (SELECT max(departure_time) - INTERVAL 1 HOUR FROM flights)"""
)
def stream_delay_alerts(spark, d):
    return table_of(rules.stream_delay_alerts(views.flights_from(source(spark, d, "events"))))


@query(
    with_views(FLOW_SQL)
    + """, placed AS (SELECT terminal, congestion, time_bucket(INTERVAL 30 MINUTE, timestamp) - to_minutes(CAST(30 * k AS INTEGER)) AS window_start
      FROM flow, range(4) AS r(k)),
    means AS (SELECT window_start, terminal, avg(congestion) AS mean FROM placed GROUP BY window_start, terminal)
    SELECT window_start, window_start + INTERVAL 2 HOUR AS window_end, terminal, CAST(CAST(mean AS FLOAT) AS DOUBLE) AS avg_congestion,
      'MEDIUM' AS priority FROM means WHERE mean > 75
      AND window_start + INTERVAL 2 HOUR <= (SELECT max(timestamp) - INTERVAL 1 HOUR FROM flow)"""
)
def stream_congestion(spark, d):
    return stable(table_of(rules.stream_congestion(views.flow_from(source(spark, d, "lineitem")))), "avg_congestion")


@query(with_views(FLIGHTS_SQL) + "SELECT DISTINCT terminal, gate, airline FROM flights")
def stream_dedupe(spark, d):
    f = views.flights_from(source(spark, d, "events"))
    # lateness beyond the span of the table: the state keeps every key
    unique = rules.stream_dedupe(f, ["terminal", "gate", "airline"], "departure_time", "400 days")
    return table_of(unique.select("terminal", "gate", "airline"))


@query(
    with_views(FLIGHTS_SQL)
    + """SELECT seq, departure_time, delay_minutes, CASE WHEN delay_minutes < 15 THEN 'LOW'
      WHEN delay_minutes < 30 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level FROM flights"""
)
def stream_history(spark, d):
    scored = views.flights_from(source(spark, d, "events")).select(
        "seq", "departure_time", "delay_minutes", predicted_risk("delay_minutes").alias("risk_level")
    )
    rows = finished(
        spark, lambda p, c: sinks.stream_history(scored, p, c, once=True), scored.schema
    )
    return rows.select(*scored.columns)


@query(
    with_views(FLIGHTS_SQL)
    + """, counts AS (SELECT date_trunc('hour', departure_time) AS window_start, gate, count(*) AS n FROM flights GROUP BY 1, 2),
    loads AS (SELECT window_start, max(n) AS max_flights, avg(n) AS mean, arg_min(gate, (-n, gate)) AS busiest_gate
      FROM counts GROUP BY window_start)
    SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, max_flights, CAST(CAST(mean AS FLOAT) AS DOUBLE) AS avg_flights, busiest_gate
    FROM loads WHERE max_flights > mean * 2
      AND window_start + INTERVAL 1 HOUR <= (SELECT max(departure_time) - INTERVAL 1 HOUR FROM flights)"""
)
def stream_gate_load(spark, d):
    f = views.flights_from(source(spark, d, "events"))
    schema = rules.overused_gates(rules.gate_window_counts(views.flights(spark, d))).schema
    rows = finished(spark, lambda p, c: sinks.stream_gate_load(f, p, c, once=True), schema)
    return stable(rows.select(*schema.names), "avg_flights")


@query(
    with_views(FLIGHTS_SQL)
    + """, arrivals AS (SELECT seq, departure_time, seq % 4 AS part FROM flights),
    marks AS (SELECT part, max(max(departure_time)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 10 DAY AS watermark
      FROM arrivals GROUP BY part)
    SELECT seq, departure_time, watermark, departure_time <= watermark AS is_late FROM arrivals JOIN marks USING (part) WHERE departure_time <= watermark
    UNION ALL SELECT seq, departure_time, NULL, false FROM arrivals JOIN marks USING (part) WHERE coalesce(departure_time > watermark, true)"""
)
def stream_late_rows(spark, d):
    """All flights, arriving in four files; those behind the watermark are told apart."""
    flights = views.flights(spark, d).select("seq", "departure_time")
    arriving = scratch_path(spark, "arrivals")
    for part in range(4):
        flights.filter(F.col("seq") % 4 == part).coalesce(1).write.parquet(f"{arriving}/part={part}")
    stream = sinks.stream_files(spark, f"{arriving}/*", flights.schema, 1)
    path = scratch_path(spark, "late")
    sinks.split_late(stream, "departure_time", path, scratch_path(spark, "stream-state"), "10 days", once=True).awaitTermination()
    late = spark.read.schema(StructType([*flights.schema.fields, StructField("watermark", TimestampType())])).parquet(f"{path}/late")
    rows = spark.read.schema(flights.schema).parquet(f"{path}/rows")
    told = rows.select("seq", "departure_time", F.lit(None).cast("timestamp").alias("watermark"), F.lit(False).alias("is_late"))
    return late.select(*late.columns[:3], F.lit(True).alias("is_late")).unionByName(told)
