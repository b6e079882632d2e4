"""Queries: joins, aggregations, dimensions, gates, top-k."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from apronflow.catalog import views
from apronflow.catalog.registry import query
from apronflow.catalog.views import BAGGAGE_SQL, FLIGHTS_SQL, FLOW_SQL, PASSENGERS_SQL, with_views
from apronflow.functions import risk
from apronflow.operators import dimensions, expand, gates, joins, kpis, prepare, quantiles
from apronflow.plans import star_schema
from apronflow.sources import writers
from apronflow.sources.scratch import scratch_path

FLIGHTS = with_views(FLIGHTS_SQL)
FLOW = with_views(FLOW_SQL)
BOTH = with_views(FLIGHTS_SQL, FLOW_SQL)


def stable(df, *names):
    """Doubles through FLOAT and back, so the order of summation cannot show in a comparison.

    The SQL texts do the same. Decimal rounding would not help: means often end exactly
    between two decimals.
    """
    return df.withColumns({name: F.col(name).cast("float").cast("double") for name in names})


# joins -----------------------------------------------------------------------------------

TERMINAL_SUMMARY = """ SELECT terminal, total_flights, CAST(CAST(avg_delay AS FLOAT) AS DOUBLE) AS avg_delay, total_passengers
    FROM (SELECT terminal, count(flight_id) AS total_flights, avg(delay_minutes) AS avg_delay FROM {flights} GROUP BY terminal)
    JOIN (SELECT terminal, CAST(sum(passenger_count) AS BIGINT) AS total_passengers FROM flow GROUP BY terminal) USING (terminal)"""


@query(BOTH + TERMINAL_SUMMARY.format(flights="flights"))
def terminal_summary(spark, d):
    summary = kpis.terminal_summary(views.flights(spark, d), views.passenger_flow(spark, d))
    return stable(summary, "avg_delay")


@query(
    FLIGHTS
    + """, codes AS (SELECT airline, CAST(row_number() OVER (ORDER BY airline) - 1 AS INTEGER) AS code
      FROM (SELECT DISTINCT airline FROM flights))
    SELECT flight_id, airline, coalesce(code, 0) AS airline_code FROM flights LEFT JOIN codes USING (airline)"""
)
def encode(spark, d):
    f = views.flights(spark, d)
    return joins.encode(f.select("flight_id", "airline"), dimensions.label_dim(f, "airline"), "airline", "airline_code")


@query(
    FLIGHTS
    + """, means AS (SELECT terminal, avg(delay_minutes) AS mean FROM flights GROUP BY terminal)
    SELECT flight_id, terminal, CAST(CAST(coalesce(mean, 20) AS FLOAT) AS DOUBLE) AS terminal_mean
    FROM flights LEFT JOIN means USING (terminal)"""
)
def join_group_mean(spark, d):
    f = views.flights(spark, d)
    joined = joins.join_group_mean(
        f.select("flight_id", "terminal"), f, ["terminal"], "delay_minutes", 20.0, "terminal_mean"
    )
    return stable(joined, "terminal_mean")


@query(
    FLIGHTS
    + """, means AS (SELECT terminal, departure_hour AS hour, avg(delay_minutes) AS value FROM flights GROUP BY 1, 2),
    grid AS (SELECT terminal, CAST(h AS INTEGER) AS hour FROM (SELECT DISTINCT terminal FROM means), range(24) AS r(h))
    SELECT terminal, hour, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM grid LEFT JOIN means USING (terminal, hour)"""
)
def reindex_hours(spark, d):
    f = views.flights(spark, d)
    means = f.groupBy("terminal", F.col("departure_hour").alias("hour")).agg(F.avg("delay_minutes").alias("value"))
    return stable(joins.reindex_hours(means, "hour", "value", ["terminal"]), "value")


@query(
    FLIGHTS
    + """, means AS (SELECT day_of_week, avg(delay_minutes) AS value FROM flights GROUP BY 1),
    grid AS (SELECT * FROM (VALUES (0,'Mon'),(1,'Tue'),(2,'Wed'),(3,'Thu'),(4,'Fri'),(5,'Sat'),(6,'Sun')) AS t(day_no, day_of_week))
    SELECT day_no, day_of_week, CAST(CAST(coalesce(value, 25) AS FLOAT) AS DOUBLE) AS value FROM grid LEFT JOIN means USING (day_of_week)"""
)
def reindex_days(spark, d):
    means = kpis.avg_delay_by(views.flights(spark, d), "day_of_week")
    week = joins.reindex_days(means.withColumnRenamed("avg_delay", "value"), "day_of_week", "value", default=25.0)
    return stable(week, "value")


@query(
    with_views(BAGGAGE_SQL, PASSENGERS_SQL)
    + """SELECT terminal, status, count(*) AS bags FROM baggage JOIN passengers USING (passenger_id)
    GROUP BY terminal, status"""
)
def baggage_by_terminal(spark, d):
    return joins.baggage_by_terminal(views.baggage(spark, d), views.passengers(spark, d))


# gates -----------------------------------------------------------------------------------

GATES_SQL = """,
raw_gates AS (SELECT gate, count(flight_id) AS flight_count, avg(delay_minutes) AS avg_delay FROM flights GROUP BY gate),
unclipped AS (SELECT gate, flight_count, avg_delay,
  flight_count / CAST((SELECT max(flight_count) FROM raw_gates) AS DOUBLE) * 100 AS utilization,
  100 - avg_delay AS efficiency FROM raw_gates),
clipped AS (SELECT gate, flight_count, avg_delay, round_even(utilization, 1) AS utilization,
  round_even(least(greatest(efficiency, 0), 100), 1) AS efficiency FROM unclipped)"""

GATES = FLIGHTS + GATES_SQL


@query(
    GATES + """SELECT gate, flight_count, CAST(CAST(avg_delay AS FLOAT) AS DOUBLE) AS avg_delay, utilization, efficiency FROM clipped"""
)
def gate_performance(spark, d):
    return stable(gates.gate_performance(views.flights(spark, d)), "avg_delay")


@query(
    GATES
    + """SELECT gate, flight_count, CAST(CAST(avg_delay AS FLOAT) AS DOUBLE) AS avg_delay, CAST(CAST(utilization AS FLOAT) AS DOUBLE) AS utilization,
      CAST(CAST(efficiency AS FLOAT) AS DOUBLE) AS efficiency FROM unclipped"""
)
def gate_performance_unclipped(spark, d):
    performance = gates.gate_performance(views.flights(spark, d), clip=False)
    return stable(performance, "avg_delay", "utilization", "efficiency")


@query(
    GATES
    + """SELECT gate, efficiency, utilization FROM clipped ORDER BY efficiency DESC, gate"""
)
def gate_ranking(spark, d):
    performance = gates.gate_performance(views.flights(spark, d))
    return gates.gate_ranking(performance).select("gate", "efficiency", "utilization")


PAIRS_SQL = """,
worst AS (SELECT CAST(row_number() OVER (ORDER BY efficiency {worst}, gate) AS INTEGER) AS position, gate AS worst_gate,
  avg_delay AS worst_delay, efficiency AS worst_efficiency FROM {source} WHERE efficiency < 60),
best AS (SELECT CAST(row_number() OVER (ORDER BY efficiency DESC, gate) AS INTEGER) AS position, gate AS best_gate,
  avg_delay AS best_delay, efficiency AS best_efficiency FROM {source} WHERE efficiency > {above})"""


def _pairs_sql(source="clipped", above=85, worst="DESC"):
    return GATES + PAIRS_SQL.format(source=source, above=above, worst=worst)


PAIR_COLUMNS = """SELECT position, worst_gate, CAST(CAST(worst_delay AS FLOAT) AS DOUBLE) AS worst_delay, worst_efficiency, best_gate,
      CAST(CAST(best_delay AS FLOAT) AS DOUBLE) AS best_delay, best_efficiency FROM worst JOIN best USING (position) WHERE position <= 2"""


@query(_pairs_sql() + PAIR_COLUMNS)
def pair_gates(spark, d):
    pairs = gates.pair_gates(gates.gate_performance(views.flights(spark, d)))
    return stable(pairs, "worst_delay", "best_delay")


@query(_pairs_sql(worst="ASC") + PAIR_COLUMNS)
def pair_gates_worst_first(spark, d):
    pairs = gates.pair_gates(gates.gate_performance(views.flights(spark, d)), worst_first=True)
    return stable(pairs, "worst_delay", "best_delay")


@query(
    _pairs_sql()
    + """SELECT CAST(position AS INTEGER) AS seq, '\U0001f500 Reassign flights from ' || worst_gate || ' to ' || best_gate AS action,
      printf('%s has %.1f min avg delay', worst_gate, round_even(worst_delay, 1)) AS reason,
      'Expected 25–40% delay reduction' AS impact,
      CASE WHEN worst_efficiency < 50 THEN 'HIGH' ELSE 'MEDIUM' END AS priority
    FROM worst JOIN best USING (position) WHERE position <= 2
    UNION ALL SELECT 100, '\U0001f4ca Implement dynamic gate assignment', 'Static assignment causes bottlenecks',
      'Improve utilization by 15–20%', 'MEDIUM'
    UNION ALL SELECT 101, '\U0001f552 Stagger schedules at peak gates', 'T1-G1 and T2-G1 overloaded 8–10 AM',
      'Reduce congestion by 30%', 'HIGH'"""
)
def gate_suggestions(spark, d):
    return gates.gate_suggestions(views.flights(spark, d))


@query(
    _pairs_sql("unclipped", 80)
    + """SELECT printf('Move flights from Gate %s to Gate %s', worst_gate, best_gate) AS action,
      printf('Gate %s has %.1f min avg delay', worst_gate, round_even(worst_delay, 1)) AS reason,
      'Reduce delays by 20-30%' AS expected_improvement FROM worst JOIN best USING (position) WHERE position = 1"""
)
def gate_recommendation(spark, d):
    return gates.gate_recommendation(views.flights(spark, d))


@query(
    FLIGHTS
    + """, n AS (SELECT gate, count(*) AS n FROM flights GROUP BY gate)
    SELECT max(n) AS max_flights, CAST(CAST(avg(n) AS FLOAT) AS DOUBLE) AS avg_flights,
      (SELECT gate FROM n ORDER BY n DESC, gate LIMIT 1) AS busiest_gate FROM n"""
)
def gate_load(spark, d):
    return stable(gates.gate_load(views.flights(spark, d)), "avg_flights")


CONFLICTS_SQL = FLIGHTS + """,
timed AS (SELECT flight_id, gate, departure_time, CAST(epoch(date_trunc('second', departure_time)) AS BIGINT) AS second FROM flights),
counted AS (SELECT *,
  count(*) OVER (PARTITION BY gate ORDER BY second RANGE BETWEEN 1800 PRECEDING AND 1800 FOLLOWING) - 1 AS others_within,
  count(*) OVER (PARTITION BY gate ORDER BY second RANGE BETWEEN 1 FOLLOWING AND 1800 FOLLOWING) AS ahead,
  count(*) OVER (PARTITION BY gate, second) AS same
  FROM timed)"""


@query(
    CONFLICTS_SQL
    + "SELECT flight_id, gate, departure_time, others_within FROM counted WHERE others_within > 0"
)
def gate_conflicts(spark, d):
    return gates.gate_conflicts(views.flights(spark, d))


@query(
    FLIGHTS
    + """, placed AS (SELECT flight_id, gate, departure_time, CAST(floor(epoch(departure_time)) AS BIGINT) AS second,
      row_number() OVER (ORDER BY floor(epoch(departure_time)), flight_id) AS place FROM flights),
    near AS (SELECT f.*, e.flight_id AS earlier, f.second - e.second AS before, l.flight_id AS later, l.second - f.second AS after
      FROM placed f ASOF LEFT JOIN placed e ON f.gate = e.gate AND f.place > e.place
      ASOF LEFT JOIN placed l ON f.gate = l.gate AND f.place < l.place)
    SELECT flight_id, gate, departure_time, CASE WHEN before <= 1800 THEN earlier END AS earlier_flight,
      CASE WHEN before <= 1800 THEN before END AS earlier_seconds, CASE WHEN after <= 1800 THEN later END AS later_flight,
      CASE WHEN after <= 1800 THEN after END AS later_seconds FROM near WHERE before <= 1800 OR after <= 1800"""
)
def nearest_conflicts(spark, d):
    return gates.nearest_conflicts(views.flights(spark, d))


@query(
    CONFLICTS_SQL
    + """SELECT gate, count(*) AS flights, count(*) FILTER (others_within > 0) AS in_conflict,
      CAST(sum(ahead + (same - 1) / 2) AS BIGINT) AS conflict_pairs FROM counted GROUP BY gate"""
)
def gate_conflict_summary(spark, d):
    return gates.gate_conflict_summary(views.flights(spark, d))


# aggregations ----------------------------------------------------------------------------


@query(
    FLIGHTS
    + """SELECT count(*) AS total_flights, round_even(avg(delay_minutes), 1) AS avg_delay,
      count(*) FILTER (delay_minutes > 30) AS high_risk,
      round_even(count(*) FILTER (delay_minutes <= 15) / CAST(count(*) AS DOUBLE) * 100, 1) AS on_time_pct FROM flights"""
)
def home_kpis(spark, d):
    return kpis.home_kpis(views.flights(spark, d))


DAILY_SQL = """SELECT date, count(flight_id) AS total_flights, CAST(CAST(avg(delay_minutes) AS FLOAT) AS DOUBLE) AS avg_delay,
      max(delay_minutes) AS max_delay, CAST(CAST(sum(delay_minutes) AS FLOAT) AS DOUBLE) AS total_delay FROM flights GROUP BY date"""


@query(FLIGHTS + DAILY_SQL)
def daily_summary(spark, d):
    return stable(kpis.daily_summary(views.flights(spark, d)), "avg_delay", "total_delay")


@query(
    FLIGHTS
    + """SELECT airline, count(flight_id) FILTER (gate_no > 1) AS total_flights, CAST(CAST(avg(delay_minutes) AS FLOAT) AS DOUBLE) AS avg_delay,
      max(delay_minutes) AS max_delay,
      CAST(CAST(count(*) FILTER (delay_minutes <= 15) / CAST(count(*) AS DOUBLE) * 100 AS FLOAT) AS DOUBLE) AS on_time_rate
    FROM flights GROUP BY airline"""
)
def airline_summary(spark, d):
    # ids missing at gate 1: the flight count skips them, the on-time rate does not
    f = views.flights(spark, d).withColumn("flight_id", F.when(F.col("gate_no") > 1, F.col("flight_id")))
    return stable(kpis.airline_summary(f), "avg_delay", "on_time_rate")


@query(
    FLIGHTS
    + """SELECT terminal, count(flight_id) AS total_flights, CAST(CAST(avg(delay_minutes) AS FLOAT) AS DOUBLE) AS avg_delay
    FROM flights GROUP BY terminal"""
)
def terminal_flights(spark, d):
    return stable(kpis.terminal_flights(views.flights(spark, d)), "avg_delay")


@query(FLOW + "SELECT terminal, CAST(sum(passenger_count) AS BIGINT) AS total_passengers FROM flow GROUP BY terminal")
def terminal_passengers(spark, d):
    return kpis.terminal_passengers(views.passenger_flow(spark, d))


@query(FLIGHTS + "SELECT airline, CAST(CAST(avg(delay_minutes) AS FLOAT) AS DOUBLE) AS avg_delay FROM flights GROUP BY airline")
def avg_delay_by_airline(spark, d):
    return stable(kpis.avg_delay_by_airline(views.flights(spark, d)), "avg_delay")


@query(FLIGHTS + "SELECT departure_hour, CAST(CAST(avg(delay_minutes) AS FLOAT) AS DOUBLE) AS avg_delay FROM flights GROUP BY departure_hour")
def avg_delay_by_hour(spark, d):
    return stable(kpis.avg_delay_by_hour(views.flights(spark, d)), "avg_delay")


@query(
    FLIGHTS
    + """SELECT CAST(isodow(departure_time) - 1 AS INTEGER) AS day_no, day_of_week, CAST(CAST(avg(delay_minutes) AS FLOAT) AS DOUBLE) AS avg_delay
    FROM flights GROUP BY 1, 2"""
)
def avg_delay_by_day(spark, d):
    return stable(kpis.avg_delay_by_day(views.flights(spark, d)), "avg_delay")


@query(
    FLIGHTS
    + """SELECT delay_risk AS risk, count(*) AS flights,
      round_even(count(*) / CAST((SELECT count(*) FROM flights) AS DOUBLE) * 100, 2) AS share FROM flights GROUP BY delay_risk"""
)
def risk_distribution(spark, d):
    return kpis.risk_distribution(views.flights(spark, d))


@query(
    FLIGHTS
    + """, span AS (SELECT min(delay_minutes) AS low, max(delay_minutes) AS high FROM flights),
    bins AS (SELECT low, high, least(CAST(floor(30 * (delay_minutes - low) / (high - low)) AS INTEGER) + 1, 30) AS bin
      FROM flights, span)
    SELECT bin, round_even(low + (high - low) / 30 * (bin - 1), 6) AS bin_start,
      round_even(low + (high - low) / 30 * bin, 6) AS bin_end, count(*) AS flights FROM bins GROUP BY bin, low, high"""
)
def delay_histogram(spark, d):
    return kpis.delay_histogram(views.flights(spark, d))


QUARTILE_COLUMNS = ", ".join(
    f"CAST(CAST(quantile_cont(delay_minutes, CAST({p} AS DOUBLE)) AS FLOAT) AS DOUBLE) AS {name}" for name, p in kpis.QUARTILES.items()
)


@query(FLIGHTS + f"SELECT weather, {QUARTILE_COLUMNS} FROM flights GROUP BY weather")
def delay_quartiles_by_weather(spark, d):
    return stable(kpis.delay_quartiles(views.flights(spark, d), "weather"), *kpis.QUARTILES)


@query(FLIGHTS + f"SELECT airline, {QUARTILE_COLUMNS} FROM flights GROUP BY airline")
def delay_quartiles_by_airline(spark, d):
    return stable(kpis.delay_quartiles(views.flights(spark, d), "airline"), *kpis.QUARTILES)


HEATMAP_SQL = "SELECT hour, gate, CAST(sum(passenger_count) AS BIGINT) AS passengers FROM flow {where} GROUP BY hour, gate"


@query(FLOW + HEATMAP_SQL.format(where=""))
def passenger_heatmap(spark, d):
    return kpis.passenger_heatmap(views.passenger_flow(spark, d))


@query(FLOW + HEATMAP_SQL.format(where="WHERE terminal = 'T1'"))
def passenger_heatmap_terminal(spark, d):
    return kpis.passenger_heatmap(prepare.filter_terminal(views.passenger_flow(spark, d), "T1"))


TOTALS_SQL = "SELECT hour, CAST(sum(passenger_count) AS BIGINT) AS passengers FROM flow GROUP BY hour"


@query(FLOW + TOTALS_SQL)
def hourly_passenger_totals(spark, d):
    return kpis.hourly_passenger_totals(views.passenger_flow(spark, d))


@query(FLOW + TOTALS_SQL + " ORDER BY passengers DESC, hour LIMIT 3")
def peak_hours(spark, d):
    return kpis.peak_hours(views.passenger_flow(spark, d))


@query(
    FLOW
    + """SELECT max(passenger_count) AS max_passengers, CAST(CAST(avg(passenger_count) AS FLOAT) AS DOUBLE) AS avg_passengers
    FROM flow WHERE hour = 8"""
)
def congestion_stats(spark, d):
    return stable(kpis.congestion_stats(views.passenger_flow(spark, d), 8), "avg_passengers")


@query(
    FLIGHTS
    + """SELECT CASE WHEN delay_minutes <= 15 THEN 'LOW' WHEN delay_minutes <= 40 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_label,
      count(*) AS rows FROM flights GROUP BY 1"""
)
def class_distribution(spark, d):
    labelled = views.flights(spark, d).select(risk.training_risk("delay_minutes").alias("risk_label"))
    return kpis.class_distribution(labelled, "risk_label")


@query(FLIGHTS + "SELECT DISTINCT airline FROM flights")
def distinct_airlines(spark, d):
    return dimensions.distinct_values(views.flights(spark, d), "airline")


@query(FLIGHTS + "SELECT DISTINCT terminal FROM flights")
def distinct_terminals(spark, d):
    return dimensions.distinct_values(views.flights(spark, d), "terminal")


@query(
    FLIGHTS
    + "SELECT flight_id, departure_hour, delay_minutes, weather FROM flights ORDER BY md5(flight_id), flight_id LIMIT 500"
)
def sample_points(spark, d):
    return kpis.sample_points(views.flights(spark, d))


# dimensions ------------------------------------------------------------------------------


def _dim_sql(column):
    return (
        FLIGHTS
        + f"""SELECT {column}, CAST(row_number() OVER (ORDER BY first, {column}) AS INTEGER) AS {column}_id
        FROM (SELECT {column}, min(seq) AS first FROM flights GROUP BY {column})"""
    )


@query(_dim_sql("airline"))
def dim_airlines(spark, d):
    return dimensions.dim_airlines(views.flights(spark, d))


@query(_dim_sql("terminal"))
def dim_terminals(spark, d):
    return dimensions.dim_terminals(views.flights(spark, d))


@query(_dim_sql("weather"))
def dim_weather(spark, d):
    return dimensions.dim_weather(views.flights(spark, d))


@query(
    FLIGHTS
    + """, firsts AS (SELECT date, min(seq) FILTER (date < DATE '2024-01-15') AS early, min(seq) AS first FROM flights GROUP BY date)
    SELECT date, CAST(row_number() OVER (ORDER BY early IS NULL, coalesce(early, first), date) AS INTEGER) AS date_id FROM firsts"""
)
def dim_loaded_twice(spark, d):
    """Keys of dates: loaded up to 14 January, then with all flights, then once more."""
    flights, path = views.flights(spark, d), scratch_path(spark, "dim")
    early = flights.filter("date < DATE '2024-01-15'")
    for rows in (early, flights, flights):
        dimensions.load_dim(rows, path, "date", "date_id", "seq")
    return dimensions.stored_dim(spark, path, "date", flights.schema["date"].dataType, "date_id").drop("load")


@query(
    FLIGHTS
    + """, span AS (SELECT min(departure_time) AS first, max(departure_time) AS last FROM flights),
    steps AS (SELECT unnest(generate_series(first, last, INTERVAL 1 DAY)) AS moment FROM span)
    SELECT CAST(moment AS DATE) AS date, dayname(moment) AS day_name, CAST(month(moment) AS INTEGER) AS month, monthname(moment) AS month_name,
      CAST(year(moment) AS INTEGER) AS year, CAST(quarter(moment) AS INTEGER) AS quarter,
      CASE WHEN isodow(moment) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM steps"""
)
def dim_dates(spark, d):
    return dimensions.dim_dates(views.flights(spark, d))


@query(
    FLIGHTS
    + """SELECT gate AS value, CAST(row_number() OVER (ORDER BY gate) - 1 AS INTEGER) AS code
    FROM (SELECT DISTINCT gate FROM flights)"""
)
def label_dim(spark, d):
    return dimensions.label_dim(views.flights(spark, d), "gate")


@query(
    BOTH
    + """, span AS (SELECT min(departure_time) AS first, max(departure_time) AS last FROM flights)
    SELECT 'fact_flights' AS table_name, count(*) AS rows FROM flights
    UNION ALL SELECT 'fact_passengers', count(*) FROM flow
    UNION ALL SELECT 'dim_airlines', count(DISTINCT airline) FROM flights
    UNION ALL SELECT 'dim_terminals', count(DISTINCT terminal) FROM flights
    UNION ALL SELECT 'dim_weather', count(DISTINCT weather) FROM flights
    UNION ALL SELECT 'dim_dates', len(generate_series(first, last, INTERVAL 1 DAY)) FROM span
    UNION ALL SELECT 'summary_daily', count(DISTINCT date) FROM flights
    UNION ALL SELECT 'summary_airline', count(DISTINCT airline) FROM flights
    UNION ALL SELECT 'summary_terminal', count(*) FROM (SELECT terminal FROM flights INTERSECT SELECT terminal FROM flow)"""
)
def star_schema_tables(spark, d):
    f, p = views.flights(spark, d), views.passenger_flow(spark, d)
    return star_schema.count_tables(star_schema.star_tables(f, p))


# expansion -------------------------------------------------------------------------------


PEOPLE_SQL = """, totals AS (SELECT timestamp, terminal, gate, CAST(sum(passenger_count) AS BIGINT) AS n FROM flow
      WHERE passenger_count > 0 GROUP BY timestamp, terminal, gate),
    numbered AS (SELECT *, coalesce(sum(n) OVER (ORDER BY timestamp, terminal, gate
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM totals),
    people AS (SELECT printf('%05d', CAST(before AS BIGINT) + unnest(range(1, n + 1))) AS number, terminal, gate, timestamp FROM numbered)"""


@query(
    FLOW
    + PEOPLE_SQL
    + """SELECT terminal, gate, count(*) AS passengers, min('P' || number) AS first_passenger,
      max('P' || number) AS last_passenger,
      CAST(sum(CAST(number AS BIGINT) % 1000003 * (date_diff('hour', TIMESTAMP '1990-01-01', timestamp) % 1009)) AS BIGINT) AS digest
    FROM people GROUP BY terminal, gate"""
)
def expand_passengers(spark, d):
    """All passengers are generated; the result is a digest of them per gate."""
    people = expand.expand_passengers(views.passenger_flow(spark, d))
    number = F.substring("passenger_id", 2, 18).cast("long")
    hours = F.timestamp_diff("HOUR", F.lit(dt.datetime(1990, 1, 1)), F.col("timestamp"))
    return people.groupBy("terminal", "gate").agg(
        F.count(F.lit(1)).alias("passengers"),
        expand.first_id("passenger_id", "P").alias("first_passenger"),
        expand.last_id("passenger_id", "P").alias("last_passenger"),
        F.sum(number % 1000003 * (hours % 1009)).alias("digest"),
    )


@query(
    FLOW
    + PEOPLE_SQL
    + """, bags AS (SELECT 'B' || number AS baggage_id, 'P' || number AS passenger_id FROM people),
    drawn AS (SELECT *, CAST('0x' || substr(md5(baggage_id), 1, 8) AS BIGINT) % 100 AS draw FROM bags)
    SELECT CASE WHEN draw < 85 THEN 'delivered' WHEN draw < 95 THEN 'delayed' ELSE 'lost' END AS status,
      count(*) AS bags, min(baggage_id) AS first_bag, max(passenger_id) AS last_passenger FROM drawn GROUP BY 1"""
)
def expand_baggage(spark, d):
    bags = expand.expand_baggage(expand.expand_passengers(views.passenger_flow(spark, d)))
    return bags.groupBy("status").agg(
        F.count(F.lit(1)).alias("bags"),
        expand.first_id("baggage_id", "B").alias("first_bag"),
        expand.last_id("passenger_id", "P").alias("last_passenger"),
    )


# stored sketches ---------------------------------------------------------------------------


@query(
    FLIGHTS
    + """SELECT airline, quantile, count(delay_minutes) AS rows, TRUE AS within_half_percent
    FROM flights, (VALUES ('min'), ('q1'), ('median'), ('q3'), ('max')) AS names(quantile) GROUP BY airline, quantile"""
)
def delay_quartiles_stored(spark, d):
    """Quartiles from sketches stored per day, held against the exact ranks in the facts."""
    flights, path = views.flights(spark, d), scratch_path(spark, "sketches")
    daily = quantiles.daily_sketches(flights, "delay_minutes", ["airline"])
    writers.load_facts(daily, path)
    found = quantiles.merged_quantiles(spark.read.schema(daily.schema).parquet(path), kpis.QUARTILES, ["airline"])
    errors = quantiles.rank_errors(flights, "delay_minutes", found, kpis.QUARTILES, ["airline"])
    return errors.join(found.select("airline", "rows"), "airline").select(
        "airline", "quantile", "rows", (F.col("rank_error") <= 0.005).alias("within_half_percent")
    )
