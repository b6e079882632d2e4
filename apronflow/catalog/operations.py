"""Queries: risk scores, forecasts, alerts, capacity cases and prediction history."""

from __future__ import annotations

from pyspark.sql import functions as F

from apronflow.catalog import views
from apronflow.catalog.metrics import stable
from apronflow.catalog.registry import AS_OF, query
from apronflow.catalog.views import CASES_SQL, FLIGHTS_SQL, FLOW_SQL, PREDICTIONS_SQL, with_views
from apronflow.operators import series as series_ops
from apronflow.operators import joins
from apronflow.plans import alerts, arima, capacity, forecast, history, risk_scores

FLIGHTS = with_views(FLIGHTS_SQL)
FLOW = with_views(FLOW_SQL)
BOTH = with_views(FLIGHTS_SQL, FLOW_SQL)
NOW = f"TIMESTAMP '{AS_OF}'"

# risk scores -----------------------------------------------------------------------------

FACTORS = """CASE WHEN departure_hour BETWEEN 7 AND 9 OR departure_hour BETWEEN 17 AND 19 THEN 70 ELSE 30 END
    * CAST(0.25 AS DOUBLE) + CASE weather WHEN 'Clear' THEN 20 WHEN 'Cloudy' THEN 40 WHEN 'Rain' THEN 65
      WHEN 'Storm' THEN 85 ELSE 40 END * CAST(0.25 AS DOUBLE)"""
LEVEL = "CASE WHEN score < 40 THEN 'LOW' WHEN score < 70 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level"


@query(
    FLIGHTS
    + f""", scored AS (SELECT flight_id, least(CAST(100 AS DOUBLE), 30 * CAST(0.4 AS DOUBLE) + {FACTORS}
      + CASE WHEN is_weekend = 1 THEN 40 ELSE 20 END * CAST(0.1 AS DOUBLE)) AS score FROM flights)
    SELECT flight_id, CAST(CAST(score AS FLOAT) AS DOUBLE) AS risk_score, {LEVEL} FROM scored"""
)
def statistical_risk(spark, d):
    f = views.flights(spark, d).select(
        "flight_id", "weather", F.col("departure_hour").alias("hour"), F.weekday("departure_time").alias("day_of_week")
    )
    return stable(risk_scores.statistical_risk(f).select("flight_id", "risk_score", "risk_level"), "risk_score")


@query(
    FLIGHTS
    + f""", means AS (SELECT terminal, avg(delay_minutes) AS mean FROM flights GROUP BY terminal),
    scored AS (SELECT flight_id, least(CAST(100 AS DOUBLE),
      CASE WHEN mean IS NULL THEN 30 ELSE least(CAST(100 AS DOUBLE), mean * 2) END * CAST(0.4 AS DOUBLE) + {FACTORS}
      + CASE WHEN isodow({NOW}) >= 6 THEN 40 ELSE 20 END * CAST(0.1 AS DOUBLE)) AS score
      FROM flights LEFT JOIN means USING (terminal))
    SELECT flight_id, CAST(CAST(score AS FLOAT) AS DOUBLE) AS risk_score, {LEVEL} FROM scored"""
)
def operational_risk(spark, d):
    f = views.flights(spark, d)
    scored = risk_scores.operational_risk(f.withColumn("hour", F.col("departure_hour")), f, AS_OF.date())
    return stable(scored.select("flight_id", "risk_score", "risk_level"), "risk_score")


@query(
    with_views(FLIGHTS_SQL, PREDICTIONS_SQL)
    + """SELECT id, CAST(CAST(predicted_delay AS FLOAT) AS DOUBLE) AS predicted_delay, CAST(CAST(delay_probability AS FLOAT) AS DOUBLE) AS delay_probability,
      risk_level, recommendation FROM predictions"""
)
def statistical_delay(spark, d):
    scored = views.predictions(spark, d).select(
        "id", "predicted_delay", "delay_probability", "risk_level", "recommendation"
    )
    return stable(scored, "predicted_delay", "delay_probability")


# forecasts -------------------------------------------------------------------------------


def series_sql(by: str = "") -> str:
    """Hourly means with linear gap filling, as CTE text ending in ``series``."""
    key = f"{by}, " if by else ""
    partition = f"PARTITION BY {by} " if by else ""
    groups = f"(SELECT DISTINCT {by} FROM means)" if by else "(SELECT 1 AS one)"
    using = f"{by}, hour" if by else "hour"
    return f""",
means AS (SELECT {key}departure_hour AS hour, avg(delay_minutes) AS value FROM flights GROUP BY {key}departure_hour),
grid AS (SELECT {key}CAST(h AS INTEGER) AS hour FROM {groups}, range(24) AS r(h)),
gappy AS (SELECT {key}hour, value FROM grid LEFT JOIN means USING ({using})),
sided AS (SELECT *,
  last_value(value IGNORE NULLS) OVER past AS v0,
  last_value(CASE WHEN value IS NOT NULL THEN hour END IGNORE NULLS) OVER past AS h0,
  first_value(value IGNORE NULLS) OVER future AS v1,
  first_value(CASE WHEN value IS NOT NULL THEN hour END IGNORE NULLS) OVER future AS h1
  FROM gappy
  WINDOW past AS ({partition}ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    future AS ({partition}ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
series AS (SELECT {key}hour, coalesce(value,
  CASE WHEN h1 > h0 THEN v0 + (v1 - v0) * ((hour - h0) / CAST(h1 - h0 AS DOUBLE)) END, v0, v1, CAST(20 AS DOUBLE)) AS value
  FROM sided)"""


@query(FLIGHTS + series_sql("airline") + "SELECT airline, hour, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM series")
def interpolate_hours(spark, d):
    means = (
        views.flights(spark, d)
        .groupBy("airline", F.col("departure_hour").alias("hour"))
        .agg(F.avg("delay_minutes").alias("value"))
    )
    gappy = joins.reindex_hours(means, "hour", "value", ["airline"])
    return stable(series_ops.interpolate_hours(gappy, ["airline"]), "value")


@query(FLIGHTS + series_sql() + "SELECT hour, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM series")
def hourly_series(spark, d):
    return stable(forecast.hourly_series(views.flights(spark, d)), "value")


@query(FLIGHTS + series_sql("gate") + "SELECT gate, hour, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM series")
def hourly_series_by_gate(spark, d):
    return stable(forecast.hourly_series(views.flights(spark, d), ["gate"]), "value")


@query(
    FLIGHTS
    + series_sql()
    + f"""SELECT hour, round_even(value, 1) AS value,
      strftime({NOW} - to_hours(24 - hour), '%H:%M') AS time FROM series"""
)
def forecast_history(spark, d):
    return forecast.history_labels(forecast.hourly_series(views.flights(spark, d)), AS_OF)


START_SQL = """, start AS (SELECT {key}avg(value) FILTER (hour >= 18) AS mean,
    (max(value) FILTER (hour = 23) - max(value) FILTER (hour = 18)) / 6 AS trend FROM series {group})"""


@query(
    FLIGHTS
    + series_sql("terminal")
    + START_SQL.format(key="terminal, ", group="GROUP BY terminal")
    + "SELECT terminal, CAST(CAST(mean AS FLOAT) AS DOUBLE) AS mean, CAST(CAST(trend AS FLOAT) AS DOUBLE) AS trend FROM start"
)
def last_mean_and_trend(spark, d):
    s = forecast.hourly_series(views.flights(spark, d), ["terminal"])
    return stable(series_ops.last_mean_and_trend(s, ["terminal"]), "mean", "trend")


def trend_sql(by: str, steps: int, factor: float) -> str:
    key = f"{by}, " if by else ""
    return START_SQL.format(key=key, group=f"GROUP BY {by}" if by else "") + f""",
ahead AS (SELECT {key}CAST(s AS INTEGER) AS step,
  greatest(CAST(0 AS DOUBLE), mean + trend * s * CAST({factor} AS DOUBLE)) AS value FROM start, range(1, {steps + 1}) AS r(s))"""


TREND_COLUMNS = """step, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value, CAST(CAST(value * CAST(0.75 AS DOUBLE) AS FLOAT) AS DOUBLE) AS lower_bound,
      CAST(CAST(value * CAST(1.25 AS DOUBLE) AS FLOAT) AS DOUBLE) AS upper_bound"""
BOUNDS = ["value", "lower_bound", "upper_bound"]


@query(FLIGHTS + series_sql() + trend_sql("", 12, 1.75) + f"SELECT {TREND_COLUMNS} FROM ahead")
def trend_forecast(spark, d):
    s = forecast.hourly_series(views.flights(spark, d))
    return stable(forecast.trend_forecast(s, 12, "Storm"), *BOUNDS)


@query(FLIGHTS + series_sql("gate") + trend_sql("gate", 24, 1.4) + f"SELECT gate, {TREND_COLUMNS} FROM ahead")
def trend_forecast_by_gate(spark, d):
    s = forecast.hourly_series(views.flights(spark, d), ["gate"])
    return stable(forecast.trend_forecast(s, 48, "Rain", ["gate"]), *BOUNDS)


@query(
    FLIGHTS
    + series_sql()
    + trend_sql("", 12, 1.0)
    + f"""SELECT step, strftime({NOW} + to_hours(step), '%H:%M') AS time, round_even(value, 1) AS value,
      round_even(value * CAST(0.75 AS DOUBLE), 1) AS lower_bound, round_even(value * CAST(1.25 AS DOUBLE), 1) AS upper_bound
    FROM ahead"""
)
def forecast_points(spark, d):
    s = forecast.hourly_series(views.flights(spark, d))
    return forecast.label_forecast(forecast.trend_forecast(s), AS_OF)


AR_SQL = """,
level AS (SELECT gate, hour, value, value - lag(value) OVER (PARTITION BY gate ORDER BY hour) AS d FROM series),
lagged AS (SELECT gate, hour, d AS y, lag(d, 1) OVER w AS a, lag(d, 2) OVER w AS b FROM level WINDOW w AS (PARTITION BY gate ORDER BY hour)),
sums AS (SELECT gate, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS sy
  FROM lagged WHERE b IS NOT NULL GROUP BY gate),
fit AS (SELECT gate, (ay * bb - sy * ab) / (aa * bb - ab * ab) AS p1, (sy * aa - ay * ab) / (aa * bb - ab * ab) AS p2 FROM sums),
noise AS (SELECT gate, sqrt(sum((y - p1 * a - p2 * b) ** 2) / (count(*) - 2)) AS sigma
  FROM lagged JOIN fit USING (gate) WHERE b IS NOT NULL GROUP BY gate),
ends AS (SELECT gate, max(value) FILTER (hour = 23) AS lv, max(d) FILTER (hour = 23) AS d1, max(d) FILTER (hour = 22) AS d2
  FROM level GROUP BY gate),
walk AS (
  SELECT gate, 0 AS step, lv, d1, d2, CAST(1 AS DOUBLE) AS psi1, CAST(0 AS DOUBLE) AS psi2, CAST(1 AS DOUBLE) AS weight,
    CAST(0 AS DOUBLE) AS variance, p1, p2 FROM ends JOIN fit USING (gate)
  UNION ALL
  SELECT gate, step + 1, lv + p1 * d1 + p2 * d2, p1 * d1 + p2 * d2, d1, p1 * psi1 + p2 * psi2, psi1,
    weight + p1 * psi1 + p2 * psi2, variance + weight * weight, p1, p2 FROM walk WHERE step < 12
)
SELECT gate, step, CAST(CAST(greatest(0, lv * m) AS FLOAT) AS DOUBLE) AS value,
  CAST(CAST(greatest(0, (lv - sigma * sqrt(variance) * z) * m) AS FLOAT) AS DOUBLE) AS lower_bound,
  CAST(CAST(greatest(0, (lv + sigma * sqrt(variance) * z) * m) AS FLOAT) AS DOUBLE) AS upper_bound
FROM walk JOIN noise USING (gate), (SELECT CAST(1.15 AS DOUBLE) AS m, CAST(1.2815515655446004 AS DOUBLE) AS z)
WHERE step > 0"""


@query(
    # lag/recursion needs RECURSIVE on the whole list of common table expressions
    (FLIGHTS + series_sql("gate") + AR_SQL).replace("WITH ", "WITH RECURSIVE ", 1)
)
def ar_forecast(spark, d):
    s = forecast.hourly_series(views.flights(spark, d), ["gate"])
    points = forecast.ar_forecast(s, 12, "Cloudy", ["gate"])
    return stable(points, "value", "lower_bound", "upper_bound")


@query()
def arima_fit(spark, d):
    """Coefficients, innovations variance and likelihood of every gate's and airline's series."""
    f = views.flights(spark, d)
    fits = [
        arima.arima_fit(forecast.hourly_series(f, [key]), [key]).select(
            F.lit(key).alias("kind"), F.col(key).alias("name"), F.to_json("phi").alias("phi"), F.to_json("theta").alias("theta"),
            "sigma2", "css", "log_likelihood", "method",
        )
        for key in ("gate", "airline")
    ]
    return fits[0].unionByName(fits[1])


@query()
def arima_forecast(spark, d):
    s = forecast.hourly_series(views.flights(spark, d), ["terminal", "airline"])
    return arima.arima_forecast(s, 12, "Cloudy", ["terminal", "airline"])


WARNINGS_SQL = f""", warned AS (SELECT gate, step, strftime({NOW} + to_hours(step), '%H:%M') AS time,
      round_even(value, 1) AS delay, CASE WHEN value > 60 THEN 'CRITICAL' ELSE 'HIGH' END AS level FROM ahead WHERE value > 45)"""


@query(
    FLIGHTS
    + series_sql("gate")
    + trend_sql("gate", 12, 1.0)
    + WARNINGS_SQL
    + "SELECT *, printf('Expected %.1f min avg delay at %s', delay, time) AS message FROM warned"
)
def peak_warnings(spark, d):
    s = forecast.hourly_series(views.flights(spark, d), ["gate"])
    return forecast.peak_warnings(forecast.trend_forecast(s, 12, "Clear", ["gate"]), AS_OF)


@query(
    FLIGHTS
    + series_sql("gate")
    + trend_sql("gate", 12, 1.0)
    + WARNINGS_SQL
    + "SELECT gate, step, time, delay, level FROM warned QUALIFY row_number() OVER (PARTITION BY gate ORDER BY step) <= 4"
)
def first_warnings(spark, d):
    s = forecast.hourly_series(views.flights(spark, d), ["gate"])
    warnings = forecast.peak_warnings(forecast.trend_forecast(s, 12, "Clear", ["gate"]), AS_OF)
    return forecast.first_warnings(warnings, 4, ["gate"]).select("gate", "step", "time", "delay", "level")


WEEK_SQL = """, day_means AS (SELECT {key}day_of_week, avg(delay_minutes) AS value FROM flights GROUP BY {key}day_of_week),
days AS (SELECT * FROM (VALUES (0,'Mon'),(1,'Tue'),(2,'Wed'),(3,'Thu'),(4,'Fri'),(5,'Sat'),(6,'Sun')) AS t(day_no, day_of_week)),
week AS (SELECT {key}day_no, day_of_week, greatest(CAST(0 AS DOUBLE), coalesce(value, 25)) AS value
  FROM {grid} LEFT JOIN day_means USING ({using}))"""


@query(
    FLIGHTS
    + WEEK_SQL.format(key="", grid="days", using="day_of_week")
    + """SELECT day_no, day_of_week, round_even(value, 1) AS value FROM week"""
)
def weekly_series(spark, d):
    week = forecast.weekly_series(views.flights(spark, d))
    return week.withColumn("value", F.bround("value", 1))


@query(
    FLIGHTS
    + WEEK_SQL.format(
        key="airline, ",
        grid="(SELECT * FROM (SELECT DISTINCT airline FROM day_means), days) AS g", using="airline, day_of_week",
    )
    + """SELECT airline, round_even(avg(value), 1) AS avg,
      string_agg(day_of_week || '=' || printf('%.1f', round_even(value, 1)), ' ' ORDER BY day_no) AS days,
      arg_min(day_of_week, (-value, day_no)) AS peak_day FROM week GROUP BY airline"""
)
def weekly_outlook(spark, d):
    outlook = forecast.weekly_outlook(views.flights(spark, d), ["airline"])
    listed = F.array_join(
        F.transform("days", lambda p: F.concat(p["day"], F.lit("="), F.format_string("%.1f", p["value"]))), " "
    )
    return outlook.withColumn("days", listed)


@query(
    FLIGHTS
    + series_sql()
    + trend_sql("", 24, 1.75)
    + f"""SELECT CAST({NOW} AS TIMESTAMP) AS created_at, 'Storm' AS weather, 24 AS hours_ahead,
      round_even(avg(round_even(value, 1)), 1) AS forecast_avg, round_even(max(round_even(value, 1)), 1) AS forecast_max,
      count(*) FILTER (value > 45) AS peak_warnings_count FROM ahead"""
)
def forecast_summary(spark, d):
    return forecast.forecast_run(views.flights(spark, d), AS_OF, 30, "Storm")


# alerts ----------------------------------------------------------------------------------

ALERT_TAIL = f"""CAST({NOW} AS TIMESTAMP) AS timestamp"""

DELAY_ALERT_SQL = f"""SELECT 'DELAY_0815' AS id, 'DELAY' AS type, 'HIGH' AS priority, 'Multiple High Delays Detected' AS title,
      count(*) || ' flights delayed >30min' AS message,
      'Airlines affected: ' || (SELECT string_agg(airline, ', ' ORDER BY first) FROM (SELECT airline, min(seq) AS first
        FROM flights WHERE delay_minutes > 30 GROUP BY airline ORDER BY first LIMIT 3)) AS details, {ALERT_TAIL},
      'Notify affected airlines|Update passenger information|Consider schedule adjustments' AS actions
    FROM flights WHERE delay_minutes > 30 HAVING count(*) >= 3"""
CONGESTION_ALERT_SQL = f"""SELECT 'CONGEST_0815' AS id, 'CONGESTION' AS type, 'MEDIUM' AS priority, 'High Passenger Congestion' AS title,
      printf('Average congestion: %d passengers/hour', CAST(round_even(avg(passenger_count), 0) AS BIGINT)) AS message,
      'Peak at ' || max(passenger_count) || ' passengers' AS details, {ALERT_TAIL},
      'Deploy additional staff|Open extra security lanes|Monitor queue lengths' AS actions
    FROM flow WHERE hour = 8 HAVING avg(passenger_count) > 25"""
WEATHER_ALERT_SQL = f"""SELECT DISTINCT 'WEATHER_0815' AS id, 'WEATHER' AS type, 'HIGH' AS priority, 'Adverse Weather Alert: ' || weather AS title,
      'Weather conditions may impact operations' AS message, 'Increased risk of delays and cancellations' AS details, {ALERT_TAIL},
      'Activate weather contingency plan|Coordinate with ground services|Update flight schedules' AS actions
    FROM flights WHERE weather IN ('Storm', 'Heavy Rain')"""
GATE_ALERT_SQL = f"""SELECT 'GATE_0815' AS id, 'RESOURCE' AS type, 'MEDIUM' AS priority, 'Gate ' || busiest || ' Overutilized' AS title,
      printf('%d flights vs average %.1f', top, round_even(mean, 1)) AS message, 'Consider redistributing flights' AS details, {ALERT_TAIL},
      'Move some flights from ' || busiest || '|Review gate assignment algorithm|Check for scheduling conflicts' AS actions
    FROM (SELECT max(n) AS top, avg(n) AS mean, arg_min(gate, (-n, gate)) AS busiest
      FROM (SELECT gate, count(*) AS n FROM flights GROUP BY gate)) WHERE top > mean * CAST(1.02 AS DOUBLE)"""

ALL_ALERTS_SQL = " UNION ALL ".join(
    f"SELECT *, {i} AS seq FROM ({sql}) AS c{i}"
    for i, sql in enumerate([DELAY_ALERT_SQL, CONGESTION_ALERT_SQL, WEATHER_ALERT_SQL, GATE_ALERT_SQL])
)


def flat(alert_rows):
    return alert_rows.withColumn("actions", F.array_join("actions", "|"))


def every_alert(spark, d):
    f = views.flights(spark, d)
    return alerts.all_alerts(f, views.passenger_flow(spark, d), f, AS_OF, 25, 1.02)


@query(FLIGHTS + DELAY_ALERT_SQL)
def delay_alert(spark, d):
    return flat(alerts.delay_alert(views.flights(spark, d), AS_OF))


@query(FLOW + CONGESTION_ALERT_SQL)
def congestion_alert(spark, d):
    return flat(alerts.congestion_alert(views.passenger_flow(spark, d), AS_OF, threshold=25))


@query(FLIGHTS + WEATHER_ALERT_SQL)
def weather_alert(spark, d):
    return flat(alerts.weather_alert(views.flights(spark, d), AS_OF))


@query(FLIGHTS + GATE_ALERT_SQL)
def gate_overuse_alert(spark, d):
    return flat(alerts.gate_overuse_alert(views.flights(spark, d), AS_OF, factor=1.02))


@query(BOTH + ALL_ALERTS_SQL)
def all_alerts(spark, d):
    return flat(every_alert(spark, d))


RANKED_SQL = f"""SELECT *, CASE priority WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3
      ELSE 4 END AS rank FROM ({ALL_ALERTS_SQL}) AS a"""


@query(BOTH + f"SELECT rank, seq, id, priority FROM ({RANKED_SQL}) AS r ORDER BY rank, seq, title")
def alert_order(spark, d):
    ordered = alerts.alert_order(every_alert(spark, d))
    return ordered.select(alerts.priority_rank("priority").alias("rank"), "seq", "id", "priority")


@query(BOTH + f"SELECT id, title, message FROM ({RANKED_SQL}) AS r ORDER BY rank, seq, title LIMIT 1")
def top_alert(spark, d):
    return alerts.top_alert(every_alert(spark, d)).select("id", "title", "message")


@query(
    FLIGHTS
    + """SELECT string_agg(airline, ', ' ORDER BY first) AS airlines FROM (SELECT airline, min(seq) AS first
      FROM flights WHERE delay_minutes > 100 GROUP BY airline ORDER BY first LIMIT 3)"""
)
def first_three_airlines(spark, d):
    return alerts.first_three_airlines(views.flights(spark, d), threshold=100)


@query(
    FLIGHTS
    + f"SELECT flight_id AS id, departure_time AS timestamp FROM flights WHERE departure_time > {NOW} - INTERVAL 48 HOUR"
)
def recent_alerts(spark, d):
    log = views.flights(spark, d).select(F.col("flight_id").alias("id"), F.col("departure_time").alias("timestamp"))
    return alerts.recent_alerts(log, AS_OF, 48)


# capacity cases --------------------------------------------------------------------------

CASES = with_views(FLIGHTS_SQL, CASES_SQL)


def load_sql(per_gate: int) -> str:
    return FLIGHTS + f""", counts AS (SELECT terminal, date, departure_hour, count(*) AS flights,
      {per_gate} * CASE terminal WHEN 'T1' THEN 8 WHEN 'T2' THEN 6 ELSE 5 END AS capacity FROM flights GROUP BY terminal, date, departure_hour)
    SELECT *, round_even(flights / CAST(capacity AS DOUBLE), 4) AS load,
      CASE WHEN flights / CAST(capacity AS DOUBLE) > 1 THEN 'OVERLOADED'
        WHEN flights / CAST(capacity AS DOUBLE) > CAST(0.8 AS DOUBLE) THEN 'HIGH' ELSE 'NORMAL' END AS status FROM counts"""


@query(load_sql(1))
def terminal_hour_load(spark, d):
    return capacity.terminal_hour_load(views.flights(spark, d), per_gate=1)


@query(load_sql(3))
def terminal_hour_load_published(spark, d):
    """Load at the published three flights per gate and hour."""
    return capacity.terminal_hour_load(views.flights(spark, d))


def _impact(spark, d):
    return capacity.case_impact(views.cases(spark, d), views.case_flights(spark, d))


@query(
    CASES
    + """SELECT case_id, terminal, weather, flight_count, printf('%d:00 – %d:00', start_hour, end_hour) AS window,
      gate_count, CAST(capacity AS INTEGER) AS capacity, risk_level, round_even(total_delay, 1) AS avg_delay_min,
      CAST(round_even(total_delay * flight_count, 0) AS BIGINT) AS total_delay_minutes,
      round_even(cascade_delay, 1) AS cascade_delay_min,
      round_even(least(overload * 85, CAST(99 AS DOUBLE)), 1) AS gate_overload_pct,
      round_even(least(overload * 100, CAST(100 AS DOUBLE)), 1) AS terminal_capacity_pct,
      cancellations, diversions, affected_passengers FROM impact"""
)
def case_impact(spark, d):
    return capacity.case_report(_impact(spark, d))


@query(CASES + "SELECT risk_level, count(*) AS cases FROM impact GROUP BY risk_level")
def case_risk_levels(spark, d):
    return _impact(spark, d).groupBy("risk_level").agg(F.count(F.lit(1)).alias("cases"))


@query(
    CASES
    + """, hours AS (SELECT *, unnest(range(start_hour, end_hour)) AS h,
      flight_count / CAST(window_hours AS DOUBLE) AS hourly FROM impact),
    loads AS (SELECT *, hourly / (gate_count * 3) AS hour_load FROM hours)
    SELECT case_id, CAST(h AS INTEGER) AS hour, round_even(hourly, 1) AS flights,
      round_even(adjusted_delay * (1 + greatest(CAST(0 AS DOUBLE), hour_load - CAST(0.7 AS DOUBLE)) * CAST(0.5 AS DOUBLE)), 1) AS avg_delay,
      round_even(least(hour_load * 100, CAST(100 AS DOUBLE)), 1) AS gate_load_pct,
      CASE WHEN hour_load > 1 THEN 'OVERLOADED' WHEN hour_load > CAST(0.8 AS DOUBLE) THEN 'HIGH' ELSE 'NORMAL' END AS status FROM loads"""
)
def case_hourly(spark, d):
    return capacity.case_hourly(_impact(spark, d))


@query(
    CASES
    + """, advice AS (
    SELECT case_id, 1 AS rule, 'CRITICAL' AS priority,
      'Redistribute ' || CAST(round_even((overload - 1) * flight_count, 0) AS BIGINT) || ' flights to T2/T3' AS action,
      'Reduces gate overload to acceptable levels' AS impact FROM impact WHERE overload > 1
    UNION ALL SELECT case_id, 2, 'HIGH', 'Activate weather contingency protocol for ' || terminal,
      'Mitigate ' || weather || ' impact — pre-position de-icing/ground crew' FROM impact WHERE weather IN ('Rain', 'Storm')
    UNION ALL SELECT case_id, 3, 'HIGH', 'Issue proactive passenger delay notifications',
      'Avg delay ' || CAST(round_even(total_delay, 0) AS BIGINT) || ' min expected — notify 2h in advance' FROM impact WHERE total_delay > 40
    UNION ALL SELECT case_id, 4, 'MEDIUM', 'Open ' || greatest(1, CAST(round_even((overload - CAST(0.8 AS DOUBLE)) * gate_count, 0) AS BIGINT))
      || ' additional gate(s) in ' || terminal, 'Increase throughput capacity by 15–25%' FROM impact WHERE overload > CAST(0.8 AS DOUBLE)
    UNION ALL SELECT case_id, 5, 'MEDIUM', 'Pre-arrange rebooking for ~' || cancellations || ' expected cancellations',
      'Reduce passenger disruption and complaint volume' FROM impact WHERE cancellations > 0
    UNION ALL SELECT case_id, 6, 'MEDIUM', 'Stagger departure slots by 10–15 min intervals',
      'Smooth peak load and reduce cascade delays' FROM impact WHERE window_hours <= 2 AND flight_count > 8),
    listed AS (SELECT * FROM advice UNION ALL
      SELECT case_id, 7, 'LOW', 'Normal operations — standard monitoring sufficient', 'No immediate action required'
      FROM impact WHERE case_id NOT IN (SELECT case_id FROM advice))
    SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY rule) - 1 AS INTEGER) AS position, priority, action, impact
    FROM listed"""
)
def case_recommendations(spark, d):
    return capacity.case_recommendations(_impact(spark, d))


# history ---------------------------------------------------------------------------------

HISTORY = with_views(FLIGHTS_SQL, PREDICTIONS_SQL)


@query(
    HISTORY
    + """SELECT count(*) AS total, round(avg(predicted_delay), 1) AS avg_delay, round(avg(delay_probability), 1) AS avg_probability,
      CAST(sum(CASE WHEN risk_level = 'HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_risk_count,
      CAST(sum(CASE WHEN risk_level = 'MEDIUM' THEN 1 ELSE 0 END) AS BIGINT) AS medium_risk_count,
      CAST(sum(CASE WHEN risk_level = 'LOW' THEN 1 ELSE 0 END) AS BIGINT) AS low_risk_count FROM predictions"""
)
def prediction_stats(spark, d):
    return history.prediction_stats(views.predictions(spark, d))


@query(
    HISTORY
    + """SELECT airline, count(*) AS total, round(avg(predicted_delay), 1) AS avg_delay,
      round(avg(delay_probability), 1) AS avg_probability FROM predictions GROUP BY airline"""
)
def predictions_by_airline(spark, d):
    return history.predictions_by_airline(views.predictions(spark, d))


@query(
    HISTORY
    + "SELECT hour, count(*) AS total, round(avg(predicted_delay), 1) AS avg_delay FROM predictions GROUP BY hour"
)
def predictions_by_hour(spark, d):
    return history.predictions_by_hour(views.predictions(spark, d))


@query(
    HISTORY
    + """SELECT id, created_at, airline, CAST(CAST(predicted_delay AS FLOAT) AS DOUBLE) AS predicted_delay, risk_level
    FROM predictions ORDER BY created_at DESC, id DESC LIMIT 50"""
)
def recent_predictions(spark, d):
    newest = history.recent(views.predictions(spark, d))
    return stable(newest.select("id", "created_at", "airline", "predicted_delay", "risk_level"), "predicted_delay")


@query(
    FLIGHTS
    + f""", scored AS (SELECT seq AS id, departure_time AS created_at, terminal, departure_hour AS hour, weather,
      least(CAST(100 AS DOUBLE), 30 * CAST(0.4 AS DOUBLE) + {FACTORS}
      + CASE WHEN is_weekend = 1 THEN 40 ELSE 20 END * CAST(0.1 AS DOUBLE)) AS score FROM flights)
    SELECT id, created_at, terminal, hour, weather, round_even(score, 1) AS risk_score, {LEVEL} FROM scored
    ORDER BY created_at DESC, id DESC LIMIT 20"""
)
def recent_risk_events(spark, d):
    f = views.flights(spark, d).select(
        F.col("seq").alias("id"), F.col("departure_time").alias("created_at"), "terminal",
        F.col("departure_hour").alias("hour"), "weather", F.weekday("departure_time").alias("day_of_week"),
    )
    scored = risk_scores.statistical_risk(f).withColumn("risk_score", F.bround("risk_score", 1))
    return history.recent(scored.drop("day_of_week"), 20)
