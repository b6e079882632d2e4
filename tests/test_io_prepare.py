"""Readers, writers, scratch tables and cleaning steps on files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from apronflow.operators import prepare
from apronflow.operators.gates import gate_performance
from apronflow.plans import history, star_schema
from apronflow.sources import readers, scratch, writers


def write(path, text):
    path.write_text(text)
    return str(path)


def test_read_flights(spark, tmp_path):
    path = write(
        tmp_path / "flights.csv",
        "Delay_Minutes , Flight_ID,airline,departure_time,departure_hour,extra\n"
        "15.0,F1,TunisAir,2024-01-06 08:30:00,1,x\n"
        "NaN,F2,Emirates,not a time,5,y\n"
        "31,F3,Emirates,,,z\n",
    )
    df = readers.read_flights(spark, path)
    rows = {r.flight_id: r for r in df.collect()}
    assert rows["F1"].departure_hour == 8 and rows["F1"].departure_day == "Saturday"
    assert rows["F1"].delay_risk == "Low" and rows["F3"].delay_risk == "High"
    assert rows["F2"].delay_minutes is None and rows["F2"].departure_time is None
    assert rows["F2"].departure_hour is None and rows["F3"].departure_hour is None
    assert rows["F3"].extra == "z"


def test_flights_without_any_time_keep_their_hours(spark, tmp_path):
    path = write(tmp_path / "flights.csv", "flight_id,departure_time,departure_hour\nF1,,9\nF2,,10\n")
    assert [r.departure_hour for r in readers.read_flights(spark, path).orderBy("flight_id").collect()] == [9, 10]


def test_read_passenger_flow_derives_hour(spark, tmp_path):
    path = write(tmp_path / "flow.csv", "timestamp,terminal,gate,passenger_count\n2024-01-06 17:05:00,T1,G1,12\n")
    row = readers.read_passenger_flow(spark, path).first()
    assert row.hour == 17 and row.passenger_count == 12
    path = write(tmp_path / "flow2.csv", "timestamp,hour,passenger_count\n2024-01-06 17:05:00,3,12\n")
    assert readers.read_passenger_flow(spark, path).first().hour == 3


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json", "orc"])
def test_raw_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([("B1", "P1", "lost"), ("B2", "P1", "delayed")], "baggage_id STRING, passenger_id STRING, status STRING")
    path = str(tmp_path / fmt)
    writers.write_clean(df, path, fmt)
    back = readers.read_raw(spark, "baggage", path, fmt)
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}


def test_read_bts_and_weather(spark, tmp_path):
    bts = write(tmp_path / "bts.csv", "Carrier,Origin,Dest,FlightDate,CRSDepTime,DepDelay,ArrDelay\nEmirates,DXB,TUN,2024-01-06,830,16,2\nOther,A,B,2024-01-06,1,1,1\n")
    row = prepare.prepare_bts(readers.read_raw(spark, "bts_flights", bts)).collect()
    assert [(r.carrier, r.day_of_week, r.delayed) for r in row] == [("Emirates", "Saturday", 1)]
    obs = write(tmp_path / "w.csv", "temperature,wind_speed,rain,humidity,is_delayed\n1,2,3,4,1\n")
    assert tuple(readers.read_raw(spark, "weather_observations", obs).first()) == (1.0, 2.0, 3.0, 4.0, 1)


def test_lenient_and_strict_timestamps(spark):
    df = spark.createDataFrame([("2024-01-06 08:30:00",), ("soon",)], "t STRING")
    assert [r.t for r in prepare.parse_timestamp(df, "t").collect()] == [dt.datetime(2024, 1, 6, 8, 30), None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CANNOT_PARSE_TIMESTAMP"):
        prepare.parse_timestamp(df, "t", strict=True).collect()


def test_normalize_columns(spark):
    df = spark.createDataFrame([(1, 2)], ["  Flight ID ", "GATE"])
    assert prepare.normalize_columns(df).columns == ["flight id", "gate"]


@pytest.mark.parametrize(
    "columns,expected",
    [
        ("departure_hour INT, day_of_week INT, airline STRING", (7, 2, "A")),
        ("time INT, dayofweek INT, airportfrom STRING", (0, 2, "A")),
        ("x INT, y INT, z STRING", (12, 3, None)),
    ],
)
def test_default_columns(spark, columns, expected):
    row = prepare.with_default_columns(spark.createDataFrame([(7, 2, "A")], columns)).first()
    assert (row.hour, row.dow, row.carrier) == expected


def test_require_hour_and_incomplete(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, None)], "departure_hour DOUBLE, x STRING")
    assert [r.departure_hour for r in prepare.require_hour(df).collect()] == [1, 3]
    assert prepare.drop_incomplete(df).count() == 1


def test_sorted_write(spark, tmp_path):
    df = spark.range(100).select((F.lit(100) - F.col("id")).alias("timestamp"))
    writers.write_sorted(df, str(tmp_path / "s"), "timestamp")
    parts = spark.read.parquet(str(tmp_path / "s")).select("timestamp", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n"))
    rows = parts.orderBy("n").collect()
    for a, b in zip(rows, rows[1:]):
        assert a.f != b.f or a.timestamp <= b.timestamp


def test_prediction_export(spark, tmp_path):
    df = spark.createDataFrame([("F1", 50.0)], "flight_id STRING, predicted_delay_percent DOUBLE")
    writers.write_predictions(df, str(tmp_path / "p"))
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).first().flight_id == "F1"


def test_history_append_and_read(spark, tmp_path):
    path = str(tmp_path / "h")
    early, late = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    for i, (at, level) in enumerate([(early, "LOW"), (late, "HIGH")]):
        df = spark.createDataFrame([(i, at, level, 20.0)], "id INT, created_at TIMESTAMP, risk_level STRING, predicted_delay DOUBLE")
        writers.append_history(df, "predictions", path)
    table = readers.read_history(spark, "predictions", path)
    assert [r.id for r in history.recent(table, 1).collect()] == [1]
    stats = history.prediction_stats(table).first()
    assert (stats.total, stats.high_risk_count, stats.low_risk_count, stats.avg_probability) == (2, 1, 1, None)
    with pytest.raises(Exception, match="created_at is required"):
        writers.append_history(df.withColumn("created_at", F.lit(None).cast("timestamp")), "predictions", path)


def test_recent_keeps_ties_and_order(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(days=i // 4)) for i in range(40)]
    spark.createDataFrame(rows, "id INT, created_at TIMESTAMP").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert [r.id for r in history.recent(table, 6).collect()] == [39, 38, 37, 36, 35, 34]
    assert history.recent(table, 99).count() == 40
    assert history.recent(table.filter("id < 0")).count() == 0


def test_filters_and_columns_reach_the_scan(spark, tmp_path, sample_flights):
    sample_flights.write.parquet(str(tmp_path / "f"))
    flights = spark.read.parquet(str(tmp_path / "f"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "In(airline" in plan(prepare.filter_airlines(flights, ["TunisAir", "Emirates"]))
    assert "EqualTo(terminal,T1)" in plan(prepare.filter_terminal(flights, "T1"))
    late = plan(flights.filter(F.col("delay_minutes") > 30).groupBy("airline").count())
    assert "GreaterThan(delay_minutes,30.0)" in late
    assert "ReadSchema: struct<flight_id:string,gate:string,delay_minutes:double>" in plan(gate_performance(flights))


def test_hot_time_is_written_in_order(spark, tmp_path):
    df = spark.range(0, 1000, 1, 8).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 50).alias("timestamp"))
    writers.write_sorted(df, str(tmp_path / "s"), "timestamp")
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.columns == ["timestamp"] and back.count() == 1000


def test_history_rounds_half_up(spark):
    df = spark.createDataFrame([("A", 0.25, 1.0), ("A", 0.25, 1.0)], "airline STRING, predicted_delay DOUBLE, delay_probability DOUBLE")
    assert history.predictions_by_airline(df).first().avg_delay == 0.3


def test_alert_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"])], "id STRING, actions ARRAY<STRING>")
    writers.write_alerts(df, str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).first().actions == ["x", "y"]


@pytest.mark.parametrize("parse_once", [True, False])
def test_star_is_written(spark, folder, tmp_path, parse_once):
    from apronflow.catalog import views

    path = str(tmp_path / "star")
    star_schema.build_star(views.flights(spark, folder), views.passenger_flow(spark, folder), path, parse_once=parse_once)
    fact = spark.read.parquet(f"{path}/fact_flights")
    assert fact.count() == 1000 and fact.select("date").distinct().count() > 5
    plan = fact.filter("date = '2024-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert spark.read.parquet(f"{path}/dim_airlines").count() == 5
    assert spark.read.parquet(f"{path}/summary_terminal").count() == 3


def test_scratch_follows_the_session(spark):
    assert scratch.scratch_folder(spark)
    df = spark.range(5).withColumn("x", F.lit("a"))
    back = scratch.materialize(df, "test")
    assert back.columns == df.columns and back.count() == 5
    assert scratch.materialize(df.filter("false"), "test").count() == 0
