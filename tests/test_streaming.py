"""Streaming rules: equal to batch, late rows, duplicates, repeated batches."""

import datetime as dt

from pyspark.sql import functions as F

from apronflow.streaming import rules, sinks

START = dt.datetime(2024, 1, 1)
SCHEMA = "flight_id STRING, terminal STRING, gate STRING, delay_minutes DOUBLE, departure_time TIMESTAMP"


def rows_at(spark, *rows):
    return spark.createDataFrame(
        [(f, t, g, float(d), START + dt.timedelta(minutes=m)) for f, t, g, d, m in rows], SCHEMA
    ).coalesce(1)


def stream(spark, folder, schema):
    return sinks.stream_files(spark, str(folder), schema, per_batch=1)


def run(query):
    query.awaitTermination()
    return query


def test_delay_alerts_and_late_rows(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    first = rows_at(spark, *[(f"a{i}", "T1", "G1", 40, i) for i in range(3)], ("b", "T2", "G2", 40, 5), ("c", "T1", "G1", 5, 200))
    first.write.parquet(str(source))
    frame = stream(spark, source, first.schema)
    state = str(tmp_path / "state")
    run(sinks.start_table(rules.stream_delay_alerts(frame), out, state, once=True))
    got = spark.read.parquet(out).collect()
    assert [(r.terminal, r.flights, r.late_flights, r.window_start) for r in got] == [("T1", 3, 3, START)]

    # three rows behind the watermark: counted as dropped, no second alert for the window
    rows_at(spark, *[(f"l{i}", "T2", "G2", 90, 10 + i) for i in range(3)]).write.mode("append").parquet(str(source))
    query = run(sinks.start_table(rules.stream_delay_alerts(frame), out, state, once=True))
    assert sinks.late_rows_dropped(query) > 0
    assert spark.read.parquet(out).count() == 1


def test_congestion_windows(spark, tmp_path):
    rows = [("T1", 90, 0), ("T1", 80, 70), ("T2", 10, 0), ("T1", 10, 600)]
    df = spark.createDataFrame([(t, c, START + dt.timedelta(minutes=m)) for t, c, m in rows], "terminal STRING, congestion INT, timestamp TIMESTAMP")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    run(sinks.start_table(rules.stream_congestion(stream(spark, tmp_path / "in", df.schema)), out, str(tmp_path / "state"), once=True))
    batch = rules.stream_congestion(df).filter(F.col("window_end") <= START + dt.timedelta(minutes=540))
    columns = ["window_start", "terminal", "avg_congestion"]
    assert {tuple(r) for r in spark.read.parquet(out).select(columns).collect()} == {tuple(r) for r in batch.select(columns).collect()}
    assert batch.count() > 3


def test_dedupe_across_batches(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    copies = [("p1", "T1", "G1", 0, 0)] * 300
    first = rows_at(spark, *copies, ("p2", "T1", "G1", 0, 1)).repartition(4)
    first.write.parquet(str(source))
    rows_at(spark, ("p1", "T9", "G9", 0, 2), ("p3", "T1", "G1", 0, 3)).write.mode("append").parquet(str(source))
    unique = rules.stream_dedupe(stream(spark, source, first.schema), ["flight_id"], "departure_time", "1 day")
    run(sinks.start_table(unique, out, str(tmp_path / "state"), once=True))
    assert sorted(r.flight_id for r in spark.read.parquet(out).collect()) == ["p1", "p2", "p3"]


def test_repeated_history_batch_is_replaced(spark, tmp_path):
    df = rows_at(spark, ("p1", "T1", "G1", 0, 0), ("p2", "T1", "G1", 0, 1))
    df.write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for attempt in ("one", "two"):  # a lost state folder replays batch 0
        run(sinks.stream_history(stream(spark, tmp_path / "in", df.schema), out, str(tmp_path / attempt), once=True))
    assert spark.read.schema(df.schema).parquet(out).count() == 2


def test_gate_load(spark, tmp_path):
    rows = [(f"a{i}", "T1", "busy", 0, i) for i in range(9)] + [("b", "T1", "g1", 0, 1), ("c", "T1", "g2", 0, 2), ("z", "T1", "g3", 0, 300)]
    df = rows_at(spark, *rows)
    df.write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    run(sinks.stream_gate_load(stream(spark, tmp_path / "in", df.schema), out, str(tmp_path / "state"), once=True))
    got = spark.read.parquet(out).collect()
    assert [(r.busiest_gate, r.max_flights) for r in got] == [("busy", 9)]
