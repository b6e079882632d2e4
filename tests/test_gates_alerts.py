"""Gate metrics, conflicts by brute force, alerts and suggestions on edge frames."""

import datetime as dt
import itertools
import random

import pytest

from apronflow.operators import gates, kpis
from apronflow.operators.joins import baggage_by_terminal, encode
from apronflow.operators.prepare import filter_terminal
from apronflow.plans import alerts

NOW = dt.datetime(2024, 1, 31, 8, 15)


def gate_frame(spark, delays):
    rows = [(f"F{g}{i}", g, float(d)) for g, values in delays.items() for i, d in enumerate(values)]
    return spark.createDataFrame(rows, "flight_id STRING, gate STRING, delay_minutes DOUBLE")


def test_performance_properties(spark, sample_flights):
    rows = gates.gate_performance(sample_flights).collect()
    assert all(0 <= r.utilization <= 100 and 0 <= r.efficiency <= 100 for r in rows)
    assert {r.gate: r.efficiency for r in rows}["T1-G2"] == 0.0
    unclipped = {r.gate: r.efficiency for r in gates.gate_performance(sample_flights, clip=False).collect()}
    assert unclipped["T1-G2"] == -10.0


def test_null_gates_and_delays(spark):
    df = spark.createDataFrame(
        [("a", None, 5.0), ("b", "G1", None), ("c", "G2", 4.0)],
        "flight_id STRING, gate STRING, delay_minutes DOUBLE",
    )
    rows = {r.gate: r for r in gates.gate_performance(df).collect()}
    assert set(rows) == {"G1", "G2"} and rows["G1"].efficiency is None


def test_ranking_ties_by_name(spark):
    df = gate_frame(spark, {"B": [10], "A": [10], "C": [1]})
    assert [r.gate for r in gates.gate_ranking(gates.gate_performance(df)).collect()] == ["C", "A", "B"]


def test_least_bad_gate_is_paired_first(spark):
    df = gate_frame(spark, {"good": [5], "better": [2], "bad": [45], "worse": [60], "worst": [90]})
    pairs = gates.pair_gates(gates.gate_performance(df)).orderBy("position").collect()
    assert [(p.worst_gate, p.best_gate) for p in pairs] == [("bad", "better"), ("worse", "good")]
    flipped = gates.pair_gates(gates.gate_performance(df), worst_first=True).orderBy("position").collect()
    assert [(p.worst_gate, p.best_gate) for p in flipped] == [("worst", "better"), ("worse", "good")]


def test_suggestions(spark, sample_flights):
    rows = gates.gate_suggestions(sample_flights).collect()
    assert 2 <= len(rows) <= 5
    assert all(r.action and r.reason and r.impact and r.priority in {"HIGH", "MEDIUM", "LOW"} for r in rows)
    assert rows[0].action.endswith("Reassign flights from T1-G1 to T3-G1") and rows[0].priority == "HIGH"
    none = gates.gate_suggestions(gate_frame(spark, {"A": [30]})).collect()
    assert [r.priority for r in none] == ["MEDIUM", "HIGH"]


def test_recommendation_needs_both_sides(spark):
    assert gates.gate_recommendation(gate_frame(spark, {"A": [90]})).count() == 0
    row = gates.gate_recommendation(gate_frame(spark, {"A": [90], "B": [1]})).first()
    assert row.action == "Move flights from Gate A to Gate B"
    assert row.reason == "Gate A has 90.0 min avg delay"


def test_conflicts_against_all_pairs(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        gate = "hot" if rng.random() < 0.4 else f"g{rng.randrange(4)}"
        # a third of the hot gate shares one second
        second = 3600 if gate == "hot" and rng.random() < 0.33 else rng.randrange(36000)
        rows.append((f"f{i}", gate, start + dt.timedelta(seconds=second)))
    rows += [("edge1", "edge", start), ("edge2", "edge", start + dt.timedelta(minutes=30)),
             ("edge3", "edge", start + dt.timedelta(minutes=60, seconds=1))]
    df = spark.createDataFrame(rows, "flight_id STRING, gate STRING, departure_time TIMESTAMP")
    others, pairs = {}, {}
    for a, b in itertools.combinations(rows, 2):
        if a[1] == b[1] and abs((a[2] - b[2]).total_seconds()) <= 1800:
            others[a[0]] = others.get(a[0], 0) + 1
            others[b[0]] = others.get(b[0], 0) + 1
            pairs[a[1]] = pairs.get(a[1], 0) + 1
    assert {r.flight_id: r.others_within for r in gates.gate_conflicts(df).collect()} == others
    summary = gates.gate_conflict_summary(df).collect()
    assert {r.gate: r.conflict_pairs for r in summary if r.conflict_pairs} == pairs
    assert sum(r.flights for r in summary) == len(rows)
    assert sum(r.in_conflict for r in summary) == len(others)


def test_baggage_join_counts_every_pair(spark):
    bags = spark.createDataFrame([("p1", "lost")] * 30 + [("p2", "delivered"), ("p9", "lost")], "passenger_id STRING, status STRING")
    people = spark.createDataFrame([("p1", "T1"), ("p1", "T2"), ("p2", "T2")], "passenger_id STRING, terminal STRING")
    got = {(r.terminal, r.status): r.bags for r in baggage_by_terminal(bags, people).collect()}
    assert got == {("T1", "lost"): 30, ("T2", "lost"): 30, ("T2", "delivered"): 1}


def test_encode_unseen_and_null(spark):
    dim = spark.createDataFrame([("a", 0), ("b", 1)], "value STRING, code INT")
    df = spark.createDataFrame([(1, "b"), (2, "x"), (3, None)], "i INT, name STRING")
    assert {r.i: r.c for r in encode(df, dim, "name", "c").collect()} == {1: 1, 2: 0, 3: 0}


def test_home_kpis(spark, sample_flights):
    empty = kpis.home_kpis(sample_flights.filter("false")).first()
    assert (empty.total_flights, empty.avg_delay, empty.high_risk) == (0, None, 0)
    row = kpis.home_kpis(sample_flights).first()
    assert (row.total_flights, row.avg_delay, row.high_risk, row.on_time_pct) == (5, 46.4, 2, 40.0)


def test_histogram_holds_every_flight(spark):
    df = spark.createDataFrame([(float(i),) for i in range(61)], "delay_minutes DOUBLE")
    rows = kpis.delay_histogram(df).collect()
    assert sum(r.flights for r in rows) == 61 and max(r.bin for r in rows) == 30
    same = kpis.delay_histogram(df.filter("delay_minutes = 3")).collect()
    assert [(r.bin, r.flights) for r in same] == [(1, 1)]


def test_filter_terminal_all(spark, sample_flights):
    assert filter_terminal(sample_flights).count() == 5
    assert filter_terminal(sample_flights, "T1").count() == 2


def test_delay_alert_threshold(spark, sample_flights):
    assert alerts.delay_alert(sample_flights, NOW).count() == 0
    row = alerts.delay_alert(sample_flights, NOW, threshold=10).first()
    assert (row.id, row.type, row.priority) == ("DELAY_0815", "DELAY", "HIGH")
    assert row.message == "4 flights delayed >10min"
    assert row.details == "Airlines affected: TunisAir, Air France, Lufthansa"
    assert alerts.delay_alert(sample_flights.filter("false"), NOW).count() == 0


def test_congestion_alert(spark):
    flow = spark.createDataFrame([(8, 150), (8, 80), (9, 1)], "hour INT, passenger_count INT")
    row = alerts.congestion_alert(flow, NOW).first()
    assert row.message == "Average congestion: 115 passengers/hour" and row.details == "Peak at 150 passengers"
    assert alerts.congestion_alert(flow, NOW, hour=9).count() == 0
    assert alerts.congestion_alert(flow, NOW, hour=3).count() == 0


def test_weather_alert(spark, sample_flights):
    assert [r.title for r in alerts.weather_alert(sample_flights, NOW).collect()] == ["Adverse Weather Alert: Storm"]


def test_gate_overuse_alert(spark):
    df = gate_frame(spark, {"A": [1] * 7, "B": [1], "C": [1]})
    row = alerts.gate_overuse_alert(df, NOW).first()
    assert row.title == "Gate A Overutilized" and row.message == "7 flights vs average 3.0"
    assert row.actions[0] == "Move some flights from A"
    assert alerts.gate_overuse_alert(gate_frame(spark, {"A": [1, 1], "B": [1]}), NOW).count() == 0


def test_alert_order_is_stable(spark):
    rows = [("a", "LOW", 0), ("b", "MEDIUM", 1), ("c", "??", 2), ("d", "CRITICAL", 3), ("e", "MEDIUM", 0)]
    df = spark.createDataFrame([(t, p, s) for t, p, s in rows], "title STRING, priority STRING, seq INT")
    assert [r.title for r in alerts.alert_order(df).collect()] == ["d", "e", "b", "a", "c"]
    assert alerts.top_alert(df).first().title == "d"


def test_recent_alerts(spark):
    log = spark.createDataFrame([("old", NOW - dt.timedelta(hours=24)), ("new", NOW - dt.timedelta(hours=23))], "id STRING, timestamp TIMESTAMP")
    assert [r.id for r in alerts.recent_alerts(log, NOW).collect()] == ["new"]


def test_quartiles_single_value(spark):
    df = spark.createDataFrame([("x", 4.0), ("y", None)], "weather STRING, delay_minutes DOUBLE")
    rows = kpis.delay_quartiles(df, "weather").collect()
    assert [(r.weather, r["min"], r["median"], r["max"]) for r in rows] == [("x", 4.0, 4.0, 4.0)]
    assert pytest.approx(kpis.delay_quartiles(df, "weather", approximate=True).first().q1) == 4.0
