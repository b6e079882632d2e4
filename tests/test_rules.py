"""Boundaries of every bucketing and the formulas of the rule-based scores."""

import datetime as dt
import math

import pytest

from apronflow.functions import calendar, risk
from apronflow.plans import risk_scores


def values(spark, expression, inputs, kind="double"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i INT, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_delay_risk_boundaries(spark):
    got = values(spark, risk.delay_risk("x"), [0.0, 10.0, 15.0, 16.0, 30.0, 31.0, 120.0, None, math.nan])
    assert got == ["Low", "Low", "Low", "Medium", "Medium", "High", "High", "High", "High"]


def test_predicted_risk_boundaries(spark):
    got = values(spark, risk.predicted_risk("x"), [0.0, 14.9, 15.0, 29.9, 30.0])
    assert got == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH"]


def test_training_risk_boundaries(spark):
    got = values(spark, risk.training_risk("x"), [-1.0, -0.5, 15.0, 15.1, 40.0, 40.1, 9999.0, 10000.0, None])
    assert got == [None, "LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", None, None]


def test_probability_risk_boundaries(spark):
    got = values(spark, risk.probability_risk("x"), [0.0, 0.1, 40.0, 40.1, 70.0, 70.1, 100.0, 100.1])
    assert got == [None, "LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", None]


def test_score_risk_boundaries(spark):
    assert values(spark, risk.score_risk("x"), [39.9, 40.0, 69.9, 70.0]) == ["LOW", "MEDIUM", "MEDIUM", "HIGH"]


def test_binary_risk(spark):
    assert values(spark, risk.binary_risk("x"), [0, 1, 2, None], "INT") == ["LOW", "HIGH", None, None]


def test_delay_probability_limits(spark):
    assert values(spark, risk.delay_probability("x"), [-5.0, 0.0, 45.0, 90.0, 500.0]) == [0, 0, 50, 100, 100]


def test_on_time_and_delayed_at_fifteen(spark):
    assert values(spark, risk.is_delayed("x"), [15.0, 15.1, None]) == [0, 1, 0]
    assert values(spark, risk.on_time("x"), [15.0, 15.1, None]) == [1, 0, 0]


def test_hours(spark):
    peaks = values(spark, calendar.is_peak("x"), list(range(24)), "INT")
    assert [h for h, p in enumerate(peaks) if p] == [7, 8, 9, 17, 18, 19]
    nights = values(spark, calendar.is_night("x"), list(range(24)), "INT")
    assert [h for h, n in enumerate(nights) if n] == [0, 1, 2, 3, 4, 5, 23]
    assert values(spark, calendar.is_peak("x"), [None], "INT") == [0]
    assert values(spark, calendar.hour_from_minutes("x"), [0, 59, 60, 1439, 1440, 1500], "INT") == [0, 0, 1, 23, 0, 1]


def test_days(spark):
    assert values(spark, calendar.is_weekend_name("x"), ["Friday", "Saturday", "Sunday", None], "STRING") == [0, 1, 1, 0]
    assert values(spark, calendar.is_weekend_number("x"), [4, 5, 6], "INT") == [0, 1, 1]
    assert values(spark, calendar.day_position("x"), ["Mon", "Sun", "?"], "STRING") == [0, 6, None]


def test_weather_tables(spark):
    names = ["Clear", "Cloudy", "Rain", "Storm", "Snow", None]
    assert values(spark, risk.weather_code("x"), names, "STRING") == [0, 1, 2, 3, 0, 0]
    assert values(spark, risk.weather_factor("x"), names, "STRING") == [20, 40, 65, 85, 40, 40]
    assert values(spark, risk.weather_delay("x"), names, "STRING") == [0, 5, 15, 30, 0, 0]


@pytest.fixture(scope="module")
def scored(spark, sample_flights):
    cases = [(t, h, w) for t in ("T1", "T2", "T9") for h in (3, 8, 12, 14) for w in ("Clear", "Storm")]
    df = spark.createDataFrame(cases, "terminal STRING, hour INT, weather STRING")
    rows = risk_scores.operational_risk(df, sample_flights, dt.date(2024, 1, 31)).collect()
    return {(r.terminal, r.hour, r.weather): r.risk_score for r in rows}


def test_risk_properties(scored):
    assert all(0 <= s <= 100 for s in scored.values())
    assert scored["T1", 8, "Storm"] > 60
    assert scored["T2", 14, "Clear"] < 60
    for t in ("T1", "T2", "T9"):
        assert scored[t, 12, "Storm"] > scored[t, 12, "Clear"]
        assert scored[t, 8, "Clear"] > scored[t, 14, "Clear"]


def test_unseen_terminal_uses_default_factor(scored):
    assert scored["T9", 8, "Storm"] == pytest.approx(0.4 * 30 + 0.25 * 70 + 0.25 * 85 + 0.1 * 20)


def test_weekend_of_as_of_adds_two(spark, sample_flights):
    df = spark.createDataFrame([("T2", 8, "Rain")], "terminal STRING, hour INT, weather STRING")
    score = lambda day: risk_scores.operational_risk(df, sample_flights, day).first().risk_score
    assert score(dt.date(2024, 2, 3)) - score(dt.date(2024, 1, 31)) == pytest.approx(2)


def test_statistical_delay_formula(spark, sample_flights):
    df = spark.createDataFrame(
        [("TunisAir", "T3", "Storm", "Saturday"), ("Nobody", "T1", "Snow", "Monday")],
        "airline STRING, terminal STRING, weather STRING, day STRING",
    )
    got = {r.airline: r.predicted_delay for r in risk_scores.statistical_delay(df, sample_flights).collect()}
    assert got["TunisAir"] == pytest.approx(97.5 * 0.6 + 30 + 15 + 10)
    assert got["Nobody"] == pytest.approx(20 * 0.6 + 0 + 5)


def test_description_floors_negative_delays(spark):
    df = spark.createDataFrame([(-4.0,)], "predicted_delay DOUBLE")
    row = risk_scores.describe_prediction(df).first()
    assert (row.predicted_delay, row.delay_probability, row.risk_level) == (0.0, 0.0, "LOW")
    assert row.recommendation == "Normal operations"
