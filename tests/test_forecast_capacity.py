"""Series, forecasts, weekly outlook and capacity cases against hand-computed values."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from apronflow.operators.series import interpolate_hours, last_mean_and_trend
from apronflow.plans import capacity, forecast

NOW = dt.datetime(2024, 1, 31, 22, 30)


def series_frame(spark, known):
    return spark.createDataFrame([(h, known.get(h)) for h in range(24)], "hour INT, value DOUBLE")


def filled(spark, known):
    return [r.value for r in interpolate_hours(series_frame(spark, known)).orderBy("hour").collect()]


@pytest.mark.parametrize(
    "known", [{3: 10.0, 7: 30.0, 20: 4.0}, {0: 1.0, 23: 24.0}, {12: 5.0}, {h: float(h * h) for h in range(24)}]
)
def test_interpolation_equals_pandas(spark, known):
    s = pd.Series([known.get(h, np.nan) for h in range(24)], dtype=float)
    expected = s.interpolate(method="linear").bfill().fillna(20.0)
    assert filled(spark, known) == pytest.approx(expected.tolist())


def test_interpolation_of_nothing(spark):
    assert filled(spark, {}) == [20.0] * 24


def test_series_of_empty_table(spark, sample_flights):
    rows = forecast.hourly_series(sample_flights.filter("false")).collect()
    assert [r.value for r in rows] == [20.0] * 24


def test_trend_uses_last_six_hours(spark):
    row = last_mean_and_trend(series_frame(spark, {h: float(h) for h in range(24)})).first()
    assert row["mean"] == 20.5 and row.trend == pytest.approx(5 / 6)


def test_weather_scales_trend_only(spark):
    s = series_frame(spark, {h: float(h) for h in range(24)})
    rows = forecast.trend_forecast(s, 3, "Storm").orderBy("step").collect()
    assert [r.value for r in rows] == pytest.approx([20.5 + 5 / 6 * i * 1.75 for i in (1, 2, 3)])
    assert rows[0].lower_bound == pytest.approx(rows[0].value * 0.75)
    assert rows[0].upper_bound == pytest.approx(rows[0].value * 1.25)


@pytest.mark.parametrize("asked,given", [(0, 1), (12, 12), (99, 24)])
def test_hours_are_clamped(spark, asked, given):
    s = series_frame(spark, {0: 1.0})
    assert forecast.trend_forecast(s, asked).count() == given
    assert forecast.ar_forecast(s, asked).count() == given


def test_falling_trend_is_floored(spark):
    s = series_frame(spark, {h: float(230 - 10 * h) for h in range(24)})
    rows = forecast.trend_forecast(s, 24).orderBy("step").collect()
    assert rows[-1].value == 0.0


def test_ar_of_constant_series_is_constant(spark):
    rows = forecast.ar_forecast(series_frame(spark, {h: 30.0 for h in range(24)}), 5, "Rain").collect()
    assert {(r.value, r.lower_bound, r.upper_bound) for r in rows} == {(42.0, 42.0, 42.0)}


def test_ar_equals_numpy(spark):
    x = 30 + 10 * np.sin(np.arange(24) / 3.0) + np.random.default_rng(1).normal(0, 2, 24)
    d = np.diff(x)
    p1, p2 = np.linalg.lstsq(np.column_stack([d[1:-1], d[:-2]]), d[2:], rcond=None)[0]
    expected, level, d1, d2 = [], x[-1], d[-1], d[-2]
    for _ in range(6):
        d1, d2 = p1 * d1 + p2 * d2, d1
        level += d1
        expected.append(max(0.0, level))
    s = series_frame(spark, dict(enumerate(map(float, x))))
    rows = forecast.ar_forecast(s, 6).orderBy("step").collect()
    assert [r.value for r in rows] == pytest.approx(expected)
    widths = [r.upper_bound - r.lower_bound for r in rows]
    assert all(r.lower_bound <= r.value <= r.upper_bound for r in rows) and widths == sorted(widths)


def test_warnings_compare_before_rounding(spark):
    df = spark.createDataFrame([(1, 45.0), (2, 45.01), (3, 60.0), (4, 60.04)], "step INT, value DOUBLE")
    rows = forecast.peak_warnings(df, NOW).orderBy("step").collect()
    assert [(r.step, r.delay, r.level) for r in rows] == [(2, 45.0, "HIGH"), (3, 60.0, "HIGH"), (4, 60.0, "CRITICAL")]
    assert rows[0].time == "00:30" and rows[0].message == "Expected 45.0 min avg delay at 00:30"
    assert [r.step for r in forecast.first_warnings(forecast.peak_warnings(df, NOW), 2).collect()] == [2, 3]


def test_summary(spark):
    df = spark.createDataFrame([(1, 10.04), (2, 50.06)], "step INT, value DOUBLE")
    row = forecast.forecast_summary(df).first()
    assert (row.forecast_avg, row.forecast_max, row.peak_warnings_count) == (30.0, 50.1, 1)


def test_many_series_equal_single_series(spark, sample_flights):
    both = forecast.hourly_series(sample_flights, ["terminal"]).filter("terminal = 'T1'").orderBy("hour")
    one = forecast.hourly_series(sample_flights.filter("terminal = 'T1'")).orderBy("hour")
    assert [r.value for r in both.collect()] == [r.value for r in one.collect()]


def test_weekly_defaults_and_first_peak(spark):
    df = spark.createDataFrame([("Tue", 40.0), ("Thu", 40.0), ("Fri", -3.0), (None, 99.0)], "day_of_week STRING, delay_minutes DOUBLE")
    row = forecast.weekly_outlook(df).first()
    assert [(p.day, p.value) for p in row.days] == [
        ("Mon", 25.0), ("Tue", 40.0), ("Wed", 25.0), ("Thu", 40.0), ("Fri", 0.0), ("Sat", 25.0), ("Sun", 25.0)]
    assert row.peak_day == "Tue" and row.avg == 25.7


# capacity --------------------------------------------------------------------------------


def impact(spark, flights, *cases):
    rows = [(f"c{i}", *c) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "case_id STRING, terminal STRING, weather STRING, flight_count BIGINT, start_hour INT, end_hour INT")
    return capacity.case_impact(df, flights)


def test_case_formulas(spark, sample_flights):
    row = capacity.case_report(impact(spark, sample_flights, ("T2", "Storm", 40, 8, 10))).first()
    overload = 40 / 36
    cascade = (overload - 0.8) * 40 * 45 * 1.8 / 6
    total = 16 * 1.85 + cascade
    assert row.window == "8:00 – 10:00" and (row.gate_count, row.capacity) == (6, 36)
    assert row.avg_delay_min == pytest.approx(round(total, 1))
    assert row.total_delay_minutes == round(total * 40)
    assert row.cascade_delay_min == pytest.approx(round(cascade, 1))
    assert row.gate_overload_pct == pytest.approx(round(overload * 85, 1))
    assert row.terminal_capacity_pct == 100.0
    assert (row.cancellations, row.diversions, row.affected_passengers) == (9, 4, 7200)
    assert row.risk_level == "CRITICAL"


def test_case_defaults(spark, sample_flights):
    row = impact(spark, sample_flights, ("T9", "Snow", 5, 8, 8)).first()
    assert (row.gate_count, row.window_hours, row.base_delay, row.adjusted_delay) == (6, 1, 25.0, 25.0)


def test_case_levels(spark):
    df = spark.createDataFrame(
        [(20.0, 0.7), (20.1, 0.7), (20.0, 0.71), (35.0, 0.9), (35.1, 0.5), (10.0, 0.91), (60.1, 0.0), (0.0, 1.21)],
        "d DOUBLE, o DOUBLE")
    got = [r[0] for r in df.select(capacity.case_level(df.d, df.o)).collect()]
    assert got == ["LOW", "MEDIUM", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL", "CRITICAL"]


def test_empty_window_has_no_hours(spark, sample_flights):
    frame = impact(spark, sample_flights, ("T1", "Clear", 30, 10, 10), ("T1", "Clear", 30, 10, 8), ("T1", "Clear", 30, 8, 10))
    rows = capacity.case_hourly(frame).collect()
    assert sorted((r.case_id, r.hour) for r in rows) == [("c2", 8), ("c2", 9)]
    assert rows[0].flights == 15.0 and rows[0].gate_load_pct == 62.5 and rows[0].status == "NORMAL"


def test_recommendations_in_order(spark, sample_flights):
    frame = impact(spark, sample_flights, ("T3", "Storm", 60, 8, 10), ("T3", "Clear", 3, 8, 20))
    rows = capacity.case_recommendations(frame).orderBy("case_id", "position").collect()
    busy = [r for r in rows if r.case_id == "c0"]
    assert [r.priority for r in busy] == ["CRITICAL", "HIGH", "HIGH", "MEDIUM", "MEDIUM", "MEDIUM"]
    assert [r.position for r in busy] == list(range(6))
    assert busy[0].action == "Redistribute 60 flights to T2/T3"
    assert busy[1].impact == "Mitigate Storm impact — pre-position de-icing/ground crew"
    assert busy[3].action == "Open 6 additional gate(s) in T3"
    assert busy[4].action == "Pre-arrange rebooking for ~13 expected cancellations"
    quiet = [r for r in rows if r.case_id == "c1"]
    assert [(r.priority, r.action) for r in quiet] == [("LOW", "Normal operations — standard monitoring sufficient")]
