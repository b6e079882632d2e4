"""ARIMA by conditional sum of squares: against plain Python, grid search and known processes."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from apronflow.plans import arima
from apronflow.plans.forecast import Z80


def simulated(seed, n, phi, theta, size=5.0):
    rng = random.Random(seed)
    d, e = [0.0] * len(phi), [0.0] * len(theta)
    out = [30.0]
    for _ in range(n - 1):
        now = rng.gauss(0, size)
        d.append(sum(a * x for a, x in zip(phi, d[::-1])) + now + sum(b * x for b, x in zip(theta, e[::-1])))
        e.append(now)
        out.append(out[-1] + d[-1])
    return out


SERIES = {
    ("T1", "A"): simulated(1, 24, (0.5, -0.3), (0.4, 0.2)),
    ("T1", "B"): simulated(2, 24, (0.2, 0.1), (-0.7, 0.1)),
    ("T2", "A"): simulated(3, 24, (-0.6, 0.2), (0.1, 0.5), 0.01),
    ("T2", "B"): simulated(4, 60, (0.9, -0.4), (0.3, 0.0), 900.0),
    ("T3", "A"): [30.0] * 24,
    ("T3", "B"): [5.0, 7.0, 9.0],
    ("T3", None): [1.0, 2.0, 4.0, 3.0, 5.0, 9.0, 8.0],
    ("T4", "A"): [None] * 24,
}


@pytest.fixture(scope="module")
def series(spark):
    rows = [(*k, h, v) for k, x in SERIES.items() for h, v in enumerate(x)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "terminal STRING, gate STRING, hour INT, value DOUBLE").repartition(4)


def css(values, phi, theta):
    d = [b - a for a, b in zip(values, values[1:])]
    e = [0.0] * len(d)
    for t in range(len(phi), len(d)):
        e[t] = d[t] - sum(a * d[t - 1 - i] for i, a in enumerate(phi)) - sum(b * e[t - 1 - j] for j, b in enumerate(theta) if t - 1 - j >= 0)
    return sum(x * x for x in e[len(phi) :]), e


def pairs(step):
    """Stationary (a1, a2) from a grid of partial autocorrelations."""
    grid = np.arange(-0.95, 0.96, step)
    return [(r1 * (1 - r2), r2) for r1, r2 in itertools.product(grid, grid)]


def test_no_worse_than_a_grid_search(series):
    fits = {(r.terminal, r.gate): r for r in arima.arima_fit(series, ["terminal", "gate"]).collect()}
    assert set(fits) == set(SERIES)
    for key in [("T1", "A"), ("T1", "B"), ("T2", "A"), ("T2", "B")]:
        r, values = fits[key], SERIES[key]
        own, _ = css(values, r.phi, r.theta)
        assert r.method == "arima" and own == pytest.approx(r.css)
        least = min(css(values, phi, (-a, -b))[0] for phi in pairs(0.19) for a, b in pairs(0.19))
        assert own <= least * (1 + 1e-9)
        m = len(values) - 3
        assert r.sigma2 == pytest.approx(own / m)
        assert r.log_likelihood == pytest.approx(sum(-0.5 * math.log(2 * math.pi * r.sigma2) for _ in range(m)) - m / 2)
        # stationary and invertible
        for a, b in (r.phi, [-x for x in r.theta]):
            assert abs(b) < 1 and a + b < 1 and b - a < 1


def test_forecast_is_the_recursion_with_psi_bounds(series):
    key, values = ("T1", "A"), SERIES["T1", "A"]
    fit = {(r.terminal, r.gate): r for r in arima.arima_fit(series, ["terminal", "gate"]).collect()}[key]
    rows = arima.arima_forecast(series, 6, "Rain", ["terminal", "gate"]).filter("terminal = 'T1' AND gate = 'A'").orderBy("step").collect()
    _, e = css(values, fit.phi, fit.theta)
    d, level, psi = [b - a for a, b in zip(values, values[1:])], values[-1], []
    for h, r in enumerate(rows):
        d.append(sum(a * d[-1 - i] for i, a in enumerate(fit.phi)) + sum(b * e[-1 - j] for j, b in enumerate(fit.theta)))
        e.append(0.0)
        level += d[-1]
        psi.append((1.0 if h == 0 else fit.theta[h - 1] if h <= 2 else 0.0) + sum(a * psi[h - 1 - i] for i, a in enumerate(fit.phi) if h - 1 - i >= 0))
        half = Z80 * math.sqrt(fit.sigma2 * sum(sum(psi[: k + 1]) ** 2 for k in range(h + 1)))
        expected = [max(0.0, 1.4 * x) for x in (level, level - half, level + half)]
        assert r.step == h + 1 and [r.value, r.lower_bound, r.upper_bound] == pytest.approx(expected)


def test_parameters_of_a_long_series_are_found(spark):
    values = simulated(11, 4000, (0.6, -0.3), (0.5, 0.2))
    df = spark.createDataFrame(list(enumerate(values)), "hour INT, value DOUBLE")
    r = arima.arima_fit(df).first()
    assert r.phi == pytest.approx([0.6, -0.3], abs=0.15) and r.theta == pytest.approx([0.5, 0.2], abs=0.15)
    assert r.sigma2 == pytest.approx(25, rel=0.1)


def test_constant_short_and_unknown_series(series):
    rows = arima.arima_forecast(series, 4, "Storm", ["terminal", "gate"]).orderBy("step").collect()
    by = lambda *k: [tuple(r)[2:] for r in rows if (r.terminal, r.gate) == k]
    assert by("T3", "A") == [(i, 52.5, 52.5, 52.5) for i in range(1, 5)]
    assert by("T3", "B") == [(i, 7.0, 5.25, 8.75) for i in range(1, 5)]
    # mean of the last six is 31 / 6, their slope 1 an hour, which the storm scales
    assert [v for _, v, _, _ in by("T3", None)] == pytest.approx([31 / 6 + 1.75 * i for i in range(1, 5)])
    assert by("T4", "A") == []
    assert arima.arima_forecast(series.limit(0), 4, by=["terminal"]).count() == 0


def test_other_orders(series):
    one = series.filter("terminal = 'T1' AND gate = 'A'")
    walk = arima.arima_forecast(one, 3, order=(0, 1, 0)).collect()
    assert [r.value for r in walk] == pytest.approx([max(0.0, SERIES["T1", "A"][-1])] * 3)
    less, more = (arima.arima_fit(one, order=o).first().css for o in ((1, 1, 0), (1, 1, 1)))
    assert more <= less * (1 + 1e-9)
    assert arima.arima_forecast(one, 99).count() == 24 and arima.arima_forecast(one, 0).count() == 1
    assert arima.arima_fit(one.withColumn("value", F.col("value") * 1e6)).first().phi == pytest.approx(arima.arima_fit(one).first().phi, abs=1e-4)
