"""ARIMA forecasts of many series: conditional sum of squares with an innovations recursion.

A series is one row with its values in an array, so series are spread like any rows, and all
series of a batch are fitted together: the recursion runs over time, its numbers are vectors over series
and starting points. Parameters are kept stationary and invertible by writing them as partial
autocorrelations; a grid of starts is scored for every series, and the best few are improved by
Levenberg-Marquardt steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apronflow.functions.fixed_values import WEATHER_TREND_MULTIPLIER
from apronflow.plans.forecast import Z80

ORDER = (2, 1, 2)
STARTS = (-0.8, 0.0, 0.8)
IMPROVED = 4
STEPS = 60
# numbers held at once while the starts are scored
ROOM = 1 << 21

FIT = "phi array<double>, theta array<double>, sigma2 double, css double, log_likelihood double, method string"
POINTS = "array<struct<step:int,level:double,half:double>>"


def coefficients(partial: np.ndarray) -> np.ndarray:
    """(..., p) numbers in (-1, 1) as the coefficients of a stationary autoregression."""
    out = partial.copy()
    for k in range(1, partial.shape[-1]):
        out[..., :k] = out[..., :k] - partial[..., k : k + 1] * out[..., k - 1 :: -1][..., :k]
    return out


def innovations(diffs: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """One-step errors e[t] = d[t] - sum phi d[t-i] - sum theta e[t-j], from t = p on, with earlier
    errors taken as 0. ``diffs`` is (..., n), ``phi`` (..., p), ``theta`` (..., q)."""
    p, q, n = phi.shape[-1], theta.shape[-1], diffs.shape[-1]
    shape = np.broadcast_shapes(diffs.shape[:-1], phi.shape[:-1])
    e = np.zeros((*shape, q + n))
    for t in range(p, n):
        now = diffs[..., t]
        for i in range(p):
            now = now - phi[..., i] * diffs[..., t - 1 - i]
        for j in range(q):
            now = now - theta[..., j] * e[..., q + t - 1 - j]
        e[..., q + t] = now
    return e[..., q + p :]


def _parameters(u: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    partial = np.tanh(u)
    # 1 + theta z + ... is invertible where the autoregression of -theta is stationary
    return coefficients(partial[..., :p]), -coefficients(partial[..., p:])


def fit_css(diffs: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """phi, theta and the sum of squares of each row of ``diffs`` (series x length)."""
    series, k = len(diffs), p + q
    if not k:
        return np.zeros((series, 0)), np.zeros((series, 0)), (diffs**2).sum(axis=1)

    def errors(u: np.ndarray) -> np.ndarray:
        return innovations(diffs[:, None, :], *_parameters(u, p))

    grid = np.arctanh(np.array(list(product(STARTS, repeat=k)))) if k <= 4 else np.zeros((1, k))
    scores = (errors(np.broadcast_to(grid, (series, *grid.shape))) ** 2).sum(axis=-1)
    best = np.argsort(scores, axis=1, kind="stable")[:, :IMPROVED]
    u = grid[best]
    e = errors(u)
    css = (e**2).sum(axis=-1)
    damping = np.full(css.shape, 1e-2)
    for _ in range(STEPS):
        step = 1e-6
        moved = u[:, :, None, :] + step * np.eye(k)
        around = innovations(diffs[:, None, None, :], *_parameters(moved, p))
        jacobian = (around - e[:, :, None, :]) / step
        normal = jacobian @ jacobian.swapaxes(-1, -2)
        slope = (jacobian @ e[..., None])[..., 0]
        scale = damping[..., None, None] * (np.eye(k) * np.maximum(normal, 1e-12))
        change = -np.linalg.solve(normal + scale + 1e-12 * np.eye(k), slope[..., None])[..., 0]
        tried = np.clip(u + np.clip(change, -1, 1), -6, 6)
        tried_e = errors(tried)
        tried_css = (tried_e**2).sum(axis=-1)
        better = tried_css < css
        gain = np.where(better, (css - tried_css) / np.maximum(css, 1e-300), 0)
        u, e = np.where(better[..., None], tried, u), np.where(better[..., None], tried_e, e)
        css = np.where(better, tried_css, css)
        damping = np.where(better, damping / 3, damping * 4).clip(1e-9, 1e9)
        if gain.max(initial=0) < 1e-12 and (damping.min(initial=1e9) > 1e6 or not css.max(initial=0)):
            break
    first = np.argmin(css, axis=1)
    row = np.arange(series)
    phi, theta = _parameters(u[row, first], p)
    return phi, theta, css[row, first]


def psi_weights(phi: np.ndarray, theta: np.ndarray, d: int, steps: int) -> np.ndarray:
    """Weights of the last ``steps`` innovations in the series itself (after ``d`` summations)."""
    psi = np.zeros((len(phi), steps))
    for k in range(steps):
        psi[:, k] = 1.0 if k == 0 else theta[:, k - 1] if k <= theta.shape[1] else 0.0
        for i in range(min(k, phi.shape[1])):
            psi[:, k] += phi[:, i] * psi[:, k - 1 - i]
    for _ in range(d):
        psi = np.cumsum(psi, axis=1)
    return psi


def _ahead(values: np.ndarray, phi: np.ndarray, theta: np.ndarray, d: int, steps: int) -> np.ndarray:
    """The expected next values of each series."""
    levels = [values]
    for _ in range(d):
        levels.append(np.diff(levels[-1], axis=1))
    diffs = levels[-1]
    e = innovations(diffs, phi, theta)
    past, q = diffs, theta.shape[1]
    e = np.concatenate([np.zeros((len(e), q)), e], axis=1)
    for _ in range(steps):
        now = np.zeros(len(values))
        for i in range(phi.shape[1]):
            now += phi[:, i] * past[:, -1 - i]
        for j in range(q):
            now += theta[:, j] * e[:, -1 - j]
        past = np.concatenate([past, now[:, None]], axis=1)
        e = np.concatenate([e, np.zeros((len(e), 1))], axis=1)
    out = past[:, -steps:]
    for level in levels[-2::-1]:
        out = level[:, -1:] + np.cumsum(out, axis=1)
    return out


def _trend(values: np.ndarray, steps: int, factor: float) -> list[tuple[int, float, float]]:
    """Mean of the last six values plus their slope, which alone the weather scales."""
    slope = (values[-1] - values[-6]) / 6 if len(values) >= 6 else 0.0
    mean = values[-6:].mean()
    return [(i, mean + slope * i * factor, None) for i in range(1, steps + 1)]


def _fitter(order: tuple[int, int, int], steps: int, factor: float):
    p, d, q = order

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.array([v for v in x if v is not None and np.isfinite(v)], dtype=np.float64) for x in batch.column(1).to_pylist()]
            found: list[tuple] = [([], [], None, None, None, None, [])] * len(values)
            by_length: dict[int, list[int]] = {}
            for i, v in enumerate(values):
                if len(v) - d - p > p + q:
                    by_length.setdefault(len(v), []).append(i)
                elif len(v):
                    found[i] = ([], [], None, None, None, "trend", _trend(v, steps, factor))
            portions = []
            for length, rows in by_length.items():
                size = max(1, ROOM // (length * len(STARTS) ** min(4, p + q)))
                portions += [rows[i : i + size] for i in range(0, len(rows), size)]
            for rows in portions:
                same = np.stack([values[i] for i in rows])
                # in units of each series' own spread, so that the steps don't depend on its size
                diffs = np.diff(same, n=d, axis=1)
                unit = np.sqrt((diffs**2).mean(axis=1))
                phi, theta, css = fit_css(diffs / np.where(unit > 0, unit, 1)[:, None], p, q)
                still = unit == 0
                phi[still], theta[still] = 0, 0
                css = css * unit**2
                m = diffs.shape[1] - p
                sigma2 = css / m
                level = _ahead(same, phi, theta, d, steps)
                half = np.sqrt(sigma2[:, None] * np.cumsum(psi_weights(phi, theta, d, steps) ** 2, axis=1)) * Z80
                for n, i in enumerate(rows):
                    likelihood = None if sigma2[n] <= 0 else -m / 2 * (np.log(2 * np.pi * sigma2[n]) + 1)
                    points = [(s + 1, float(level[n, s]), float(half[n, s])) for s in range(steps)]
                    found[i] = (phi[n].tolist(), theta[n].tolist(), float(sigma2[n]), float(css[n]), likelihood, "arima", points)
            numbers = pa.list_(pa.float64())
            point = pa.list_(pa.struct([("step", pa.int32()), ("level", pa.float64()), ("half", pa.float64())]))
            types = [numbers, numbers, pa.float64(), pa.float64(), pa.float64(), pa.string(), point]
            columns = [[f[c] for f in found] for c in range(6)]
            columns.append([[{"step": s, "level": v, "half": h} for s, v, h in f[6]] for f in found])
            names = ["phi", "theta", "sigma2", "css", "log_likelihood", "method", "points"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], ["keys", *names])

    return fit


def arima_fit(
    series: DataFrame, by: list[str] | None = None, order: tuple[int, int, int] = ORDER, hours_ahead: int = 12, weather: str = "Clear"
) -> DataFrame:
    """One row per series: the keys, phi, theta, sigma2, css, log_likelihood, method and points.

    ``series`` holds (by, hour, value), one row per hour; unknown values are left out. A constant series
    fits with zero coefficients and no spread (and no finite likelihood). A series too short for more
    innovations than parameters has method "trend"; one without any value has no method and no points.
    """
    by = by or []
    keys = F.struct(*by) if by else F.struct(F.lit(0).alias("one"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("hour", "value"))), lambda x: x["value"])
    # a row per hour and series: the last step before the fit is bounded by a series' length
    rows = series.groupBy(keys.alias("keys")).agg(values.alias("values"))
    kind = rows.schema["keys"].dataType.simpleString()
    steps, factor = min(max(hours_ahead, 1), 24), WEATHER_TREND_MULTIPLIER.get(weather, 1.0)
    fitted = rows.mapInArrow(_fitter(order, steps, factor), f"keys {kind}, {FIT}, points {POINTS}")
    return fitted.select(*[F.col(f"keys.`{c}`") for c in by], *[c.split()[0] for c in FIT.split(", ")], "points")


def arima_forecast(
    series: DataFrame, hours_ahead: int = 12, weather: str = "Clear", by: list[str] | None = None, order: tuple[int, int, int] = ORDER
) -> DataFrame:
    """step, value and 80 % bounds per series; weather scales values and bounds, all floored at 0.

    Bounds come from the psi weights. Series too short for the model follow the trend rule, with bounds
    at 0.75 and 1.25 of the value.
    """
    by = by or []
    fitted = arima_fit(series, by, order, hours_ahead, weather)
    points = fitted.select(*by, "method", F.inline("points"))
    factor = WEATHER_TREND_MULTIPLIER.get(weather, 1.0)
    floored = lambda v: F.greatest(F.lit(0.0), v)

    def bound(sign: int, share: float) -> Column:
        return F.when(F.col("method") == "arima", floored((F.col("level") + sign * F.col("half")) * factor)).otherwise(floored(F.col("level")) * share)

    value = F.when(F.col("method") == "arima", floored(F.col("level") * factor)).otherwise(floored(F.col("level")))
    return points.select(*by, "step", value.alias("value"), bound(-1, 0.75).alias("lower_bound"), bound(1, 1.25).alias("upper_bound"))
