"""Shapley values by tables of leaves: equal to a plain loop over leaves, without a pass per leaf and feature."""

import numpy as np
import pytest

from apronflow.models import shapley


def paths(rng, leaves, width, classes, depth):
    used = np.zeros((leaves, width), bool)
    for row in used:
        row[rng.choice(width, rng.integers(0, depth + 1), replace=False)] = True
    low = np.where(used & (rng.random(used.shape) < 0.6), rng.integers(-1, 3, used.shape) + 0.5, -np.inf)
    high = np.where(used & (rng.random(used.shape) < 0.6), np.where(np.isinf(low), 0.5, low + 1), np.inf)
    share = np.where(used, rng.uniform(0.1, 0.9, used.shape), 1.0)
    return {"low": low, "high": high, "share": share, "used": used, "value": rng.random((leaves, classes))}


def plain(x, pick, paths):
    """One leaf after another, every feature of its path over all rows."""
    x = np.where(np.isnan(x), np.inf, x)
    out, base = np.zeros(x.shape), np.zeros(len(x))
    for low, high, share, used, value in zip(*(paths[c] for c in ("low", "high", "share", "used", "value"))):
        mine = value[pick]
        base += mine * share.prod()
        on = np.flatnonzero(used)
        if len(on):
            through = ((x > low) & (x <= high) | (np.isneginf(low) & (x <= high)))[:, on].T
            out[:, on] += (shapley._weights(share[on], through) * mine).T
    return out, base


@pytest.mark.parametrize("rows, width, classes, depth", [(500, 9, 3, 9), (40, 7, 1, 7), (3, 10, 2, 10), (1, 2, 1, 0)])
def test_equal_to_a_loop_over_leaves(rows, width, classes, depth):
    rng = np.random.default_rng(rows)
    x = rng.integers(-1, 4, (rows, width)).astype(float)
    x[:, -1] += rng.random(rows)
    x[rng.random(x.shape) < 0.05] = np.nan
    x[rng.random(x.shape) < 0.05] = -np.inf
    pick = rng.integers(0, classes, rows)
    leaves = paths(rng, 200, width, classes, depth)
    for found, wanted in zip(shapley.contributions(x, pick, leaves), plain(x, pick, leaves)):
        assert found == pytest.approx(wanted, abs=1e-9)


def test_weights_are_made_for_many_leaves_at_once(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(shapley, "_weights", None)
    made = []
    tables = shapley._tables
    monkeypatch.setattr(shapley, "_tables", lambda share: made.append(len(share)) or tables(share))
    leaves = paths(rng, 640, 5, 2, 5)
    shapley.contributions(rng.integers(0, 3, (300, 5)).astype(float), rng.integers(0, 2, 300), leaves)
    assert sum(made) == leaves["used"].any(axis=1).sum() and len(made) <= 5 * -(-640 // shapley.LEAVES)


def test_groups_name_every_combination_of_a_row():
    rng = np.random.default_rng(2)
    codes = np.stack([rng.integers(0, n, 400) for n in (5, 3, 2, 24, 7, 400)])
    groups = shapley._groups(codes)
    assert [f for members, _, _ in groups for f in members] == list(range(6)) and len(groups) < 6
    for members, combinations, row in groups:
        assert np.array_equal(combinations[:, row], codes[members])


def test_no_rows_and_no_leaves():
    leaves = paths(np.random.default_rng(3), 5, 2, 1, 2)
    none = shapley.contributions(np.zeros((0, 2)), np.zeros(0, np.int64), leaves)
    assert none[0].shape == (0, 2) and none[1].shape == (0,)
    empty = {c: v[:0] for c, v in leaves.items()}
    out, base = shapley.contributions(np.ones((3, 2)), np.zeros(3, np.int64), empty)
    assert out.tolist() == [[0, 0]] * 3 and base.tolist() == [0] * 3
