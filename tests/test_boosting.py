"""Second-order boosting and ROC AUC against plain Python."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from apronflow.models import boosting, evaluation, shapley

FEATURES = ["a", "b", "c"]


def rows_of(n, seed):
    rng = random.Random(seed)
    rows = [(i, float(rng.randrange(12)), float(rng.randrange(7)), rng.random()) for i in range(n)]
    return [(*r, int(r[1] + 3 * (r[2] > 3) + rng.gauss(0, 2) > 7)) for r in rows]


SCHEMA = "id LONG, a DOUBLE, b DOUBLE, c DOUBLE, y INT"


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows_of(1500, 1), SCHEMA).repartition(3)


def brute_split(rows, g, h, l2=1.0, min_child=1.0):
    """Gain, feature and threshold of the best split over all values of 200 rows."""
    best = (0.0, None, None)
    part = lambda idx: sum(g[i] for i in idx) ** 2 / (sum(h[i] for i in idx) + l2)
    every = range(len(rows))
    for f, t in ((f, t) for f in range(3) for t in sorted({r[1 + f] for r in rows})):
        below, above = [i for i in every if rows[i][1 + f] <= t], [i for i in every if rows[i][1 + f] > t]
        if sum(h[i] for i in below) < min_child or sum(h[i] for i in above) < min_child:
            continue
        gain = (part(below) + part(above) - part(every)) / 2
        if gain > best[0] + 1e-9:
            best = (gain, f, t)
    return best


def test_splits_and_weights_equal_brute_force(spark):
    rows = rows_of(200, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    # as many bins as rows: every value is a cut point
    model = boosting.train_boosted(df, FEATURES, "y", "id", rounds=2, depth=2, step=0.3, row_share=1.0, column_share=1.0, bins=1000)
    margin = [0.0] * len(rows)
    for tree in model.trees:
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [a - r[4] for a, r in zip(p, rows)], [a * (1 - a) for a in p]
        members = {1: list(range(len(rows)))}
        for node in (1, 2, 3):
            idx = members.get(node)
            if not idx:
                continue
            gain, f, t = brute_split([rows[i] for i in idx], [g[i] for i in idx], [h[i] for i in idx])
            assert (tree["feature"][node] >= 0) == (f is not None)
            if f is None:
                continue
            assert (tree["feature"][node], tree["threshold"][node]) == (f, t)
            members[2 * node] = [i for i in idx if rows[i][1 + f] <= t]
            members[2 * node + 1] = [i for i in idx if rows[i][1 + f] > t]
        for node, idx in members.items():
            weight = -0.3 * sum(g[i] for i in idx) / (sum(h[i] for i in idx) + 1)
            assert tree["value"][node] == pytest.approx(weight, abs=1e-9)
            if tree["feature"][node] < 0:
                for i in idx:
                    margin[i] += weight
    scored = {r.id: r.m for r in df.select("id", model.margin().alias("m")).collect()}
    assert [scored[r[0]] for r in rows] == pytest.approx(margin, abs=1e-9)


def test_loss_falls_and_columns_are_drawn_per_tree(spark, table):
    model = boosting.train_boosted(table, FEATURES, "y", "id", rounds=14, depth=3, step=0.2, column_share=0.7)
    used = [{f for f in t["feature"] if f >= 0} for t in model.trees]
    assert all(len(u) <= 2 for u in used) and len({tuple(sorted(u)) for u in used}) > 1
    held_out = spark.createDataFrame(rows_of(700, 9), SCHEMA)
    losses = [r.loss for r in boosting.log_loss(held_out, model, "y", [0, 4, 14]).collect()]
    assert losses[0] == pytest.approx(math.log(2)) and losses[0] > losses[1] > losses[2]
    auc = evaluation.roc_auc(held_out.withColumn("p", model.probability()), "y", "p").first().auc
    assert auc > 0.85
    again = boosting.train_boosted(table.repartition(5), FEATURES, "y", "id", rounds=3, depth=3, step=0.2, column_share=0.7)
    assert [t["feature"] for t in again.trees] == [t["feature"] for t in model.trees[:3]]


def test_boosted_trees_are_explained(spark, table):
    model = boosting.train_boosted(table, FEATURES, "y", "id", rounds=3, depth=3)
    x = F.array(*FEATURES)
    rows = table.limit(50).select(F.struct(model.margin().alias("m")).alias("row"), x.alias("x"), F.lit(0).alias("pick"))
    found = shapley.shapley_values(rows, model.nodes(spark), 3)
    total = F.aggregate("sums", F.col("base"), lambda a, b: a + b)
    assert found.select(F.max(F.abs(total - F.col("row.m")))).first()[0] < 1e-9


def test_odd_tables(spark, table):
    empty = boosting.train_boosted(table.limit(0), FEATURES, "y", "id", rounds=2, depth=2)
    assert table.select(F.max(empty.margin())).first()[0] == 0.0
    rows = [(i, None if i % 3 else 1.0, float("nan") if i % 2 else 2.0, 5.0, None if i == 7 else int(i % 2)) for i in range(80)]
    odd = spark.createDataFrame(rows, SCHEMA)
    model = boosting.train_boosted(odd, FEATURES, "y", "id", rounds=2, depth=2, row_share=1.0, column_share=1.0)
    means = {r[0]: r[1] for r in odd.filter("y IS NOT NULL").groupBy("y").agg(F.avg(model.probability())).collect()}
    # NaN goes above the known value, which tells both classes apart
    assert means[0] < 0.5 < means[1]


def auc_brute(rows):
    pos, neg = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    if not pos or not neg:
        return None
    return sum((a > b) + (a == b) / 2 for a, b in itertools.product(pos, neg)) / (len(pos) * len(neg))


@pytest.mark.parametrize("small", [None, 5])
def test_roc_auc(monkeypatch, spark, small):
    if small:
        whole = evaluation.prefix_sum
        monkeypatch.setattr(evaluation, "prefix_sum", lambda *a, **k: whole(*a, **k, small=small))
    rng = np.random.default_rng(4)
    rows = [(f"g{i % 4}", float(rng.integers(0, 9)), int(rng.random() < 0.4)) for i in range(400)] + [("hot", 3.0, i % 2) for i in range(300)]
    rows += [("one", 1.0, 1), ("g1", None, 1), ("g1", 2.0, None), (None, 2.0, 1)]
    df = spark.createDataFrame(rows, "g STRING, s DOUBLE, y INT")
    known = [r for r in rows if None not in r]
    expected = {g: auc_brute([(s, y) for h, s, y in known if h == g]) for g in {r[0] for r in known}}
    found = {r.g: r for r in evaluation.roc_auc(df, "y", "s", ["g"]).collect()}
    assert {g: r.auc for g, r in found.items()} == {g: None if v is None else pytest.approx(v) for g, v in expected.items()}
    assert found["hot"].auc == 0.5 and (found["one"].positives, found["one"].negatives) == (1, 0)
    assert evaluation.roc_auc(df, "y", "s").first().auc == pytest.approx(auc_brute([(s, y) for _, s, y in rows if s is not None and y is not None]))
    none = evaluation.roc_auc(df.limit(0), "y", "s").collect()
    assert [tuple(r) for r in none] == [(0, 0, None)] and evaluation.roc_auc(df.limit(0), "y", "s", ["g"]).count() == 0
