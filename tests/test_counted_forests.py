"""Forests on counted rows: the same law as MLlib's on all rows, whatever the partitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from apronflow.models import features, forests, training

SETTINGS = {"trees": 12, "depth": 6, "seed": 7}
GROWTH = forests.Growth([[0.5, 1.5, 2.5], [0.5], [], [0.5, 1.5]], np.array([1.0, 2.5, 0.5]), 2, 6, 3, 0.0, 0.0, 11)


def risk_rows(spark, n, partitions=4):
    """Rows whose label follows from hour, weather and length, with noise."""
    h = F.pmod(F.xxhash64("id"), F.lit(1000))
    df = spark.range(0, n, 1, partitions).select(
        "id", (F.col("id") % 5).cast("int").alias("airline_code"), (F.col("id") % 3).cast("int").alias("terminal_code"),
        (F.floor(F.col("id") / 3) % 4).cast("int").alias("weather_code"), (F.floor(F.col("id") / 7) % 24).cast("int").alias("hour"),
        (F.floor(F.col("id") / 11) % 7).cast("int").alias("dow"), (45.0 + F.col("id") % 61).alias("flight_length"), h.alias("h"))
    df = df.withColumns({"is_peak": F.col("hour").isin(7, 8, 17, 18).cast("int"), "is_night": (F.col("hour") < 6).cast("int"), "is_weekend": (F.col("dow") > 4).cast("int")})
    risk = 30 * F.col("weather_code") + 2 * F.col("hour") + F.col("flight_length") / 4 + F.col("h") / 20
    return df.withColumn("risk_label", F.when(risk < 70, "LOW").when(risk < 115, "MEDIUM").otherwise("HIGH"))


def nodes(model):
    # the first line names the tree
    return [t.toDebugString.split("\n", 1)[1] for t in model.stages[-1].trees]


def table(n=4000, seed=3):
    """Counted rows over four binned features, three classes."""
    rng = np.random.default_rng(seed)
    codes = np.column_stack([rng.integers(0, w, n) for w in (4, 2, 1, 3)]).astype(np.int16)
    label = (codes[:, 0] + codes[:, 3] + rng.integers(0, 2, n)) % 3
    cells, counts = np.unique(np.column_stack([codes, label]), axis=0, return_counts=True)
    return cells[:, :4].astype(np.int16), cells[:, 4].astype(np.int64), counts


def test_a_forest_does_not_depend_on_partitions_or_order(spark):
    df = risk_rows(spark, 3000)
    one = training.train_risk_classifier(df.coalesce(1), **SETTINGS)
    other = training.train_risk_classifier(df.repartition(7, "hour").orderBy(F.desc("id")), **SETTINGS)
    assert nodes(one) == nodes(other)


def test_the_learner_passes_over_counted_rows(spark, monkeypatch):
    seen = []
    plain = forests.train_forest
    monkeypatch.setattr(forests, "train_forest", lambda df, *a: seen.append((df.count(), df.agg(F.sum("n")).first()[0])) or plain(df, *a))
    df = risk_rows(spark, 500)
    copies = df.crossJoin(spark.range(40).withColumnRenamed("id", "copy"))
    training.train_risk_classifier(copies, trees=2, depth=3)
    assert seen == [(df.select(*features.RISK_FEATURES, "risk_label").distinct().count(), 20_000)]


def test_figures_agree_with_a_forest_on_all_rows(spark):
    df = risk_rows(spark, 6000)
    train, test = df.filter("id % 4 > 0"), df.filter("id % 4 = 0")
    counted = training.train_risk_classifier(train, trees=40, depth=8)
    whole = training.risk_pipeline(trees=40, depth=8).fit(training.balanced_weights(train))
    a, b = (training.accuracy(m.transform(test), "label") for m in (counted, whole))
    assert a == pytest.approx(b, abs=0.03) and a > 0.6
    x, y = (m.stages[-1].featureImportances.toArray() for m in (counted, whole))
    assert x == pytest.approx(y, abs=0.05)
    sizes = [m.stages[-1].totalNumNodes for m in (counted, whole)]
    assert sizes[0] == pytest.approx(sizes[1], rel=0.1)
    assert (counted.stages[-1].getNumTrees, counted.stages[0].labels) == (40, whole.stages[0].labels)


def test_cross_validation_counts_every_row(spark):
    df = risk_rows(spark, 3000)
    once = training.cross_validate_f1(df, "id", folds=2, trees=5, depth=5)
    assert once == training.cross_validate_f1(df.repartition(5), "id", folds=2, trees=5, depth=5)
    assert once[0] > 0.5


def test_best_splits_are_those_of_plain_loops():
    rng = np.random.default_rng(5)
    sums = rng.integers(0, 6, (30, 2, 5, 3)).astype(float)
    sums[:, 1] *= sums[:, :1].sum(axis=(2, 3))[:, 0, None, None] / sums[:, 1].sum(axis=(1, 2))[:, None, None]
    gain, which, cut = forests.best_splits(sums, GROWTH, 0.0)
    gini = lambda s: 1 - sum((x / sum(s)) ** 2 for x in s)
    for node, g, f, c in zip(sums, gain, which, cut):
        found = {}
        for i in range(2):
            for j in range(4):
                low, high = node[i, : j + 1].sum(axis=0), node[i, j + 1 :].sum(axis=0)
                if min(low.sum(), high.sum()) >= GROWTH.min_rows:
                    a, b = low * GROWTH.weights, high * GROWTH.weights
                    found[i, j] = gini(a + b) - (sum(a) * gini(a) + sum(b) * gini(b)) / sum(a + b)
        assert g == pytest.approx(max(found.values())) and found[f, c] == pytest.approx(g)


def test_nodes_hold_the_draws_of_the_rows_that_reach_them():
    codes, label, n = table()
    levels = forests.grow([(codes, label, n)], GROWTH, 4)
    draws = np.random.default_rng([GROWTH.seed, 4]).poisson(n)
    at = np.zeros(len(n), int)
    assert len(levels) > 3
    for x, following in zip(levels, [*levels[1:], None]):
        for node in range(len(x["feature"])):
            inside = at == node
            assert x["counts"][node].tolist() == np.bincount(label[inside], draws[inside], 3).tolist()
            assert x["counts"][node].sum() >= GROWTH.min_rows
        if following is not None:
            first = 2 * (np.cumsum(x["feature"] >= 0) - 1)
            feature = x["feature"][at]
            at = np.where((at < 0) | (feature < 0), -1, first[at] + (codes[np.arange(len(n)), feature] > x["cut"][at]))
    assert set(levels[-1]["feature"]) == {-1}


def test_blocks_of_rows_and_nodes_give_the_same_tree(spark, tmp_path, monkeypatch):
    codes, label, n = table()
    df = spark.createDataFrame([(*map(int, c), int(y), int(k)) for c, y, k in zip(codes, label, n)], "c0 SHORT, c1 SHORT, c2 SHORT, c3 SHORT, y SHORT, n LONG")
    path = str(tmp_path / "bins")
    df.orderBy("c0", "c1", "c2", "c3", "y").write.parquet(path)
    whole = forests.grow(forests._Rows(path), GROWTH, 2)
    for name, value in (("BLOCK_ROWS", 7), ("KEPT_ROWS", 0), ("BLOCK_NODES", 2)):
        monkeypatch.setattr(forests, name, value)
    parts = forests.grow(forests._Rows(path), GROWTH, 2)
    assert len(whole) == len(parts) > 3
    for a, b in zip(whole, parts):
        assert all(np.array_equal(a[c], b[c]) for c in ("counts", "feature", "cut"))


def test_sibling_leaves_of_equal_prediction_are_one_leaf():
    codes, label, n = table()
    levels = forests.merged(forests.grow([(codes, label, n)], GROWTH, 1), GROWTH.weights)
    for x, following in zip(levels, levels[1:]):
        leaf, says = following["feature"].reshape(-1, 2) < 0, following["guess"].reshape(-1, 2)
        assert len(leaf) == (x["feature"] >= 0).sum()
        assert not (leaf.all(axis=1) & (says[:, 0] == says[:, 1])).any()


def test_split_points_of_few_and_of_many_values(spark):
    rows = [([float(i % 3), float(i), 5.0], 1 if i < 500 else 3) for i in range(1000)]
    df = spark.createDataFrame(rows, "x ARRAY<DOUBLE>, n INT")
    few, many, constant = forests.split_points(df, F.col("x"), F.col("n"), 3, 8)
    assert few == [0.5, 1.5] and constant == []
    # equal shares of the weight: 2000 rows in all, 250 to a bin
    assert many == [249.5, 499.5, *[pytest.approx(499.5 + 250 / 3 * i, abs=1) for i in range(1, 6)]]
    assert all(math.isclose(e % 1, 0.5) for e in many)


def test_unsuitable_forests_are_refused(spark):
    df = risk_rows(spark, 100)
    with pytest.raises(ValueError, match="needs rows"):
        training.train_risk_classifier(df.limit(0), trees=2)
    rows = forests.counted(df.withColumn("weight", 1.0 + F.col("id") % 2), [*features.RISK_FEATURES, "risk_label", "weight"])
    with pytest.raises(ValueError, match="one weight"):
        forests.fit(training.risk_pipeline(trees=2), rows)
