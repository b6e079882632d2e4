"""Exact Shapley values: additivity, brute-force subsets, parts of a forest, odd rows."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from apronflow.models import shapley

FEATURES = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    rows = [(i, *(float(rng.randrange(6)) for _ in FEATURES)) for i in range(600)]
    rows = [(*r, r[1] * r[2] + 3 * (r[3] > 2) + rng.random(), int((r[1] * r[2] + 2 * r[4]) // 9)) for r in rows]
    return spark.createDataFrame(rows, "id INT, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, e DOUBLE, y DOUBLE, label INT").repartition(3).cache()


def fitted(table, learner):
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), learner]).fit(table)


@pytest.fixture(scope="module")
def regressor(table):
    return fitted(table, RandomForestRegressor(labelCol="y", numTrees=6, maxDepth=7, seed=1))


@pytest.fixture(scope="module")
def classifier(table):
    return fitted(table, RandomForestClassifier(labelCol="label", numTrees=6, maxDepth=6, seed=1))


def brute(nodes, x, known, pick, at):
    """Expected output with the known features only, following both sides of a split of another one."""
    n = nodes[at]
    if n.below < 0:
        return n.value[pick]
    below, above = (n.tree, n.below), (n.tree, n.above)
    if n.feature in known:
        return brute(nodes, x, known, pick, below if x[n.feature] <= n.threshold else above)
    return sum(nodes[c].cover / n.cover * brute(nodes, x, known, pick, c) for c in (below, above))


def brute_values(nodes, x, pick):
    m, trees = len(x), sorted({t for t, _ in nodes})
    output = lambda known: sum(brute(nodes, x, known, pick, (t, 0)) for t in trees)
    found = {s: output(set(s)) for k in range(m + 1) for s in itertools.combinations(range(m), k)}
    values = []
    for j in range(m):
        rest = [i for i in range(m) if i != j]
        values.append(sum(
            math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) * (found[tuple(sorted((*s, j)))] - found[s])
            for k in range(m) for s in itertools.combinations(rest, k)))
    return found[()], values


@pytest.mark.parametrize("kind", ["regressor", "classifier"])
def test_equal_to_brute_force_subsets(request, table, kind):
    model = request.getfixturevalue(kind)
    nodes = {(r.tree, r.node): r for r in shapley.forest_nodes(model.stages[-1]).collect()}
    guess = {r.id: int(r.prediction) for r in model.transform(table).select("id", "prediction").collect()}
    for r in shapley.explain(table.filter("id < 12"), model, FEATURES).collect():
        pick = guess[r.id] if kind == "classifier" else 0
        base, values = brute_values(nodes, [r[f] for f in FEATURES], pick)
        assert r.base == pytest.approx(base, abs=1e-9) and r.contributions == pytest.approx(values, abs=1e-9)
        sizes = [abs(f.impact) for f in r.factors]
        assert sizes == sorted(sizes, reverse=True) and len(sizes) == 5


def total(explained):
    return F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda a, b: a + b)


def test_contributions_add_up(table, regressor, classifier):
    scored = regressor.transform(table).drop("features")
    gap = shapley.explain(scored, regressor, FEATURES)
    assert gap.columns == [*scored.columns, "base", "contributions", "factors"]
    assert gap.select(F.max(F.abs(total(gap) - F.col("prediction")))).first()[0] < 1e-9
    scored = classifier.transform(table).select("*", F.array_max(vector_to_array("probability")).alias("best")).drop("features", "probability", "rawPrediction")
    gap = shapley.explain(scored, classifier, FEATURES)
    assert gap.select(F.max(F.abs(total(gap) - F.col("best")))).first()[0] < 1e-9 and gap.count() == 600


def test_boosted_trees_add_up_to_the_margin(table):
    binary = table.withColumn("label", (F.col("label") > 0).cast("int"))
    model = fitted(binary, GBTClassifier(labelCol="label", maxIter=4, maxDepth=3, seed=1))
    scored = model.transform(binary).select("*", vector_to_array("probability")[1].alias("p")).drop("features", "probability", "rawPrediction")
    gap = shapley.explain(scored, model, FEATURES)
    assert gap.select(F.max(F.abs(1 / (1 + F.exp(-2 * total(gap))) - F.col("p")))).first()[0] < 1e-9


def test_parts_add_up_to_the_whole(table, regressor):
    some = table.filter("id < 40").select("id", *FEATURES)
    read = lambda **x: {r.id: (r.base, *r.contributions) for r in shapley.explain(some, regressor, FEATURES, **x).collect()}
    whole = read()
    largest = max(r["count"] for r in shapley.forest_nodes(regressor.stages[-1]).groupBy("tree").count().collect())
    parts = read(part_bytes=int(1.5 * largest * (24 * 5 + 64)))
    assert set(whole) == set(parts) and all(whole[i] == pytest.approx(parts[i], abs=1e-9) for i in whole)
    with pytest.raises(ValueError, match="bytes"):
        read(part_bytes=100)


def test_odd_rows(table, regressor):
    none = shapley.explain(table.limit(0), regressor, FEATURES)
    assert none.count() == 0
    odd = table.filter("id < 3").withColumns({"a": F.lit(None).cast("double"), "b": F.lit(float("nan"))})
    large = table.filter("id < 3").withColumns({"a": F.lit(1e300), "b": F.lit(1e300)})
    values = [sorted(tuple(r.contributions) for r in shapley.explain(t, regressor, FEATURES).collect()) for t in (odd, large)]
    assert np.allclose(*values)


def test_unused_feature_gets_nothing(table):
    flat = table.withColumn("e", F.lit(1.0))
    model = fitted(flat, RandomForestRegressor(labelCol="y", numTrees=3, maxDepth=5, seed=2))
    assert {r.contributions[4] for r in shapley.explain(flat, model, FEATURES).collect()} == {0.0}


def test_categories_are_refused(table):
    stages = [VectorAssembler(inputCols=FEATURES, outputCol="plain"), VectorIndexer(inputCol="plain", outputCol="features", maxCategories=10)]
    model = Pipeline(stages=[*stages, RandomForestRegressor(labelCol="y", numTrees=2, maxDepth=3, seed=1)]).fit(table)
    with pytest.raises(ValueError, match="category"):
        shapley.forest_nodes(model.stages[-1])
