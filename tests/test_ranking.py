"""Two-phase ranking against brute force, with dominant groups and copies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from apronflow.models.training import stratified_split
from apronflow.operators.expand import expand_baggage, expand_passengers, number_passengers
from apronflow.operators.prepare import dedupe_first, impute_median
from apronflow.operators.quantiles import exact_quantiles, sketched_quantiles
from apronflow.operators.ranking import id_digest, number_rows, prefix_sum, smallest_share


@pytest.fixture(scope="module")
def skewed(spark):
    """2,000 rows: one key holds over a third of them, one value a third of that key."""
    rng = random.Random(7)
    rows = []
    for i in range(2000):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(5)}"
        value = 5.0 if key == "hot" and rng.random() < 0.33 else round(rng.uniform(0, 90), 2)
        rows.append((i, key, value))
    return spark.createDataFrame(rows, "id INT, key STRING, value DOUBLE").repartition(7), rows


# small = 0 forces the sliced path
@pytest.mark.parametrize("small", [0, 10**6])
def test_prefix_sum(skewed, small):
    df, rows = skewed
    weighted = df.withColumn("w", F.col("id") % 4)
    sums = prefix_sum(weighted, ["value", "id"], "w", ["key"], small=small)
    got = {r.id: r.before for r in sums.collect()}
    expected, running = {}, {}
    for i, key, value in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        expected[i] = running.get(key, 0)
        running[key] = expected[i] + i % 4
    assert got == expected


@pytest.mark.parametrize("small", [0, 10**6])
def test_number_rows_is_consecutive(skewed, small):
    df, rows = skewed
    got = [(r.n, r.id) for r in number_rows(df, ["value", "id"], "n", small=small).collect()]
    assert sorted(got) == [(n + 1, r[0]) for n, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))]


@pytest.mark.parametrize("small", [0, 10**6])
def test_exact_quantiles(skewed, small):
    df, rows = skewed
    quantiles = exact_quantiles(df, "value", {"a": 0.25, "b": 0.5, "c": 0.9}, ["key"], small)
    got = {r.key: r for r in quantiles.collect()}
    for key in {r[1] for r in rows}:
        values = [r[2] for r in rows if r[1] == key]
        for name, p in (("a", 0.25), ("b", 0.5), ("c", 0.9)):
            assert got[key][name] == pytest.approx(np.quantile(values, p))


def test_quantiles_without_groups(skewed):
    df, rows = skewed
    row = exact_quantiles(df, "value", {"low": 0.0, "mid": 0.5, "high": 1.0}).first()
    values = [r[2] for r in rows]
    assert (row.low, row.high) == (min(values), max(values))
    assert row.mid == pytest.approx(np.median(values))


def test_sketch_is_close(skewed):
    df, rows = skewed
    row = sketched_quantiles(df, "value", {"mid": 0.5}).first()
    assert row.mid == pytest.approx(np.median([r[2] for r in rows]), abs=1)


def test_impute_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (None,)], "length DOUBLE")
    assert sorted(r[0] for r in impute_median(df, "length").collect()) == [1.0, 2.0, 2.0, 10.0]
    assert impute_median(df.select(F.lit(1).alias("x")), "length").first().length == 120.0


def test_stratified_split_is_exact_per_class(skewed):
    df, rows = skewed
    marked = stratified_split(df, "key", "id").cache()
    assert marked.count() == len(rows)
    for r in marked.groupBy("key").agg(F.sum("is_test").alias("t"), F.count("*").alias("n")).collect():
        assert r.t == round(r.n * 0.2)
    again = stratified_split(df.repartition(3), "key", "id")
    assert {(r.id, r.is_test) for r in again.collect()} == {(r.id, r.is_test) for r in marked.collect()}


@pytest.mark.parametrize("small", [0, 3, 10**6])
def test_smallest_share_at_every_depth(skewed, small):
    df, rows = skewed
    hashed = df.withColumn("h", id_digest("id")).cache()
    values = {}
    for r in hashed.collect():
        values.setdefault(r.key, []).append(r.h)
    cuts = {r.key: r.cutoff for r in smallest_share(hashed, "key", "h", 0.2, small).collect()}
    assert cuts == {k: sorted(v)[round(len(v) * 0.2) - 1] for k, v in values.items()}


def test_split_keeps_copies_together(spark):
    df = spark.createDataFrame([("same", "a")] * 50 + [(f"id{i}", "a") for i in range(50)], "id STRING, label STRING")
    sides = stratified_split(df, "label", "id").filter("id = 'same'").select("is_test").distinct().count()
    assert sides == 1


def test_dedupe_first(spark):
    rows = [(1, "b", 9), (1, "a", 7), (2, "z", 1)] + [(3, "h", i) for i in range(500)]
    df = spark.createDataFrame(rows, "k INT, name STRING, n INT")
    got = {(r.k, r.name, r.n) for r in dedupe_first(df, ["k"], ["name", "n"]).collect()}
    assert got == {(1, "a", 7), (2, "z", 1), (3, "h", 0)}
    assert dedupe_first(df, ["k"], ["n"]).columns == df.columns


def test_dedupe_on_all_columns(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k INT")
    assert sorted(r.k for r in dedupe_first(df, ["k"], ["k"]).collect()) == [1, 2]


def test_expand_passengers(spark):
    rows = [("2024-01-01 10:00", "T1", "G1", 3), ("2024-01-01 09:00", "T2", "G2", 2), ("2024-01-01 11:00", "T1", None, 1),
            ("2024-01-01 12:00", "T1", "G1", 0), ("2024-01-01 10:00", "T1", "G1", 2)]
    flow = spark.createDataFrame(rows, "timestamp STRING, terminal STRING, gate STRING, passenger_count INT")
    people = expand_passengers(flow).orderBy("passenger_id").collect()
    assert [p.passenger_id for p in people] == [f"P{i:05d}" for i in range(1, 9)]
    assert [p.gate for p in people] == ["G2"] * 2 + ["G1"] * 5 + [None]
    bags = expand_baggage(expand_passengers(flow)).collect()
    assert {b.baggage_id[1:] for b in bags} == {p.passenger_id[1:] for p in people}
    assert {b.status for b in bags} <= {"delivered", "delayed", "lost"}


def test_large_counts_are_cut_into_runs(spark):
    flow = spark.createDataFrame([("t", "T1", "G1", 25)], "timestamp STRING, terminal STRING, gate STRING, passenger_count INT")
    runs = sorted(tuple(r) for r in number_passengers(flow, chunk=10).select("first", "last").collect())
    assert runs == [(1, 10), (11, 20), (21, 25)]
