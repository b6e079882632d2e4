"""As-of joins by brute force, dimension keys over repeated loads, stored quantile sketches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from apronflow.operators import dimensions, gates, quantiles
from apronflow.operators.asof import asof_join
from apronflow.sources import writers


def nearest(row, rows, forward, strict):
    by, on = row[1], row[2:4]
    if by is None or None in on:
        return None
    good = [r for r in rows if r[0] == by and None not in r[1:3]]
    good = [r for r in good if (r[1:3] > on if forward else r[1:3] < on) or (not strict and r[1:3] == on)]
    if not good:
        return None
    at = (min if forward else max)(r[1:3] for r in good)
    return (*at, max(r[3] for r in good if r[1:3] == at))


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_against_brute_force(spark, forward, strict):
    rng = random.Random(5)
    key = lambda: rng.choice(["hot", "hot", "a", "b", None])
    number = lambda: rng.choice([None, *range(12)])
    left = [(i, key(), number(), rng.randrange(3)) for i in range(300)]
    left += [(1000 + i, "hot", 5, 1) for i in range(200)]
    right = [(key(), number(), rng.randrange(3), rng.randrange(100)) for _ in range(120)]
    lefts = spark.createDataFrame(left, "id INT, k STRING, a INT, _slice INT").repartition(4)
    rights = spark.createDataFrame(right, "k STRING, a INT, _slice INT, v INT").repartition(3)
    found = asof_join(lefts, rights, ["k"], ["a", "_slice"], ["v"], "hit", forward, strict, slices=7)
    assert found.columns == ["id", "k", "a", "_slice", "hit"]
    got = {r.id: tuple(r.hit) if r.hit else None for r in found.collect()}
    assert got == {r[0]: nearest(r, right, forward, strict) for r in left}
    assert asof_join(lefts, rights.limit(0), ["k"], ["a"], ["v"], "hit").filter("hit IS NULL").count() == len(left)
    assert asof_join(lefts.limit(0), rights, ["k"], ["a"], ["v"], "hit").count() == 0


def test_asof_cuts_a_hot_key(spark):
    left = spark.range(20_000).select("id", F.lit("hot").alias("k"), F.lit(7).alias("a"))
    right = spark.createDataFrame([("hot", 3, 1), ("hot", 9, 2)], "k STRING, a INT, v INT")
    found = asof_join(left, right, ["k"], ["a"], ["v"], "hit")
    assert found.filter("hit.v = 1").count() == 20_000
    shares = left.join(found, "id").count()
    assert shares == 20_000


def test_nearest_conflicts_against_neighbours(spark):
    rng = random.Random(9)
    start = dt.datetime(2024, 1, 1)
    rows = [(f"F{i}", rng.choice(["G1", "G1", "G2", None]), start + dt.timedelta(minutes=rng.randrange(900))) for i in range(150)]
    rows += [("same", "G3", start), ("twin", "G3", start), ("alone", "G4", start), ("none", "G1", None), rows[0]]
    df = spark.createDataFrame(rows, "flight_id STRING, gate STRING, departure_time TIMESTAMP")
    got = {r.flight_id: r for r in gates.nearest_conflicts(df, slices=5).collect()}
    expected = {}
    for gate in ("G1", "G2", "G3", "G4"):
        line = sorted({(t, f) for f, g, t in rows if g == gate and t})
        for i, (t, f) in enumerate(line):
            sides = []
            for j in (i - 1, i + 1):
                near = line[j] if 0 <= j < len(line) and abs((line[j][0] - t).total_seconds()) <= 1800 else None
                sides += [near[1] if near else None, abs((near[0] - t).total_seconds()) if near else None]
            if sides[0] or sides[2]:
                expected[f] = tuple(sides)
    assert {f: tuple(r)[3:] for f, r in got.items()} == expected
    assert "alone" not in got and got["same"].later_flight == "twin"
    # the same flights are in conflict as by counting
    assert set(got) == {r.flight_id for r in gates.gate_conflicts(df.filter("flight_id != 'none'")).collect()}


def values(spark, names):
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "seq INT, name STRING").repartition(3)


def stored(spark, path):
    rows = dimensions.stored_dim(spark, path, "name", StringType(), "id").collect()
    found = {r.name: r.id for r in rows}
    assert len(found) == len(rows)
    return found


def test_keys_stay_over_loads(spark, tmp_path):
    path = str(tmp_path / "dim")
    assert stored(spark, path) == {}
    first = values(spark, ["m", "z", None, "a", "m"])
    dimensions.load_dim(first, path, "name", "id", "seq")
    assert stored(spark, path) == {r.name: r.id for r in dimensions.first_appearance_dim(first, "name", "seq", "id").collect()}
    before = stored(spark, path)
    dimensions.load_dim(first, path, "name", "id", "seq")
    assert stored(spark, path) == before == {"m": 1, "z": 2, "a": 3}
    dimensions.load_dim(values(spark, ["q", "a", "b", "z"]), path, "name", "id", "seq")
    assert stored(spark, path) == before | {"q": 4, "b": 5}
    dimensions.load_dim(values(spark, []), path, "name", "id", "seq")
    assert stored(spark, path) == before | {"q": 4, "b": 5}


def test_a_failed_load_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "dim")
    rows = values(spark, ["c", "b", "a"])
    dimensions.load_dim(rows, path, "name", "id", start=0)
    codes = {r.value: r.code for r in dimensions.label_dim(rows, "name").collect()}
    assert stored(spark, path) == codes
    broken = values(spark, ["x", "y"]).withColumn("name", F.when(F.col("seq") == 1, F.raise_error(F.lit("torn")).cast("string")).otherwise(F.col("name")))
    with pytest.raises(Exception, match="torn"):
        dimensions.load_dim(broken, path, "name", "id", start=0)
    assert stored(spark, path) == codes
    dimensions.load_dim(values(spark, ["x", "y"]), path, "name", "id", start=0)
    assert stored(spark, path) == codes | {"x": 3, "y": 4}


def test_stored_sketches(spark, tmp_path):
    path = str(tmp_path / "sketches")
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 4)).alias("airline"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 30).cast("int")).alias("date"),
        F.when(F.col("id") % 11 != 0, (F.hash("id") % 5000).cast("double")).alias("delay"),
    )
    daily = quantiles.daily_sketches(rows, "delay", ["airline"])
    half = F.col("date") < F.lit("2024-01-16").cast("date")
    for part in (daily.filter(half), daily.filter(~half), daily.filter(half)):
        writers.load_facts(part, path)
    kept = spark.read.schema(daily.schema).parquet(path)
    wanted = {"q1": 0.25, "median": 0.5, "q3": 0.75, "top": 1.0, "low": 0.0}
    found = quantiles.merged_quantiles(kept, wanted, ["airline"])
    exact = {r.airline: r["n"] for r in rows.dropna().groupBy("airline").agg(F.count("delay").alias("n")).collect()}
    assert {r.airline: r.rows for r in found.collect()} == exact
    errors = quantiles.rank_errors(rows, "delay", found, wanted, ["airline"]).collect()
    assert len(errors) == len(exact) * len(wanted) and all(r.rank_error <= 0.005 for r in errors)
    # a wrong quantile is told apart
    off = found.withColumn("median", F.col("q3"))
    assert all(r.rank_error > 0.2 for r in quantiles.rank_errors(rows, "delay", off, {"median": 0.5}, ["airline"]).collect())
    one = quantiles.merged_quantiles(kept, {"median": 0.5}).collect()
    assert len(one) == 1 and one[0].rows == sum(exact.values())
    assert quantiles.merged_quantiles(kept.limit(0), wanted, ["airline"]).count() == 0
