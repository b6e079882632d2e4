"""First and last ids without a sort of all rows."""

from pyspark.sql import functions as F

from apronflow.catalog import metrics
from apronflow.operators import expand


def test_first_and_last_ids_are_those_of_the_texts(spark):
    numbers = [1, 10, 100, 99_999, 100_000, 100_001, 1_000_000, 9_999_999, 10_000_000, 10**16, 99_999_999_999_999_999]
    ids = [(g, f"P{n:05d}") for g, part in enumerate((numbers, numbers[4:], numbers[2:5], numbers[4:7])) for n in part]
    df = spark.createDataFrame(ids + [(9, None)], "g INT, id STRING").groupBy("g")
    got = df.agg(expand.first_id("id", "P").alias("a"), expand.last_id("id", "P").alias("b"))
    assert sorted(got.collect()) == sorted(df.agg(F.min("id").alias("a"), F.max("id").alias("b")).collect())


def test_bags_are_not_sorted(spark, folder):
    for query in (metrics.expand_baggage, metrics.expand_passengers):
        plan = query(spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan
