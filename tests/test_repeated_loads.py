"""Loads that are repeated, or fail half-way and are run again, leave each row once."""

import pytest
from pyspark.sql import functions as F

from apronflow.sources import readers, writers


def predictions(spark, ids, delay=10.0):
    rows = spark.createDataFrame([(i, delay + i) for i in ids], "id LONG, predicted_delay DOUBLE")
    return rows.withColumn("created_at", F.lit("2024-01-01 08:00:00").cast("timestamp")).repartition(3)


def stored(spark, path):
    return sorted((r.batch, r.id, r.predicted_delay) for r in spark.read.parquet(path).collect())


def test_repeated_history_loads_add_nothing(spark, tmp_path):
    path = str(tmp_path / "history")
    writers.load_history(predictions(spark, range(5)), "predictions", path, "monday")
    writers.load_history(predictions(spark, range(3)), "predictions", path, "tuesday")
    first = stored(spark, path)
    assert len(first) == 8
    writers.load_history(predictions(spark, range(5)), "predictions", path, "monday")
    assert stored(spark, path) == first
    # a corrected load replaces its own rows only
    writers.load_history(predictions(spark, range(2), 50.0), "predictions", path, "monday")
    assert stored(spark, path) == [("monday", 0, 50.0), ("monday", 1, 51.0), *[r for r in first if r[0] == "tuesday"]]
    writers.load_history(predictions(spark, []), "predictions", path, "monday")
    assert len(stored(spark, path)) == 5
    assert readers.read_history(spark, "predictions", path).count() == 5


def test_a_load_that_failed_is_run_again(spark, tmp_path):
    path = str(tmp_path / "history")
    writers.load_history(predictions(spark, range(4)), "predictions", path, "monday")
    before = stored(spark, path)
    # the tasks of some rows succeed, that of one row fails
    broken = predictions(spark, range(30), 70.0).withColumn("created_at", F.when(F.col("id") != 17, F.col("created_at")))
    for batch in ("monday", "tuesday"):
        with pytest.raises(Exception, match="created_at is required"):
            writers.load_history(broken, "predictions", path, batch)
        assert stored(spark, path) == before
    writers.load_history(predictions(spark, range(30), 70.0), "predictions", path, "tuesday")
    assert stored(spark, path) == before + [("tuesday", i, 70.0 + i) for i in range(30)]


def test_facts_replace_their_dates(spark, tmp_path):
    path = str(tmp_path / "facts")
    day = lambda d, ids: spark.createDataFrame([(i, d) for i in ids], "id INT, d STRING").select("id", F.col("d").cast("date").alias("date"))
    read = lambda: sorted((str(r.date), r.id) for r in spark.read.parquet(path).collect())
    writers.load_facts(day("2024-01-01", [1, 2]).union(day("2024-01-02", [3])), path)
    writers.load_facts(day("2024-01-02", [3, 4]).union(day(None, [9])), path)
    assert read() == [("2024-01-01", 1), ("2024-01-01", 2), ("2024-01-02", 3), ("2024-01-02", 4), ("None", 9)]
    writers.load_facts(day("2024-01-02", [3, 4]).union(day(None, [9])), path)
    assert len(read()) == 5
