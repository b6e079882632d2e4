"""Large training tables are spread over bounded tasks."""

from pyspark.sql import functions as F

from apronflow.models import training


def test_training_rows_are_spread_by_their_number(spark, monkeypatch):
    df = spark.range(3_000).withColumn("y", F.lit(1.0))
    cores = spark.sparkContext.defaultParallelism
    assert training.training_table(df, ["id", "y"]).rdd.getNumPartitions() == cores
    monkeypatch.setattr(training, "ROWS_PER_TASK", 100)
    table = training.training_table(df, ["id", "y"])
    assert table.rdd.getNumPartitions() == 30 and table.distinct().count() == 3_000


def test_forest_passes_keep_the_nodes_of_rows(spark):
    assert training.risk_pipeline().getStages()[-1].getCacheNodeIds()
