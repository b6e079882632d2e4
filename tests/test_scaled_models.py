"""Models are applied once per feature vector."""

from pyspark.sql import functions as F

from apronflow.models import scoring, training


def test_a_model_is_applied_once_per_vector(spark):
    rows = [(i, None if i % 4 == 0 else i % 4, float("nan") if i % 3 == 0 else 0.5, "old") for i in range(600)]
    df = spark.createDataFrame(rows, "id INT, a INT, b DOUBLE, found STRING")
    seen = []

    def compute(vectors):
        seen.append(vectors.count())
        return vectors.select("a", "b", F.concat_ws("/", "a", "b").alias("found"))

    got = scoring.per_vector(df, ["a", "b"], compute)
    assert seen == [8] and got.columns == df.columns
    want = {r.id: r.found for r in df.withColumn("found", F.concat_ws("/", "a", "b")).collect()}
    assert got.count() == 600 and {r.id: r.found for r in got.collect()} == want


def test_predictions_per_vector_are_the_models(spark):
    df = spark.range(400).select(
        "id", (F.col("id") % 5).alias("airline_code"), (F.col("id") % 3).alias("weather_code"), F.lit(1).alias("terminal_code"),
        (F.col("id") % 24).alias("departure_hour"), F.lit(0).alias("is_peak_hour"), F.lit(0).alias("is_weekend"),
        (F.col("id") % 7 * 1.5).alias("delay_minutes"),
    )
    model = training.train_delay_regressor(df, trees=5, depth=4)
    assert scoring.input_columns(model) == training.DELAY_FEATURES
    want = {r.id: r.prediction for r in model.transform(df).collect()}
    assert {r.id: r.prediction for r in scoring.predicted(df, model).collect()} == want
