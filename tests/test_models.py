"""Models: invariants, scoring defaults, attribution and persistence."""

import datetime as dt

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from apronflow.catalog import views
from apronflow.functions.risk import is_delayed
from apronflow.models import evaluation, features, scoring, store, training


@pytest.fixture(scope="module")
def table(spark, folder):
    flights = views.flights(spark, folder)
    return features.delay_features(flights).withColumn("is_delayed", is_delayed("delay_minutes")).cache()


@pytest.fixture(scope="module")
def delay_model(table):
    return training.train_delay_regressor(table, trees=10, depth=5)


@pytest.fixture(scope="module")
def risk_table(spark, folder):
    f = views.flights(spark, folder).withColumn("day_of_week", F.weekday("departure_time"))
    # the gate drives the delay, so it is made visible to the model as the flight length
    f = f.withColumn("length", F.col("gate_no") * 60.0)
    return features.risk_features(f).dropna(subset=["risk_label"]).cache()


@pytest.fixture(scope="module")
def risk_model(risk_table):
    return training.train_risk_classifier(risk_table, trees=20, depth=6)


def test_delay_predictions_are_within_labels(table, delay_model):
    low, high = table.agg(F.min("delay_minutes"), F.max("delay_minutes")).first()
    scored = scoring.score_delay(table, delay_model)
    row = scored.agg(F.min("predicted_delay"), F.max("predicted_delay"), F.max("delay_probability")).first()
    assert 0 <= low <= row[0] and row[1] <= high and row[2] <= 100
    assert scored.select("model_used").first()[0] == "random_forest"


def test_default_scores_without_model(table):
    row = scoring.score_delay(table).select("predicted_delay", "risk_level", "model_used").first()
    assert tuple(row) == (20.0, "MEDIUM", "statistical")
    row = scoring.score_percent(table).first()
    assert (row.predicted_delay_percent, row.delay_risk) == (50.0, "MEDIUM")


def test_classifier_probabilities(table):
    model = training.train_delay_classifier(table, trees=10, depth=5)
    p = vector_to_array("probability")
    worst = model.transform(table).select(F.max(F.abs(p[0] + p[1] - 1))).first()[0]
    assert worst < 1e-9
    scored = scoring.score_delay(table, None, model)
    assert scored.select(F.max("delay_probability")).first()[0] <= 100
    percent = scoring.score_percent(table, model)
    assert percent.columns == ["flight_id", "airline", "gate", "predicted_delay_percent", "delay_risk"]
    assert 0 <= training.area_under_roc(model.transform(table)) <= 1


def test_risk_scores(risk_table, risk_model):
    scored = scoring.score_risk(risk_table, risk_model)
    row = scored.agg(F.min("risk_score"), F.max("risk_score")).first()
    assert 20 <= row[0] and row[1] <= 90
    assert {r[0] for r in scored.select("risk_level").distinct().collect()} <= {"LOW", "MEDIUM", "HIGH"}
    report = {r["class"]: r for r in evaluation.classification_report(scored, "risk_label", "risk_level").collect()}
    assert report["accuracy"].f1 > 0.5 and report["macro avg"].support == risk_table.count()


def test_balanced_weights_sum_to_rows(risk_table):
    weighted = training.balanced_weights(risk_table)
    sums = [r[0] for r in weighted.groupBy("risk_label").agg(F.sum("weight")).select("sum(weight)").collect()]
    assert sums == pytest.approx([risk_table.count() / 3] * 3)


def test_cross_validation(risk_table):
    mean, std = training.cross_validate_f1(risk_table, "flight_id", folds=2, trees=20, depth=6)
    # better than guessing among three classes
    assert 1 / 3 < mean <= 1 and std >= 0


def test_attribution(table, delay_model):
    means = scoring.feature_means(table, features.DELAY_FEATURES)
    explained = scoring.attribute(table.filter("seq < 50"), delay_model, features.DELAY_FEATURES, means, k=4)
    for r in explained.collect():
        sizes = [abs(f.impact) for f in r.factors]
        assert len(sizes) == 4 and sizes == sorted(sizes, reverse=True)
        assert all(f.direction in ("increases delay", "reduces delay") for f in r.factors)
    # replaced features do not leak: the table's own columns are unchanged
    assert explained.columns == [*table.columns, "factors"]


def test_attribution_of_a_constant_feature_is_zero(risk_table, risk_model):
    constant = risk_table.withColumn("dow", F.lit(3))
    means = scoring.feature_means(constant, features.RISK_FEATURES)
    explained = scoring.attribute(constant.filter("seq < 20"), risk_model, features.RISK_FEATURES, means, k=9, subject="risk")
    impacts = explained.select(F.explode("factors").alias("f")).filter("f.feature = 'dow'").select("f.impact").distinct()
    assert [r[0] for r in impacts.collect()] == [0.0]


def test_onehot_ignores_unseen_values(spark):
    rows = [("A", "T1", "Mon", "Clear", i % 2) for i in range(20)] + [("B", "T2", "Tue", "Rain", 1)] * 20
    train = spark.createDataFrame(rows, "carrier STRING, terminal STRING, day_of_week STRING, weather STRING, delayed INT")
    model = training.train_onehot_classifier(train, trees=5, depth=3)
    unseen = spark.createDataFrame([("Z", "T9", "Sun", "Fog", 0)], train.schema)
    assert model.transform(unseen).select(F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, b: a + b)).first()[0] == 0
    assert training.accuracy(model.transform(train), "delayed") >= 0.7


def test_weather_model(spark):
    df = spark.range(400).select(
        (F.col("id") % 40).cast("double").alias("temperature"), (F.col("id") % 7).cast("double").alias("wind_speed"),
        (F.col("id") % 11).cast("double").alias("rain"), F.lit(50.0).alias("humidity"), (F.col("id") % 11 > 5).cast("int").alias("is_delayed"))
    model = training.train_weather_gbt(df, rounds=5, depth=3)
    scored = scoring.score_weather(df, model)
    by = {r[0]: r[1] for r in scored.groupBy("is_delayed").avg("delay_probability").collect()}
    assert 0 <= by[0] < by[1] <= 1


def test_missing_columns_get_constants(spark):
    df = spark.createDataFrame([(0,), (1,), (5,)], "delay INT")
    rows = features.risk_features(df).collect()
    assert {(r.hour, r.dow, r.is_weekend, r.weather_code, r.terminal_code, r.airline_code, r.flight_length) for r in rows} == {(12, 3, 0, 0, 0, 0, 120.0)}
    assert sorted(str(r.risk_label) for r in rows) == ["HIGH", "LOW", "None"]
    with pytest.raises(ValueError):
        features.risk_features(df.withColumnRenamed("delay", "x"))


def test_save_and_load(spark, table, delay_model, tmp_path):
    path = str(tmp_path / "model")
    summary = evaluation.model_summary(spark, delay_model, features.DELAY_FEATURES, dt.datetime(2024, 1, 1), None, (0.51234, 0.1), 10, 2)
    dims = features.code_dims(table, ["airline"])
    store.save_model(delay_model, path, summary, dims)
    loaded = store.load_model(spark, path)
    a = delay_model.transform(table).select(F.sum("prediction")).first()[0]
    assert loaded.transform(table).select(F.sum("prediction")).first()[0] == pytest.approx(a)
    meta = store.load_metadata(spark, path).first()
    assert (meta.model_type, meta.trees, meta.cv_f1_mean) == ("RandomForestRegression", 10, 0.5123)
    assert store.load_dims(spark, path, ["airline"])["airline"].count() == 5
    importances = evaluation.feature_importances(spark, delay_model, features.DELAY_FEATURES).collect()
    assert sum(r.importance for r in importances) == pytest.approx(1)
