"""Queries: features, splits, model training, scoring and reports."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from apronflow.catalog import views
from apronflow.catalog.metrics import stable
from apronflow.catalog.registry import AS_OF, query
from apronflow.catalog.views import FLIGHTS_SQL, PREDICTIONS_SQL, with_views
from apronflow.functions.risk import is_delayed, training_risk
from apronflow.models import boosting, evaluation, features, scoring, shapley, training
from apronflow.operators import quantiles

FLIGHTS = with_views(FLIGHTS_SQL)


def codes_sql(*columns: str) -> str:
    return "".join(
        f""", {c}_codes AS (SELECT {c}, CAST(row_number() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}_code
        FROM (SELECT DISTINCT {c} FROM flights))"""
        for c in columns
    )


# features and splits ---------------------------------------------------------------------


def _risk_input(spark, d):
    return views.flights(spark, d).select(
        "flight_id", "airline", "terminal", "weather", "departure_hour", "delay_minutes",
        F.weekday("departure_time").alias("day_of_week"),
        F.when(F.col("gate_no") > 1, F.col("gate_no") * 45.0).alias("length"),
    )


@query(
    FLIGHTS
    + codes_sql("airline", "terminal")
    + """, lengths AS (SELECT flight_id, CASE WHEN gate_no > 1 THEN gate_no * CAST(45 AS DOUBLE) END AS length FROM flights)
    SELECT flight_id, airline_code, terminal_code,
      CASE weather WHEN 'Cloudy' THEN 1 WHEN 'Rain' THEN 2 WHEN 'Storm' THEN 3 ELSE 0 END AS weather_code,
      departure_hour AS hour, is_peak_hour AS is_peak,
      CASE WHEN departure_hour < 6 OR departure_hour > 22 THEN 1 ELSE 0 END AS is_night, is_weekend,
      CAST(isodow(departure_time) - 1 AS INTEGER) AS dow,
      coalesce(length, (SELECT quantile_cont(length, CAST(0.5 AS DOUBLE)) FROM lengths)) AS flight_length,
      CASE WHEN delay_minutes <= 15 THEN 'LOW' WHEN delay_minutes <= 40 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_label
    FROM flights JOIN airline_codes USING (airline) JOIN terminal_codes USING (terminal) JOIN lengths USING (flight_id)"""
)
def risk_features(spark, d):
    table = features.risk_features(_risk_input(spark, d))
    return table.select("flight_id", *features.RISK_FEATURES, "risk_label")


@query(
    FLIGHTS
    + codes_sql("airline", "weather", "terminal")
    + """SELECT flight_id, airline_code, weather_code, terminal_code, departure_hour, is_peak_hour, is_weekend
    FROM flights JOIN airline_codes USING (airline) JOIN weather_codes USING (weather) JOIN terminal_codes USING (terminal)"""
)
def delay_features(spark, d):
    return features.delay_features(views.flights(spark, d)).select("flight_id", *features.DELAY_FEATURES)


@query(
    FLIGHTS
    + """, labelled AS (SELECT flight_id, CASE WHEN delay_minutes <= 15 THEN 'LOW' WHEN delay_minutes <= 40 THEN 'MEDIUM'
      ELSE 'HIGH' END AS risk_label, CAST('0x' || substr(md5(flight_id || '-42'), 1, 15) AS BIGINT) AS h FROM flights)
    SELECT flight_id, risk_label, CASE WHEN row_number() OVER (PARTITION BY risk_label ORDER BY h)
      <= round_even(count(*) OVER (PARTITION BY risk_label) * CAST(0.2 AS DOUBLE), 0) THEN 1 ELSE 0 END AS is_test FROM labelled"""
)
def stratified_split(spark, d):
    labelled = views.flights(spark, d).select("flight_id", training_risk("delay_minutes").alias("risk_label"))
    return training.stratified_split(labelled, "risk_label", "flight_id")


@query(
    FLIGHTS
    + """SELECT CASE WHEN CAST('0x' || substr(md5(flight_id || '-42'), 1, 15) AS BIGINT) < 230584300921369408
      THEN 'test' ELSE 'train' END AS part, count(*) AS rows, min(flight_id) AS first_id FROM flights GROUP BY 1"""
)
def hash_split(spark, d):
    train, test = training.hash_split(views.flights(spark, d), "flight_id")
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.min("flight_id").alias("first_id"))


@query(
    with_views(FLIGHTS_SQL, PREDICTIONS_SQL)
    + """, judged AS (SELECT CASE WHEN delay_minutes <= 15 THEN 'LOW' WHEN delay_minutes <= 40 THEN 'MEDIUM' ELSE 'HIGH' END AS label,
      CASE WHEN predicted_delay < 15 THEN 'LOW' WHEN predicted_delay < 30 THEN 'MEDIUM' ELSE 'HIGH' END AS guess FROM delays),
    classes AS (SELECT label AS class FROM judged UNION SELECT guess FROM judged),
    counts AS (SELECT class, (SELECT count(*) FROM judged WHERE label = class) AS support,
      (SELECT count(*) FROM judged WHERE guess = class) AS guessed,
      (SELECT count(*) FROM judged WHERE label = class AND guess = class) AS hits FROM classes),
    rates AS (SELECT *, CASE WHEN guessed = 0 THEN 0 ELSE hits / CAST(guessed AS DOUBLE) END AS precision,
      CASE WHEN support = 0 THEN 0 ELSE hits / CAST(support AS DOUBLE) END AS recall FROM counts),
    full_rates AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM rates),
    report AS (
      SELECT class, precision, recall, f1, support FROM full_rates
      UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(support) FROM full_rates
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM full_rates
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
        sum(f1 * support) / sum(support), sum(support) FROM full_rates)
    SELECT class, CAST(CAST(precision AS FLOAT) AS DOUBLE) AS precision, CAST(CAST(recall AS FLOAT) AS DOUBLE) AS recall, CAST(CAST(f1 AS FLOAT) AS DOUBLE) AS f1, CAST(support AS BIGINT) AS support
    FROM report"""
)
def classification_report(spark, d):
    f = views.flights(spark, d).select("seq", training_risk("delay_minutes").alias("label"))
    guessed = views.predictions(spark, d).select(F.col("id").alias("seq"), F.col("risk_level").alias("guess"))
    report = evaluation.classification_report(f.join(guessed, "seq"), "label", "guess")
    return stable(report, "precision", "recall", "f1")


@query()
def delay_quartiles_sketch(spark, d):
    """The one-pass approximate quartiles; exact ones have SQL checks."""
    return quantiles.sketched_quantiles(
        views.flights(spark, d), "delay_minutes", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["airline"]
    )


# training and scoring: results depend on the learner, so no SQL -----------------------------


def _delay_table(spark, d):
    return features.delay_features(views.flights(spark, d)).withColumn("is_delayed", is_delayed("delay_minutes"))


@cache
def _fit_delay(spark, d):
    table = _delay_table(spark, d)
    train, test = training.hash_split(table, "flight_id")
    return training.train_delay_regressor(train), train, test


def _metric(spark, **values):
    names = ", ".join(f"{k} DOUBLE" for k in values)
    return spark.createDataFrame([tuple(float(v) for v in values.values())], names)


@query()
def train_delay_regressor(spark, d):
    model, _, test = _fit_delay(spark, d)
    return _metric(spark, mae=training.mean_absolute_error(scoring.predicted(test, model)))


@query()
def train_delay_classifier(spark, d):
    train, test = training.hash_split(_delay_table(spark, d), "flight_id")
    model = training.train_delay_classifier(train)
    return _metric(spark, auc=training.area_under_roc(model.transform(test)))


@query()
def train_onehot_classifier(spark, d):
    table = views.flights(spark, d).select(
        "flight_id", F.col("airline").alias("carrier"), "terminal", "day_of_week", "weather",
        is_delayed("delay_minutes").alias("delayed"),
    )
    train, test = training.split_marked(training.stratified_split(table, "delayed", "flight_id"))
    model = training.train_onehot_classifier(train)
    return _metric(spark, accuracy=training.accuracy(scoring.predicted(test, model), "delayed"))


@cache
def _fit_weather(spark, d):
    """Boosted trees at the published size (200 rounds), and the rows held out."""
    table = views.weather_observations(spark, d)
    identity = F.concat_ws("|", "temperature", "wind_speed", "rain", "humidity")
    train, test = training.hash_split(table.withColumn("id", identity), "id")
    return boosting.train_boosted(train, features.SENSOR_FEATURES, "is_delayed", "id"), test


@query()
def train_weather_gbt(spark, d):
    model, test = _fit_weather(spark, d)
    guess = (model.margin() > 0).cast("int")
    return evaluation.classification_report(test.withColumn("guess", guess), "is_delayed", "guess")


@query()
def weather_auc(spark, d):
    """Area under the ROC curve of the boosted trees on the rows held out."""
    model, test = _fit_weather(spark, d)
    return evaluation.roc_auc(test.withColumn("probability", model.probability()), "is_delayed", "probability")


@query()
def weather_log_loss(spark, d):
    """Loss on the rows held out and on all rows after 0, 1, 50, 100 and 200 rounds."""
    model, test = _fit_weather(spark, d)
    rounds = [0, 1, 50, 100, 200]
    tables = {"held out": test, "all": views.weather_observations(spark, d)}
    losses = [boosting.log_loss(t, model, "is_delayed", rounds).withColumn("rows", F.lit(n)) for n, t in tables.items()]
    return losses[0].unionByName(losses[1])


@query()
def score_weather(spark, d):
    model, test = _fit_weather(spark, d)
    scored = test.withColumn("delay_probability", model.probability())
    return scored.groupBy("is_delayed").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("delay_probability").alias("avg_probability")
    )


AUC_SQL = """, scored AS (SELECT airline, CAST(predicted_delay AS FLOAT) AS score, delay_minutes > 15 AS late FROM delays),
    ranked AS (SELECT *, rank() OVER same + (count(*) OVER (PARTITION BY {by}, score) - 1) / CAST(2 AS DOUBLE) AS place
      FROM scored WINDOW same AS (PARTITION BY {by} ORDER BY score)),
    totals AS (SELECT {by} AS airline, count(*) FILTER (late) AS positives, count(*) FILTER (NOT late) AS negatives,
      sum(place) FILTER (late) AS places FROM ranked GROUP BY {by})
    SELECT {shown} positives, negatives, CAST(CAST((places - CAST(positives AS DOUBLE) * (positives + 1) / 2)
      / (CAST(positives AS DOUBLE) * negatives) AS FLOAT) AS DOUBLE) AS auc FROM totals"""


def _late_predictions(spark, d):
    late = views.flights(spark, d).select("seq", is_delayed("delay_minutes").alias("late"))
    guessed = views.predictions(spark, d).select(F.col("id").alias("seq"), "airline", F.col("predicted_delay").cast("float").alias("score"))
    return late.join(guessed, "seq")


@query(with_views(FLIGHTS_SQL, PREDICTIONS_SQL) + AUC_SQL.format(by="true", shown=""))
def roc_auc(spark, d):
    return stable(evaluation.roc_auc(_late_predictions(spark, d), "late", "score"), "auc")


@query(with_views(FLIGHTS_SQL, PREDICTIONS_SQL) + AUC_SQL.format(by="airline", shown="airline,"))
def roc_auc_by_airline(spark, d):
    return stable(evaluation.roc_auc(_late_predictions(spark, d), "late", "score", ["airline"]), "auc")


def _risk_table(spark, d):
    return features.risk_features(_risk_input(spark, d)).dropna(subset=["risk_label"])


@cache
def _fit_risk(spark, d, trees=200):
    train, test = training.split_marked(training.stratified_split(_risk_table(spark, d), "risk_label", "flight_id"))
    return training.train_risk_classifier(train, trees=trees), train, test


@query()
def train_risk_classifier(spark, d):
    model, _, test = _fit_risk(spark, d)
    scored = scoring.score_risk(test, model)
    return evaluation.classification_report(scored, "risk_label", "risk_level")


@cache
def _cross_validated(spark, d):
    return training.cross_validate_f1(_risk_table(spark, d), "flight_id", trees=20)


@query()
def cross_validate_f1(spark, d):
    mean, std = _cross_validated(spark, d)
    return _metric(spark, f1_mean=mean, f1_std=std)


@query()
def feature_importances(spark, d):
    model, _, _ = _fit_risk(spark, d)
    return evaluation.feature_importances(spark, model, features.RISK_FEATURES)


@query()
def model_summary(spark, d):
    model, train, test = _fit_risk(spark, d)
    return evaluation.model_summary(
        spark, model, features.RISK_FEATURES, AS_OF, model.stages[0].labels, _cross_validated(spark, d), train.count(), test.count()
    )


@query()
def score_delay(spark, d):
    model, _, _ = _fit_delay(spark, d)
    scored = scoring.score_delay(_delay_table(spark, d), model)
    return scored.select(
        "flight_id", "predicted_delay", "delay_probability", "risk_level", "recommendation", "model_used"
    )


@query(
    FLIGHTS
    + """SELECT flight_id, airline, gate, CAST(50 AS DOUBLE) AS predicted_delay_percent, 'MEDIUM' AS delay_risk,
      CAST(20 AS DOUBLE) AS predicted_delay, CAST(CAST(CAST(20 AS DOUBLE) / 90 * 100 AS FLOAT) AS DOUBLE) AS delay_probability, 'MEDIUM' AS risk_level
    FROM flights"""
)
def score_without_model(spark, d):
    f = views.flights(spark, d)
    percent = scoring.score_percent(f)
    delay = scoring.score_delay(f).select("flight_id", "predicted_delay", "delay_probability", "risk_level")
    return stable(percent.join(delay, "flight_id"), "delay_probability")


@query(name="score_risk_model")
def score_risk(spark, d):
    model, _, _ = _fit_risk(spark, d)
    return scoring.score_risk(_risk_table(spark, d), model).select("flight_id", "risk_level", "risk_score")


@query()
def attribute(spark, d):
    model, train, _ = _fit_delay(spark, d)
    means = scoring.feature_means(train, features.DELAY_FEATURES)
    explained = scoring.attribute(_delay_table(spark, d), model, features.DELAY_FEATURES, means)
    return explained.select("flight_id", F.to_json("factors").alias("factors"))


@query()
def explain_delay(spark, d):
    """Exact Shapley values of every delay prediction: base, one contribution per feature, strongest factors."""
    model, _, _ = _fit_delay(spark, d)
    explained = shapley.explain(_delay_table(spark, d), model, features.DELAY_FEATURES)
    return explained.select("flight_id", "base", F.to_json("contributions").alias("contributions"), F.to_json("factors").alias("factors"))


@query(FLIGHTS + "SELECT flight_id, 6 AS features, true AS adds_up FROM flights")
def explanations_add_up(spark, d):
    """Base and contributions of every flight give its prediction to 1e-9."""
    model, _, _ = _fit_delay(spark, d)
    scored = scoring.predicted(_delay_table(spark, d), model).select("flight_id", "prediction", *features.DELAY_FEATURES)
    explained = shapley.explain(scored, model, features.DELAY_FEATURES)
    total = F.aggregate("contributions", F.col("base"), lambda a, b: a + b)
    gap = F.abs(total - F.col("prediction"))
    return explained.select("flight_id", F.size("contributions").alias("features"), (gap < 1e-9).alias("adds_up"))


@query()
def top_factors(spark, d):
    """The four strongest factors (exact Shapley values) of every risk prediction, as rows."""
    model, _, _ = _fit_risk(spark, d)
    explained = shapley.explain(_risk_table(spark, d), model, features.RISK_FEATURES, 4, 3, "risk")
    return explained.select("flight_id", F.posexplode("factors").alias("position", "factor")).select(
        "flight_id", "position", "factor.*"
    )
