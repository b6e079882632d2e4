"""Batch scoring: models applied to whole tables, with rule-based defaults.

A tree ensemble tells rows apart by their features only, and these are codes, hours and flags. So a model
is applied once to every distinct feature vector, spread over all cores, and each row reads its vector's
result by a join. Vectors are shuffled and written like any other table; a vector held by most rows is
one row of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apronflow.functions.fixed_values import RISK_CLASS_SCORE, UNKNOWN_CLASS_SCORE
from apronflow.functions.risk import probability_risk
from apronflow.plans.risk_scores import describe_prediction
from apronflow.sources.scratch import materialize

MODEL_COLUMNS = ["features", "rawPrediction", "probability", "prediction"]


def _without_model_columns(df: DataFrame, *more: str) -> DataFrame:
    return df.drop(*MODEL_COLUMNS, *more)


def input_columns(model: PipelineModel) -> list[str]:
    """The columns a fitted pipeline reads from a table."""
    needed, made = [], set()
    for stage in model.stages:
        read = {"inputCols": list, "inputCol": lambda c: [c], "featuresCol": lambda c: [c]}
        for param, names in read.items():
            if stage.hasParam(param) and stage.isDefined(param):
                needed += [c for c in names(stage.getOrDefault(param)) if c not in made]
        for param in ("outputCols", "outputCol"):
            if stage.hasParam(param) and stage.isDefined(param):
                found = stage.getOrDefault(param)
                made |= set(found if param == "outputCols" else [found])
    return list(dict.fromkeys(needed))


def per_vector(df: DataFrame, features: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with the columns that ``compute`` adds to the table of its distinct feature vectors.

    ``compute`` keeps the features and gives one row per vector. Columns of ``df`` with the names of the
    added ones are replaced.
    """
    conf, context = df.sparkSession.conf, df.sparkSession.sparkContext
    tasks = max(context.defaultParallelism, int(conf.get("spark.sql.shuffle.partitions")))
    # a fixed number of partitions: vectors are few bytes, but each takes the whole ensemble
    vectors = materialize(df.select(*features).distinct(), "vectors").repartition(tasks)
    computed = compute(vectors)
    added = [c for c in computed.columns if c not in features]
    keys = [F.col(f).alias(f"_key_{i}") for i, f in enumerate(features)]
    results = materialize(computed.select(*keys, *added), "scored")
    kept = df.drop(*added)
    same = [kept[f].eqNullSafe(results[f"_key_{i}"]) for i, f in enumerate(features)]
    joined = kept.join(results, same, "left")
    return joined.select(*[kept[f"`{c}`"] for c in kept.columns], *[results[c] for c in added])


def predicted(df: DataFrame, model: PipelineModel, **columns: Column) -> DataFrame:
    """``df`` with columns made of the model's outputs (by default ``prediction``)."""
    features = input_columns(model)
    columns = columns or {"prediction": F.col("prediction")}
    return per_vector(df, features, lambda v: model.transform(v).select(*features, *[c.alias(n) for n, c in columns.items()]))


def score_delay(
    df: DataFrame,
    model: PipelineModel | None = None,
    probability_model: PipelineModel | None = None,
    default: float = 20.0,
) -> DataFrame:
    """predicted_delay, delay_probability, risk_level, recommendation and model_used.

    Without a model every flight gets the default delay. A second model, if given, replaces
    the linear probability.
    """
    if model is None:
        scored = df.withColumn("predicted_delay", F.lit(default))
    else:
        scored = _without_model_columns(predicted(df, model, predicted_delay=F.col("prediction")))
    scored = describe_prediction(scored).withColumn(
        "model_used", F.lit("statistical" if model is None else "random_forest")
    )
    if probability_model is not None:
        percent = vector_to_array("probability")[1] * 100
        scored = _without_model_columns(predicted(scored, probability_model, delay_probability=percent))
    return scored


def score_percent(df: DataFrame, model: PipelineModel | None = None) -> DataFrame:
    """BI export rows: late probability in percent and its level; 50 without a model."""
    if model is None:
        scored = df.withColumn("predicted_delay_percent", F.lit(50.0))
    else:
        scored = predicted(df, model, predicted_delay_percent=vector_to_array("probability")[1] * 100)
    return scored.select(
        "flight_id",
        "airline",
        "gate",
        "predicted_delay_percent",
        probability_risk("predicted_delay_percent").alias("delay_risk"),
    )


def score_risk(df: DataFrame, model: PipelineModel) -> DataFrame:
    """risk_level (most probable class) and risk_score (class scores weighted by probability)."""
    labels = model.stages[0].labels
    scorer = PipelineModel(model.stages[1:])
    scores = F.array(*[F.lit(float(RISK_CLASS_SCORE.get(c, UNKNOWN_CLASS_SCORE))) for c in labels])
    names = F.array(*[F.lit(c) for c in labels])
    weighted = F.zip_with(vector_to_array("probability"), scores, lambda p, s: p * s)
    return _without_model_columns(
        predicted(
            df,
            scorer,
            risk_level=F.element_at(names, F.col("prediction").cast("int") + 1),
            risk_score=F.aggregate(weighted, F.lit(0.0), lambda a, b: a + b),
        )
    )


def score_weather(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Probability of delay from sensor readings."""
    return _without_model_columns(
        model.transform(df).withColumn("delay_probability", vector_to_array("probability")[1])
    )


def feature_means(df: DataFrame, features: list[str]) -> dict[str, float]:
    """Training means, the background of ``attribute``: one row of a few numbers."""
    row = df.agg(*[F.avg(f).alias(f) for f in features]).first()
    return {f: row[f] or 0.0 for f in features}


def attribute(
    df: DataFrame,
    model: PipelineModel,
    features: list[str],
    means: dict[str, float],
    k: int = 6,
    digits: int = 2,
    subject: str = "delay",
) -> DataFrame:
    """``factors``: the k features that move each prediction most.

    Contribution = prediction minus the prediction with that feature at its training mean
    (occlusion). This is not a Shapley value. All re-scorings are columns of one pass over the
    distinct feature vectors. For a classifier the predicted class's probability is explained.
    """
    tree = model.stages[-1]
    classifier = tree.hasParam("probabilityCol")

    def scored(current: DataFrame, name: str, replaced: str | None) -> DataFrame:
        values = [F.lit(float(means[f])) if f == replaced else F.col(f).cast("double") for f in features]
        copy = tree.copy()
        copy.setFeaturesCol(f"_x_{name}").setPredictionCol(f"_y_{name}")
        if classifier:
            copy.setProbabilityCol(f"_p_{name}").setRawPredictionCol("")
        out = copy.transform(current.withColumn(f"_x_{name}", array_to_vector(F.array(*values))))
        return out.drop(f"_x_{name}")

    def outcome(name: str) -> Column:
        if not classifier:
            return F.col(f"_y_{name}")
        return vector_to_array(f"_p_{name}")[F.col("_y_all").cast("int")]

    impacts = [outcome("all") - outcome(str(i)) for i in range(len(features))]
    factors = F.array(
        *[
            F.struct(
                F.lit(feature).alias("feature"),
                F.bround(impact, digits).alias("impact"),
                F.when(impact > 0, f"increases {subject}").otherwise(f"reduces {subject}").alias("direction"),
            )
            for feature, impact in zip(features, impacts)
        ]
    )

    def explained(vectors: DataFrame) -> DataFrame:
        result = scored(vectors, "all", None)
        for i, feature in enumerate(features):
            result = scored(result, str(i), feature)
        return result.select(*features, top_factors(factors, k).alias("factors"))

    return per_vector(df, features, explained)


def top_factors(factors: Column | str, k: int = 4) -> Column:
    """The k factors with the largest absolute impact; ties by name."""
    column = F.col(factors) if isinstance(factors, str) else factors
    keyed = F.transform(
        column,
        lambda f: F.struct((-F.abs(f["impact"])).alias("size"), f["feature"].alias("name"), f.alias("factor")),
    )
    return F.slice(F.transform(F.array_sort(keyed), lambda f: f["factor"]), 1, k)
