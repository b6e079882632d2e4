"""MLlib training on feature tables.

Forests are MLlib's (the risk forest is grown on counted rows, see ``forests``), not bit-identical to other libraries. Depth is bounded (MLlib allows 30
at most); everything else follows the published settings by default.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator,
    MulticlassClassificationEvaluator,
    RegressionEvaluator,
)
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apronflow.models import forests
from apronflow.models.features import (
    DELAY_FEATURES,
    ONEHOT_FEATURES,
    RISK_FEATURES,
    SENSOR_FEATURES,
    WEATHER_DELAY_FEATURES,
)
from apronflow.operators.ranking import id_digest, id_number, smallest_share
from apronflow.sources.scratch import materialize, use_checkpoint_folder

# a forest keeps a draw and a node per row and tree, some 2 KB a row at 200 trees, and a task reads its rows'
ROWS_PER_TASK = 250_000
# each pass reads the node a row has reached instead of walking every tree from its root: the same forest
KEPT_NODES = {"cacheNodeIds": True, "checkpointInterval": -1}


def hash_split(df: DataFrame, identifier: str, test_share: float = 0.2, seed: int = 42):
    """(train, test) by a threshold on the id digest: no shuffle, the same rows on every run."""
    limit = f"{int(test_share * 16**15):015x}"
    digest = id_digest(identifier, seed)
    return df.filter(digest >= limit), df.filter(digest < limit)


def stratified_split(
    df: DataFrame, label: str, identifier: str, test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """``is_test`` = 1 for the given share of every class: those with the smallest id digests.

    The cut-off per class is found by counting (see ``smallest_share``), so a class that
    holds most rows is never sorted in one task. Copies of an id fall on the same side.
    """
    keyed = df.withColumn("_digest", id_digest(identifier, seed))
    cutoffs = smallest_share(keyed, label, "_digest", test_share)
    marked = keyed.join(cutoffs, label, "left")
    inside = F.coalesce((F.col("_digest") <= F.col("cutoff")).cast("int"), F.lit(0))
    return marked.select(*df.columns, inside.alias("is_test"))


def split_marked(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        marked.filter("is_test = 0").drop("is_test"),
        marked.filter("is_test = 1").drop("is_test"),
    )


def training_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """The needed columns as a written table.

    Training passes over its rows many times, and after a lost executor they are read again
    instead of joined again. A table of few files is spread over all cores, and a large one over so many
    tasks that none holds more than about ``ROWS_PER_TASK`` rows.
    """
    table = materialize(df.select(*dict.fromkeys(columns)), "training")
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-table.count() // ROWS_PER_TASK))
    return table if table.rdd.getNumPartitions() >= tasks else table.repartition(tasks)


def _assembled(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features")


def train_delay_regressor(
    train: DataFrame, trees: int = 100, depth: int = 10, seed: int = 42
) -> PipelineModel:
    forest = RandomForestRegressor(
        featuresCol="features", labelCol="delay_minutes", numTrees=trees, maxDepth=depth, seed=seed, **KEPT_NODES
    )
    rows = training_table(train, [*DELAY_FEATURES, "delay_minutes"])
    return Pipeline(stages=[_assembled(DELAY_FEATURES), forest]).fit(rows)


def mean_absolute_error(scored: DataFrame, label: str = "delay_minutes") -> float:
    return RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="mae").evaluate(scored)


def train_delay_classifier(
    train: DataFrame, trees: int = 100, depth: int = 10, seed: int = 42
) -> PipelineModel:
    """Late-flight classifier on ``is_delayed``."""
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="is_delayed", numTrees=trees, maxDepth=depth, seed=seed, **KEPT_NODES
    )
    rows = training_table(train, [*WEATHER_DELAY_FEATURES, "is_delayed"])
    return Pipeline(stages=[_assembled(WEATHER_DELAY_FEATURES), forest]).fit(rows)


def area_under_roc(scored: DataFrame, label: str = "is_delayed") -> float:
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="probability").evaluate(scored)


def accuracy(scored: DataFrame, label: str) -> float:
    return MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy").evaluate(scored)


def train_onehot_classifier(
    train: DataFrame, label: str = "delayed", trees: int = 200, depth: int = 10, seed: int = 42
) -> PipelineModel:
    """One-hot categories into a forest; a category unseen in training is the zero vector."""
    index = StringIndexer(
        inputCols=ONEHOT_FEATURES,
        outputCols=[f"{c}_index" for c in ONEHOT_FEATURES],
        handleInvalid="keep",
    )
    # "keep" gives unseen values the last index, and dropLast turns that index into zeros
    onehot = OneHotEncoder(
        inputCols=index.getOutputCols(),
        outputCols=[f"{c}_vector" for c in ONEHOT_FEATURES],
        dropLast=True,
    )
    forest = RandomForestClassifier(
        featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, **KEPT_NODES
    )
    rows = training_table(train, [*ONEHOT_FEATURES, label])
    return Pipeline(stages=[index, onehot, _assembled(onehot.getOutputCols()), forest]).fit(rows)


def train_weather_gbt(
    train: DataFrame, rounds: int = 200, depth: int = 6, step: float = 0.05, seed: int = 42
) -> PipelineModel:
    """Boosted trees on sensor readings; columns are subsampled per node (not per tree)."""
    use_checkpoint_folder(train.sparkSession)
    boosted = GBTClassifier(
        featuresCol="features",
        labelCol="is_delayed",
        maxIter=rounds,
        maxDepth=depth,
        stepSize=step,
        subsamplingRate=0.8,
        featureSubsetStrategy="0.8",
        seed=seed,
    )
    rows = training_table(train, [*SENSOR_FEATURES, "is_delayed"])
    return Pipeline(stages=[_assembled(SENSOR_FEATURES), boosted]).fit(rows)


def balanced_weights(df: DataFrame, label: str = "risk_label", count: str | None = None) -> DataFrame:
    """``weight`` = rows / (classes * rows of the class); ``count`` names the number of rows behind each row."""
    counts = df.groupBy(label).agg((F.sum(count) if count else F.count(F.lit(1))).alias("_n"))
    # the class counts are written once; their sums are one-row scalars of that table
    counts = materialize(counts, "classes")
    rows = counts.select(F.sum("_n")).scalar()
    classes = counts.select(F.count(F.lit(1))).scalar()
    weighted = df.join(counts, label)
    return weighted.select(*df.columns, (rows / (classes * F.col("_n"))).alias("weight"))


def risk_pipeline(trees: int = 200, depth: int = 12, min_leaf: int = 5, seed: int = 42) -> Pipeline:
    label = StringIndexer(inputCol="risk_label", outputCol="label", stringOrderType="alphabetAsc")
    forest = RandomForestClassifier(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=min_leaf,
        seed=seed,
        **KEPT_NODES,
    )
    return Pipeline(stages=[label, _assembled(RISK_FEATURES), forest])


def train_risk_classifier(train: DataFrame, **settings) -> PipelineModel:
    """LOW / MEDIUM / HIGH forest with balanced class weights, grown on counted rows (see ``forests``)."""
    rows = forests.counted(train, [*RISK_FEATURES, "risk_label"])
    return forests.fit(risk_pipeline(**settings), balanced_weights(rows, count="n"))


def with_folds(df: DataFrame, identifier: str, folds: int = 5, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", F.pmod(id_number(identifier, seed), F.lit(folds)).cast("int"))


def cross_validate_f1(
    df: DataFrame, identifier: str, folds: int = 5, seed: int = 42, **settings
) -> tuple[float, float]:
    """Mean and standard deviation of the weighted F1 over hash folds, fitted and judged on counted rows."""
    rows = forests.counted(with_folds(df, identifier, folds, seed), [*RISK_FEATURES, "risk_label", "fold"])
    weighted = materialize(balanced_weights(rows, count="n"), "folds")
    judge = MulticlassClassificationEvaluator(labelCol="label", metricName="f1", weightCol="n")
    scores = []
    for fold in range(folds):
        model = forests.fit(risk_pipeline(seed=seed, **settings), weighted.filter(F.col("fold") != fold))
        scores.append(judge.evaluate(model.transform(weighted.filter(F.col("fold") == fold))))
    return float(np.mean(scores)), float(np.std(scores))
