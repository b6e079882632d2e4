"""Model reports computed as DataFrames."""

from __future__ import annotations

import datetime as dt

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apronflow.operators.ranking import prefix_sum


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """precision, recall, f1 and support per class, then accuracy, macro and weighted means.

    Rows are counted per (label, prediction) first; everything after works on those counts.
    """
    pairs = df.groupBy(
        F.col(label).cast("string").alias("label"), F.col(prediction).cast("string").alias("guess")
    ).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(0).cast("long")
    n = F.col("n")
    hit = F.when(F.col("label") == F.col("guess"), n).otherwise(none)
    sides = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("class"), n.alias("support"), none.alias("guessed"), hit.alias("hits")),
                F.struct(F.col("guess").alias("class"), none.alias("support"), n.alias("guessed"), none.alias("hits")),
            )
        )
    )
    totals = sides.groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hits").alias("hits")
    )
    precision = F.coalesce(F.try_divide("hits", "guessed"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    scored = totals.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1",
        F.coalesce(
            F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
            F.lit(0.0),
        ),
    )
    figures = ["precision", "recall", "f1"]
    support = F.sum("support")
    weighted = [(F.sum(F.col(c) * F.col("support")) / support).alias(c) for c in figures]
    hit_share = F.sum("hits") / support
    summary = scored.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("class"), *[hit_share.alias(c) for c in figures], support.alias("support")),
            F.struct(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in figures], support.alias("support")),
            F.struct(F.lit("weighted avg").alias("class"), *weighted, support.alias("support")),
        ).alias("rows")
    ).select(F.inline("rows"))
    return scored.select("class", *figures, "support").unionByName(summary)


def roc_auc(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """``by``, positives, negatives and the exact area under the ROC curve of ``score`` for a 0/1 label.

    The rank statistic with average ranks for ties: rows are counted per score first, and the negatives
    below each score come from the two-phase running total, so neither a hot score nor a hot group is
    sorted in one task. Rows without label, score or group are left out; the area is null where one
    class is missing. A table without rows has one row of zero counts, or none with ``by``.
    """
    by = by or []
    positive = F.col(label).cast("int")
    rows = df.select(*by, F.col(score).cast("double").alias("_score"), positive.alias("_positive")).dropna()
    counts = rows.groupBy(*by, "_score").agg(
        F.sum("_positive").cast("long").alias("_pos"), F.sum(1 - F.col("_positive")).cast("long").alias("_neg")
    )
    below = prefix_sum(counts, ["_score"], "_neg", by, name="_below")
    # twice the pairs a positive wins, as whole numbers of any size
    pairs = F.col("_pos").cast("decimal(18,0)") * (2 * F.col("_below") + F.col("_neg")).cast("decimal(19,0)")
    totals = below.groupBy(*by).agg(
        F.coalesce(F.sum("_pos"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum("_neg"), F.lit(0)).alias("negatives"),
        F.sum(pairs).cast("double").alias("_won"),
    )
    possible = 2.0 * F.col("positives").cast("double") * F.col("negatives").cast("double")
    return totals.select(*by, "positives", "negatives", F.try_divide(F.col("_won"), possible).alias("auc"))


def feature_importances(spark: SparkSession, model: PipelineModel, features: list[str]) -> DataFrame:
    """Importance per feature, largest first (a handful of numbers held by the model)."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature STRING, importance DOUBLE").orderBy(
        F.desc("importance"), "feature"
    )


def model_summary(
    spark: SparkSession,
    model: PipelineModel,
    features: list[str],
    trained_at: dt.datetime,
    classes: list[str] | None = None,
    cv_f1: tuple[float, float] | None = None,
    training_rows: int | None = None,
    test_rows: int | None = None,
) -> DataFrame:
    """One metadata row about a trained model."""
    tree = model.stages[-1]
    importances = {f: round(float(v), 4) for f, v in zip(features, tree.featureImportances.toArray())}
    mean, std = cv_f1 or (None, None)
    return spark.createDataFrame(
        [
            (
                trained_at, type(tree).__name__.removesuffix("Model"), tree.getNumTrees, features, classes,
                None if mean is None else round(mean, 4), None if std is None else round(std, 4),
                training_rows, test_rows, importances,
            )
        ],
        """trained_at TIMESTAMP, model_type STRING, trees INT, features ARRAY<STRING>,
        classes ARRAY<STRING>, cv_f1_mean DOUBLE, cv_f1_std DOUBLE, training_rows BIGINT,
        test_rows BIGINT, feature_importances MAP<STRING, DOUBLE>""",
    )
