"""Exact quantiles over groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apronflow.operators.ranking import SMALL_ROWS, prefix_sum

# size parameter of a stored sketch: rank error below 0.5 percent
SKETCH_K = 800


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: dict[str, float],
    by: list[str] | None = None,
    small: int = SMALL_ROWS,
) -> DataFrame:
    """Linearly interpolated quantiles, one column per entry of ``probabilities``.

    Rows are first counted per distinct value (map-side combined), then ranked by a two-phase
    running count, so neither a dominant group nor many distinct values meet in one task.
    """
    by = by or []
    counts = (
        df.select(*by, F.col(value).cast("double").alias("_value"))
        .dropna()
        .groupBy(*by, "_value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    placed = prefix_sum(counts, ["_value"], "_n", by, "_before", small, total="_size")

    def at(rank):
        inside = (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
        return F.max(F.when(inside, F.col("_value")))

    results = []
    for name, p in probabilities.items():
        position = (F.col("_size") - 1) * F.lit(float(p))
        low, high = at(F.floor(position)), at(F.ceil(position))
        fraction = F.max(position - F.floor(position))
        results.append((low + (high - low) * fraction).alias(name))
    return placed.groupBy(*by).agg(*results)


def sketched_quantiles(
    df: DataFrame,
    value: str,
    probabilities: dict[str, float],
    by: list[str] | None = None,
    accuracy: int = 10000,
) -> DataFrame:
    """The same columns from a mergeable sketch: one pass, rank error 1/accuracy."""
    names = list(probabilities)
    sketch = F.percentile_approx(value, [float(p) for p in probabilities.values()], accuracy)
    return (
        df.dropna(subset=[*(by or []), value])
        .groupBy(*(by or []))
        .agg(sketch.alias("_q"))
        .select(*(by or []), *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    )


def daily_sketches(df: DataFrame, value: str, by: list[str], day: str = "date", k: int = SKETCH_K) -> DataFrame:
    """One mergeable quantile sketch of ``value`` per day and group: a few kilobytes however many rows.

    Store it with ``load_facts``, which replaces the days it is given; null and NaN values, groups and
    days are left out.
    """
    number = F.col(value).cast("double")
    rows = df.select(day, *by, number.alias("_value")).dropna()
    return rows.groupBy(day, *by).agg(
        F.count(F.lit(1)).alias("rows"), F.kll_sketch_agg_double("_value", F.lit(k)).alias("sketch")
    )


def merged_quantiles(
    sketches: DataFrame, probabilities: dict[str, float], by: list[str] | None = None
) -> DataFrame:
    """Approximate quantiles per group from stored sketches; the facts are not read again.

    Sketches are merged on the map side first, so a group sends one sketch per task.
    """
    names = list(probabilities)
    merged = sketches.groupBy(*(by or [])).agg(
        F.sum("rows").alias("rows"), F.kll_merge_agg_double("sketch").alias("_sketch")
    )
    found = F.kll_sketch_get_quantile_double("_sketch", F.array(*[F.lit(float(p)) for p in probabilities.values()]))
    return merged.withColumn("_q", found).select(
        *(by or []), "rows", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)]
    )


def rank_errors(df: DataFrame, value: str, quantiles: DataFrame, probabilities: dict[str, float], by: list[str]) -> DataFrame:
    """How far each quantile's true rank share lies from its probability, per group and quantile name.

    The true share is a range where rows equal the quantile; inside it the error is 0.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_value")).dropna()
    rows = rows.groupBy(*by, "_value").agg(F.count(F.lit(1)).alias("_n"))
    counts = []
    for name in probabilities:
        counts.append(F.sum(F.when(F.col("_value") < F.col(name), F.col("_n")).otherwise(0)).alias(f"_below_{name}"))
        counts.append(F.sum(F.when(F.col("_value") <= F.col(name), F.col("_n")).otherwise(0)).alias(f"_to_{name}"))
    ranked = rows.join(quantiles.select(*by, *probabilities), by).groupBy(*by).agg(F.sum("_n").alias("_all"), *counts)
    parts = [
        F.struct(
            F.lit(name).alias("quantile"),
            F.greatest(
                F.col(f"_below_{name}") / F.col("_all") - p, p - F.col(f"_to_{name}") / F.col("_all"), F.lit(0.0)
            ).alias("rank_error"),
        )
        for name, p in probabilities.items()
    ]
    return ranked.select(*by, F.inline(F.array(*parts)))
