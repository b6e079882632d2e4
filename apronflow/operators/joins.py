"""Joins of facts with derived dimensions.

Derived dimensions are written first (``materialize``), so their real size decides between a
broadcast and a shuffle join. They hold one row per key, so a dominant key on the fact side
cannot multiply rows, and adaptive skew handling can split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apronflow.functions.columns import lookup
from apronflow.functions.fixed_values import DAYS
from apronflow.sources.scratch import materialize


def encode(df: DataFrame, dim: DataFrame, column: str, code: str) -> DataFrame:
    """Code of each value from a ``(value, code)`` table; unseen and null values get 0."""
    codes = dim.select(F.col("value").alias(column), F.col("code").alias(code))
    joined = df.join(codes, column, "left").withColumn(code, F.coalesce(F.col(code), F.lit(0)))
    return joined.select(*df.columns, code)


def group_mean(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Mean per key as a written table; null keys are left out."""
    return materialize(df.dropna(subset=keys).groupBy(*keys).agg(F.avg(value).alias(name)), "group-mean")


def join_group_mean(
    df: DataFrame, facts: DataFrame, keys: list[str], value: str, default: float, name: str
) -> DataFrame:
    """Mean of ``value`` over the facts with the same keys; ``default`` for unseen keys."""
    means = group_mean(facts, keys, value, name)
    joined = df.join(means, keys, "left")
    return joined.select(*df.columns, F.coalesce(F.col(name), F.lit(float(default))).alias(name))


def full_calendar(
    df: DataFrame, position: str, value: str, size: int, by: list[str] | None = None
) -> DataFrame:
    """Positions 0..size-1 for every group, with null where the group has no row.

    ``df`` holds at most one row per group and position, so a group is a map of at most
    ``size`` entries and the calendar needs no join.
    """
    by = by or []
    known = df.filter(F.col(position).between(0, size - 1)).groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(position).cast("int"), value))).alias("_known")
    )
    every = known.select(*by, "_known", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(position))
    return every.select(*by, position, F.try_element_at("_known", F.col(position)).alias(value))


def reindex_hours(df: DataFrame, hour: str, value: str, by: list[str] | None = None) -> DataFrame:
    return full_calendar(df, hour, value, 24, by)


def reindex_days(
    df: DataFrame, day: str, value: str, by: list[str] | None = None, default: float | None = None
) -> DataFrame:
    """Mon..Sun for every group; missing days null or ``default``."""
    numbered = df.withColumn("day_no", lookup(day, {d: i for i, d in enumerate(DAYS)}, None))
    week = full_calendar(numbered.drop(day), "day_no", value, 7, by)
    names = F.element_at(F.array(*[F.lit(d) for d in DAYS]), F.col("day_no") + 1)
    filled = F.col(value) if default is None else F.coalesce(F.col(value), F.lit(float(default)))
    return week.select(*(by or []), "day_no", names.alias(day), filled.alias(value))


def baggage_by_terminal(baggage: DataFrame, passengers: DataFrame) -> DataFrame:
    """Bags per passenger terminal and status.

    Both sides are counted per join key first: a passenger holding a third of all bags becomes
    one row per status before the shuffle.
    """
    bags = baggage.groupBy("passenger_id", "status").agg(F.count(F.lit(1)).alias("_bags"))
    owners = passengers.groupBy("passenger_id", "terminal").agg(F.count(F.lit(1)).alias("_owners"))
    return (
        bags.join(owners, "passenger_id")
        .groupBy("terminal", "status")
        .agg(F.sum(F.col("_bags") * F.col("_owners")).alias("bags"))
    )
