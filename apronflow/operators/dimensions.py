"""Dimension tables: surrogate keys, label codes, dates."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, StructField, StructType

from apronflow.functions.calendar import day_name, is_weekend_time
from apronflow.operators.ranking import number_rows
from apronflow.sources.scratch import materialize
from apronflow.sources.writers import replace_parts


def first_appearance_dim(df: DataFrame, column: str, order: str, key: str) -> DataFrame:
    """Distinct values numbered from 1 by the first ``order`` value they appear at."""
    first = (
        df.dropna(subset=[column])
        .groupBy(column)
        .agg(F.min(order).alias("_first"))
    )
    return number_rows(first, ["_first", column], key).select(column, key)


def dim_airlines(flights: DataFrame, order: str = "seq") -> DataFrame:
    return first_appearance_dim(flights, "airline", order, "airline_id")


def dim_terminals(flights: DataFrame, order: str = "seq") -> DataFrame:
    return first_appearance_dim(flights, "terminal", order, "terminal_id")


def dim_weather(flights: DataFrame, order: str = "seq") -> DataFrame:
    return first_appearance_dim(flights, "weather", order, "weather_id")


def dim_dates(flights: DataFrame, column: str = "departure_time") -> DataFrame:
    """One row per day from the first departure in steps of 24 hours.

    Steps keep the first departure's time of day, so the last calendar date is missing when
    the last departure is earlier in its day than the first was in its own.
    """
    span = flights.agg(F.min(column).alias("first"), F.max(column).alias("last")).dropna()
    steps = span.select(F.explode(F.expr("sequence(first, last, interval 1 day)")).alias("at"))
    return steps.select(
        F.to_date("at").alias("date"),
        day_name("at").alias("day_name"),
        F.month("at").alias("month"),
        F.date_format("at", "MMMM").alias("month_name"),
        F.year("at").alias("year"),
        F.quarter("at").alias("quarter"),
        is_weekend_time("at").alias("is_weekend"),
    )


def label_dim(df: DataFrame, column: str) -> DataFrame:
    """(value, code) with codes 0..n-1 in alphabetical order."""
    values = df.select(F.col(column).cast("string").alias("value")).dropna().distinct()
    return number_rows(values, ["value"], "code", start=0)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values."""
    return df.select(column).dropna().distinct().orderBy(column)


def stored_dim(spark: SparkSession, path: str, column: str, kind: DataType, key: str) -> DataFrame:
    """(value, key, load) of a dimension written by ``load_dim``; empty where none was written."""
    fields = [StructField(column, kind), StructField(key, IntegerType()), StructField("load", IntegerType())]
    schema = StructType(fields)
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def load_dim(df: DataFrame, path: str, column: str, key: str, order: str | None = None, start: int = 1) -> None:
    """Add the values of ``column`` that the dimension at ``path`` lacks.

    New values are numbered on from the largest stored key, by the first ``order`` they appear at (or
    by value without ``order``), so a stored value never changes its key. The first load gives the keys
    of ``first_appearance_dim`` (or ``label_dim`` with ``start=0``). Each load is a folder of its own that is moved
    in when its job has ended: one that fails changes nothing, and one that is repeated adds nothing.
    Nulls get no key; a table takes one load at a time.
    """
    stored = stored_dim(df.sparkSession, path, column, df.schema[column].dataType, key)
    last_key, last_load = stored.agg(F.max(key), F.max("load")).first()
    place = F.min(order) if order else F.lit(0)
    first = df.dropna(subset=[column]).groupBy(column).agg(place.alias("_first"))
    new = first.join(stored.select(column), column, "left_anti")
    begin = start if last_key is None else last_key + 1
    numbered = materialize(number_rows(new, ["_first", column], key, start=begin).select(column, key), "dimension")
    load = 0 if last_load is None else last_load + 1
    replace_parts(numbered.withColumn("load", F.lit(load)), "load", path)
