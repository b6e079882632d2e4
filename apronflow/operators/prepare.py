"""Cleaning and preparation of raw tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apronflow.functions.calendar import day_name, day_short, hour_from_minutes
from apronflow.functions.fixed_values import PREPARED_AIRLINES
from apronflow.functions.risk import is_delayed
from apronflow.operators.quantiles import exact_quantiles


def normalize_columns(df: DataFrame) -> DataFrame:
    """Trimmed lower-case column names."""
    return df.toDF(*[name.strip().lower() for name in df.columns])


def parse_timestamp(df: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """Text to timestamp; a bad value becomes null, or fails the job when ``strict``."""
    parse = F.to_timestamp if strict else F.try_to_timestamp
    return df.withColumn(column, parse(F.col(column)))


def add_calendar(df: DataFrame, column: str) -> DataFrame:
    """date, month, month_name, year, hour and day_name of a timestamp column."""
    return df.withColumns(
        {
            "date": F.to_date(column),
            "month": F.month(column),
            "month_name": F.date_format(column, "MMMM"),
            "year": F.year(column),
            "hour": F.hour(column),
            "day_name": day_name(column),
        }
    )


def filter_airlines(df: DataFrame, airlines: list[str], column: str = "airline") -> DataFrame:
    return df.filter(F.col(column).isin(airlines))


def filter_terminal(df: DataFrame, terminal: str = "All") -> DataFrame:
    return df if terminal == "All" else df.filter(F.col("terminal") == terminal)


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Rows without any null."""
    return df.dropna("any")


def require_hour(df: DataFrame, column: str = "departure_hour") -> DataFrame:
    """Rows that have an hour, as INT."""
    return df.dropna(subset=[column]).withColumn(column, F.col(column).cast("int"))


def impute_median(df: DataFrame, column: str, default: float = 120.0) -> DataFrame:
    """Nulls of ``column`` become its exact median; an absent column becomes ``default``."""
    if column not in df.columns:
        return df.withColumn(column, F.lit(default))
    median = exact_quantiles(df, column, {"median": 0.5}).select("median").scalar()
    return df.withColumn(column, F.coalesce(F.col(column).cast("double"), median))


def with_default_columns(df: DataFrame) -> DataFrame:
    """hour, dow and carrier from the first alternative the table has, else a constant.

    hour: departure_hour, minutes in ``time``, 12. dow: day_of_week, dayofweek, 3.
    carrier: airline, airportfrom, null.
    """
    have = set(df.columns)
    alternatives = {
        "hour": [("departure_hour", F.col), ("time", hour_from_minutes)],
        "dow": [("day_of_week", F.col), ("dayofweek", F.col)],
        "carrier": [("airline", F.col), ("airportfrom", F.col)],
    }
    constants = {"hour": F.lit(12), "dow": F.lit(3), "carrier": F.lit(None).cast("string")}
    return df.withColumns(
        {
            target: next((f(name) for name, f in options if name in have), constants[target])
            for target, options in alternatives.items()
        }
    )


def prepare_bts(df: DataFrame, airlines: list[str] = PREPARED_AIRLINES) -> DataFrame:
    """Public flight records of the wanted carriers with day name and delayed flag."""
    return filter_airlines(df, airlines, "carrier").select(
        "carrier",
        "origin",
        "dest",
        "crsdeptime",
        "depdelay",
        "arrdelay",
        day_name("flightdate").alias("day_of_week"),
        is_delayed("depdelay").alias("delayed"),
    )


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order.

    A minimum over a struct combines on the map side, so a key held by a third of all rows
    still sends one row per map task; a ranking window would sort that key in one task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    ranked = [c for c in order if c not in keys]
    if not ranked and not rest:
        return df.dropDuplicates(keys)
    first = df.groupBy(*keys).agg(F.min(F.struct(*ranked, *rest)).alias("_first"))
    return first.select(
        *[F.col(c) if c in keys else F.col("_first")[c].alias(c) for c in df.columns]
    )


def table_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, null count, and the table's row count, in one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"_null_{i}") for i, c in enumerate(df.columns)],
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column_name"),
                F.col(f"_null_{i}").alias("null_count"),
            )
            for i, c in enumerate(df.columns)
        ]
    )
    return counts.select(
        F.col("_rows").alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.inline(entries),
    )


def schedule_flags(df: DataFrame) -> DataFrame:
    """departure_hour, day_of_week and date of a departure_time column."""
    return df.withColumns(
        {
            "departure_hour": F.hour("departure_time"),
            "day_of_week": day_short("departure_time"),
            "date": F.to_date("departure_time"),
        }
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
