"""Readers: declared schema in, normalised DataFrame out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from apronflow.functions.calendar import day_name
from apronflow.functions.columns import nan_to_null
from apronflow.functions.risk import delay_risk
from apronflow.operators.prepare import normalize_columns, parse_timestamp
from apronflow.sources.schemas import HISTORY_TABLES, RAW_TABLES


def nan_as_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes null, so means skip it."""
    return df.select(
        *[
            nan_to_null(f.name).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _csv_schema(header: list[str], schema: StructType) -> StructType:
    """Declared types for the columns a file has, in file order; other columns are text."""
    known = {f.name.lower(): f.dataType for f in schema.fields}
    ordered = StructType()
    for name in header:
        ordered.add(name, known.get(name.strip().lower(), "string"))
    return ordered


def read_table(spark: SparkSession, path: str, schema: StructType, fmt: str = "csv") -> DataFrame:
    """CSV (declared types matched by header name), Parquet, ORC or JSON lines.

    All CSV files of a path must have the same header: one whose columns differ in name or order fails the
    job, since its values would end up in other columns.
    """
    if fmt == "csv":
        header = spark.read.option("header", True).csv(path).columns
        checked = spark.read.option("header", True).option("enforceSchema", False)
        df = checked.schema(_csv_schema(header, schema)).csv(path)
    elif fmt == "json":
        df = spark.read.schema(schema).json(path)
    else:
        df = spark.read.format(fmt).load(path)
    return nan_as_null(normalize_columns(df))


def read_raw(spark: SparkSession, name: str, path: str, fmt: str = "csv") -> DataFrame:
    """One of the raw tables by name, see ``RAW_TABLES``."""
    return read_table(spark, path, RAW_TABLES[name], fmt)


def read_flights(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Flights with lenient timestamps, hour and day name of departure, and delay risk.

    The hour comes from the departure time (null where that cannot be parsed); only a table
    without any departure time keeps the hours it was written with.
    """
    raw = read_table(spark, path, RAW_TABLES["flights"], fmt)
    df = raw
    for name in ("departure_time", "arrival_time"):
        if name in df.columns:
            df = parse_timestamp(df, name)
    if "departure_time" in df.columns:
        hour = F.hour("departure_time")
        if "departure_hour" in df.columns:
            timed = raw.filter(F.col("departure_time").isNotNull()).limit(1)
            has_time = timed.select(F.count(F.lit(1)) > 0).scalar()
            hour = F.when(has_time, hour).otherwise(F.col("departure_hour"))
        df = df.withColumns({"departure_hour": hour, "departure_day": day_name("departure_time")})
    if "delay_minutes" in df.columns:
        df = df.withColumn("delay_risk", delay_risk("delay_minutes"))
    return df


def read_passenger_flow(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Passenger flow; the hour comes from the timestamp where the file has none."""
    df = read_table(spark, path, RAW_TABLES["passenger_flow"], fmt)
    if "timestamp" in df.columns:
        df = parse_timestamp(df, "timestamp")
        if "hour" not in df.columns:
            df = df.withColumn("hour", F.hour("timestamp"))
    return df


def read_history(spark: SparkSession, table: str, path: str) -> DataFrame:
    """A history table written by ``append_history``."""
    return spark.read.schema(HISTORY_TABLES[table]).parquet(path)
