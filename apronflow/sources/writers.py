"""Sinks. Formats are Spark's own; nothing is gathered on the driver to be written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apronflow.sources.schemas import HISTORY_TABLES


def write_clean(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Cleaned table as Parquet, ORC, JSON or CSV with header."""
    writer = df.write.mode(mode)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_sorted(df: DataFrame, path: str, key: str, fmt: str = "parquet") -> None:
    """Time-ordered table: ranges of ``key`` per file and sorted rows inside each file.

    The source partition is the second range key, so one time that holds very many rows is
    cut into several files instead of one.
    """
    ranged = df.withColumn("_source", F.spark_partition_id()).repartitionByRange(key, "_source")
    write_clean(ranged.sortWithinPartitions(key).drop("_source"), path, fmt)


def write_predictions(df: DataFrame, path: str) -> None:
    """Scored flights as CSV with header, for BI tools."""
    write_clean(df, path, "csv")


def write_star(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet folder per table; fact tables are partitioned by date."""
    for name, df in tables.items():
        if name.startswith("fact_"):
            # few files per date; adaptive execution merges small dates and splits large ones
            df.hint("rebalance", "date").write.mode("overwrite").partitionBy("date").parquet(
                f"{path}/{name}"
            )
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def _history_rows(df: DataFrame, table: str) -> DataFrame:
    """The declared columns in order; a null ``created_at`` fails the job."""
    schema = HISTORY_TABLES[table]
    present = set(df.columns)
    required = F.coalesce("created_at", F.raise_error(F.lit("created_at is required")).cast("timestamp"))
    df = df.withColumn("created_at", required)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def append_history(df: DataFrame, table: str, path: str) -> None:
    """Append rows to predictions, risk_events or forecast_runs in the declared column order.

    ``created_at`` is required: a null fails the job.
    """
    _history_rows(df, table).write.mode("append").parquet(path)


def replace_parts(df: DataFrame, part: str, path: str) -> None:
    """Replace the partitions that ``df`` holds and leave all others.

    Files are staged beside the table and moved in when the whole job has ended, so a job that fails
    half-way changes nothing and can be run again.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def load_history(df: DataFrame, table: str, path: str, batch: str) -> None:
    """Like ``append_history``, but a load that is repeated under the same ``batch`` name replaces its
    rows instead of adding them again. The table has a column ``batch``; a load without rows changes nothing.
    """
    replace_parts(_history_rows(df, table).withColumn("batch", F.lit(batch)), "batch", path)


def load_facts(df: DataFrame, path: str) -> None:
    """Facts of some dates: these dates are replaced as a whole, all others stay.

    Rows without a date go to a partition of their own.
    """
    replace_parts(df.hint("rebalance", "date"), "date", path)


def write_alerts(df: DataFrame, path: str) -> None:
    """Alerts as JSON lines."""
    df.write.mode("overwrite").json(path)
