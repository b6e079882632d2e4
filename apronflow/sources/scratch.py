"""Scratch tables: intermediate results written once and read back.

A written table cuts lineage, survives lost executors, and carries a known file size, so
Catalyst itself decides whether a join with it is a broadcast (below
``spark.sql.autoBroadcastJoinThreshold``) or a shuffle join. No join in this library forces a
broadcast of data that grows with the input.
"""

from __future__ import annotations

import tempfile
from functools import cache
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="apronflow-")


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting: a folder of one machine is useless on a
    cluster, so there the missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    return _local_folder()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_folder(spark)}/apronflow/{name}-{uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a scratch table and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def use_checkpoint_folder(spark: SparkSession) -> None:
    """Give the context a checkpoint folder (MLlib boosting cuts lineage with it)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_folder(spark))
