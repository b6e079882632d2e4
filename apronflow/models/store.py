"""Models on shared storage, each with its metadata row and code tables."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def save_model(
    model: PipelineModel,
    path: str,
    metadata: DataFrame | None = None,
    dims: dict[str, DataFrame] | None = None,
) -> None:
    model.write().overwrite().save(f"{path}/model")
    if metadata is not None:
        metadata.write.mode("overwrite").json(f"{path}/metadata")
    for name, dim in (dims or {}).items():
        dim.write.mode("overwrite").parquet(f"{path}/codes/{name}")


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(f"{path}/metadata")


def load_dims(spark: SparkSession, path: str, columns: list[str]) -> dict[str, DataFrame]:
    return {c: spark.read.parquet(f"{path}/codes/{c}") for c in columns}
