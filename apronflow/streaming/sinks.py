"""Stream sources and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from apronflow.streaming.rules import gate_window_counts, overused_gates


def stream_files(
    spark: SparkSession, path: str, schema: StructType, per_batch: int = 100
) -> DataFrame:
    """New Parquet files of a folder (or glob), a bounded number per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def start_table(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append to a Parquet table; exactly once through the file sink's log."""
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_batches(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
    once: bool = False,
) -> StreamingQuery:
    """One folder per micro-batch, replaced as a whole when a batch is repeated."""

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = (
        stream.writeStream.foreachBatch(write)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_history(scored: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append scored rows to a history table, idempotent per batch."""
    return start_batches(scored, path, checkpoint, once=once)


def stream_gate_load(
    flights: DataFrame,
    path: str,
    checkpoint: str,
    factor: float = 2,
    window: str = "1 hour",
    lateness: str = "1 hour",
    once: bool = False,
) -> StreamingQuery:
    """Windowed gate counts in the stream, the ratio to the mean per finished batch."""
    counts = gate_window_counts(flights, window, lateness)
    return start_batches(counts, path, checkpoint, lambda batch: overused_gates(batch, factor), once)


def split_late(
    stream: DataFrame, time: str, path: str, checkpoint: str, lateness: str = "1 hour", once: bool = False
) -> StreamingQuery:
    """Rows behind the watermark in ``path/late`` (with the watermark they missed), all others in ``path/rows``.

    The watermark of a batch is the latest event time of all earlier batches minus ``lateness``, as in
    Spark's own operators, which drop such rows and only count them. Each batch writes the latest time so
    far to ``path/marks`` and reads that of the batch before, so a repeated batch or a restart from the
    checkpoint splits the same rows in the same way and every row is stored once. Rows without an event
    time are never late; before the first row nothing is.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = spark.createDataFrame([], "last TIMESTAMP")
        if batch_id:
            marks = spark.read.schema("last TIMESTAMP").parquet(f"{path}/marks/batch_id={batch_id - 1}")
        last = marks.select(F.max("last"))
        marked = batch.withColumn("watermark", last.scalar() - F.expr(f"INTERVAL {lateness}")).persist()
        try:
            late = F.coalesce(F.col(time) <= F.col("watermark"), F.lit(False))
            marked.filter(late).write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
            marked.filter(~late).drop("watermark").write.mode("overwrite").parquet(f"{path}/rows/batch_id={batch_id}")
            latest = marked.agg(F.max(time).cast("timestamp").alias("last")).unionByName(marks).agg(F.max("last").alias("last"))
            latest.write.mode("overwrite").parquet(f"{path}/marks/batch_id={batch_id}")
        finally:
            marked.unpersist()

    writer = stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def late_rows_dropped(query: StreamingQuery) -> int:
    """State rows that arrived behind the watermark, over the recent progress reports."""
    return sum(
        operator.numRowsDroppedByWatermark
        for progress in query.recentProgress
        for operator in progress.stateOperators
    )
