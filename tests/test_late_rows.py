"""Late rows are stored apart, once, also when a batch is repeated or the stream restarts."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException

from apronflow.streaming import sinks

SCHEMA = "id INT, at TIMESTAMP"
DAY = dt.datetime(2024, 1, 1)
# (id, hours): the watermark of a file is the latest hour of the files before, minus two
FILES = [[(1, 5), (2, 1), (3, None)], [(4, 3), (5, 4), (6, 9), (7, 2)], [(8, 7), (9, 8), (10, 3)], [(11, 20), (12, None), (13, 7)], [(14, 18), (15, 19)]]
LATE = {4: 3, 7: 3, 8: 7, 10: 7, 13: 7, 14: 18}


def add(spark, folder, n):
    rows = [(i, None if h is None else DAY + dt.timedelta(hours=h)) for i, h in FILES[n]]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/part={n}")


def run(spark, folder):
    stream = sinks.stream_files(spark, f"{folder}/in/*", spark.createDataFrame([], SCHEMA).schema, 1)
    sinks.split_late(stream, "at", f"{folder}/out", f"{folder}/state", "2 hours", once=True).awaitTermination()


def stored(spark, folder):
    late = spark.read.schema(SCHEMA + ", watermark TIMESTAMP").parquet(f"{folder}/out/late").collect()
    rows = spark.read.schema(SCHEMA).parquet(f"{folder}/out/rows").collect()
    return sorted((r.id, (r.watermark - DAY) // dt.timedelta(hours=1)) for r in late), sorted(r.id for r in rows)


def test_late_rows_over_restarts(spark, tmp_path):
    folder = str(tmp_path)
    for n in range(2):
        add(spark, folder, n)
    run(spark, folder)
    assert stored(spark, folder) == ([(4, 3), (7, 3)], [1, 2, 3, 5, 6])
    for n in range(2, 5):
        add(spark, folder, n)
        run(spark, folder)
    late, rows = stored(spark, folder)
    assert dict(late) == LATE and len(late) == len(LATE)
    assert rows == sorted({i for f in FILES for i, _ in f} - set(LATE))


def test_a_batch_that_failed_half_way_is_repeated(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    for n in range(4):
        add(spark, folder, n)
    from pyspark.sql.readwriter import DataFrameWriter

    parquet, failed = DataFrameWriter.parquet, []

    def failing(self, path, *a, **k):
        # after the late rows of the third file are stored, and before its other rows are
        if path.endswith("rows/batch_id=2") and not failed:
            failed.append(path)
            raise RuntimeError("lost")
        return parquet(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", failing)
    with pytest.raises(StreamingQueryException):
        run(spark, folder)
    run(spark, folder)
    late, rows = stored(spark, folder)
    assert failed and dict(late) == {i: w for i, w in LATE.items() if i < 14} and len(late) == 5
    assert rows == sorted({i for f in FILES[:4] for i, _ in f} - set(LATE))
