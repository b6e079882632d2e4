"""Positions and running totals over whole tables without a single-task window.

A window without (or with a dominant) partition key sorts everything in one task. Here rows
are cut into sorted slices by range partitioning, each slice sums its own rows, and the slice
totals (one row per slice and key) give every slice its starting value. The slices are written
before use: range bounds come from a sample, so both uses must see the same cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apronflow.sources.scratch import materialize

_BEFORE = (Window.unboundedPreceding, -1)

# rows one task may sort: about the size of one shuffle partition
SMALL_ROWS = 1_000_000

DIGEST_LENGTH = 32


def prefix_sum(
    df: DataFrame,
    order: list[str],
    weight: str,
    by: list[str] | None = None,
    name: str = "before",
    small: int = SMALL_ROWS,
    total: str | None = None,
) -> DataFrame:
    """Sum of ``weight`` over the earlier rows of the same ``by`` group; ``total`` optionally
    names a column with the group's whole sum.

    ``by`` (without nulls) and ``order`` together must identify a row: aggregate copies first,
    so that a value held by a third of all rows is one row here. The input is written and
    counted; up to ``small`` rows a plain window is exact and bounded, beyond that slices are
    used.
    """
    by = by or []
    rows = materialize(df, "rows")
    if rows.count() <= small:
        group = Window.partitionBy(*(by or [F.lit(0)]))
        before = F.sum(weight).over(group.orderBy(*order).rowsBetween(*_BEFORE))
        columns = {name: F.coalesce(before, F.lit(0))}
        if total:
            columns[total] = F.sum(weight).over(group)
        return rows.withColumns(columns)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.repartitionByRange(n, *by, *order)
    slices = materialize(ranges.withColumn("_slice", F.spark_partition_id()), "slices")

    keys = [*by, "_slice"]
    totals = slices.groupBy(*keys).agg(F.sum(weight).alias("_total"))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    starts = totals.select(
        *keys,
        F.sum("_total").over(group.orderBy("_slice").rowsBetween(*_BEFORE)).alias("_start"),
        F.sum("_total").over(group).alias("_all"),
    )

    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*_BEFORE)
    before = F.coalesce("_start", F.lit(0)) + F.coalesce(F.sum(weight).over(inside), F.lit(0))
    extra = [F.col("_all").alias(total)] if total else []
    return slices.join(starts, keys).select(*df.columns, before.alias(name), *extra)


def number_rows(
    df: DataFrame, order: list[str], name: str, start: int = 1, small: int = SMALL_ROWS
) -> DataFrame:
    """Consecutive numbers over the whole table in ``order`` (unique)."""
    weighted = df.withColumn("_one", F.lit(1).cast("long"))
    numbered = prefix_sum(weighted, order, "_one", name=name, small=small)
    return numbered.drop("_one").withColumn(name, (F.col(name) + start).cast("int"))


def id_digest(identifier: Column | str, seed: int = 42) -> Column:
    """md5 text of the id: uniform, and the same on every run and every engine.

    Hex texts of one length sort like the numbers they write, so no conversion is needed.
    """
    column = F.col(identifier) if isinstance(identifier, str) else identifier
    return F.md5(F.concat(column.cast("string"), F.lit(f"-{seed}")))


def id_number(identifier: Column | str, seed: int = 42) -> Column:
    """The first 60 bits of ``id_digest`` as a number."""
    return F.conv(F.substring(id_digest(identifier, seed), 1, 15), 16, 10).cast("long")


def smallest_share(
    df: DataFrame, label: str, digest: str, share: float, small: int = SMALL_ROWS
) -> DataFrame:
    """Per label, the digest up to which exactly ``share`` of its rows lie.

    The k-th smallest digest is found prefix by prefix: each step counts rows per label and
    prefix (map-side combined, at most 16**4 new prefixes per label) and keeps the prefix that
    holds the k-th row. Once that prefix holds few rows their digests are compared directly.
    The table itself is only scanned, never sorted or moved.
    """
    of_label = Window.partitionBy(label)
    known = df.dropna(subset=[label]).select(label, F.col(digest).alias("_digest"))
    length, parent, found = 4, None, None
    while True:
        slots = known.withColumn("_slot", F.substring("_digest", 1, length))
        if found is None:
            counts = slots.groupBy(label, "_slot").agg(F.count(F.lit(1)).alias("_n"))
            counts = counts.withColumn("k", F.bround(F.sum("_n").over(of_label) * share).cast("long"))
        else:
            inside = slots.withColumn("slot", F.substring("_digest", 1, parent)).join(found, [label, "slot"])
            counts = inside.groupBy(label, "k", "_slot").agg(F.count(F.lit(1)).alias("_n"))
        earlier = F.sum("_n").over(of_label.orderBy("_slot").rowsBetween(*_BEFORE))
        rest = F.col("k") - F.col("_earlier")
        kept = materialize(
            counts.withColumn("_earlier", F.coalesce(earlier, F.lit(0)))
            .filter((rest > 0) & (rest <= F.col("_n")))
            .select(label, rest.alias("k"), F.col("_slot").alias("slot"), "_n"),
            "share",
        )
        if length == DIGEST_LENGTH:
            return kept.select(label, F.col("slot").alias("cutoff"))
        largest = kept.agg(F.max("_n")).first()[0] or 0
        found, parent = kept.drop("_n"), length
        length = DIGEST_LENGTH if largest <= small else min(length + 4, DIGEST_LENGTH)
