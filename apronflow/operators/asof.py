"""As-of joins: for each row the nearest row of another table before or after it.

Both tables are merged into one order and cut into range slices, so one key that holds a third of
all rows is spread over many tasks. A slice finds matches among its own rows; the nearest row of
the slices before it (one row per key and slice) is carried in. No pairs are built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apronflow.sources.scratch import materialize

_UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)
_BEFORE = (Window.unboundedPreceding, -1)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    on: list[str],
    values: list[str],
    name: str,
    forward: bool = False,
    strict: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """``left`` with a struct column ``name``: ``on`` and ``values`` of the nearest ``right`` row of
    the same ``by`` whose ``on`` (columns compared one after another) is at or before the row's own,
    or at or after it with ``forward``; ``strict`` excludes equal ``on``.

    Of right rows with equal ``by`` and ``on`` the one with the greatest ``values`` counts. Rows with
    a null in ``by`` or ``on`` match nothing: left ones stay with a null struct. Left rows are kept
    each, copies too; a column of ``left`` called ``name`` is replaced.
    """
    best = right.dropna(subset=[*by, *on]).groupBy(*by, *on).agg(F.max(F.struct(*values)).alias("_values"))
    found = F.struct(*on, *[F.col("_values")[v].alias(v) for v in values if v not in on])
    keys = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)] + [F.col(c).alias(f"_on{i}") for i, c in enumerate(on)]
    rows = left.drop(name)
    asking = rows.select(*keys, F.struct(*rows.columns).alias("_row"))
    known = best.select(*keys, found.alias("_found"))
    # equal keys: a row sees what is sorted before it
    asks_at = 0 if strict else 1
    merged = asking.withColumn("_side", F.lit(asks_at)).unionByName(
        known.withColumn("_side", F.lit(1 - asks_at)), allowMissingColumns=True
    )

    groups = [f"_by{i}" for i in range(len(by))]
    turn = F.desc if forward else F.asc
    order = [*[turn(f"_on{i}") for i in range(len(on))], F.asc("_side")]
    n = slices or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # left rows with equal keys have the same answer and may be cut anywhere
    tied = merged.withColumn("_tie", F.monotonically_increasing_id())
    cut = tied.repartitionByRange(n, *groups, *order, "_tie").drop("_tie")
    cut = materialize(cut.withColumn("_slice", F.spark_partition_id()), "asof")

    last = F.min if forward else F.max
    ends = cut.filter("_found IS NOT NULL").groupBy(*groups, "_slice").agg(last("_found").alias("_end"))
    # a slice of only left rows has no end of its own but takes over the one before
    parts = cut.select(*groups, "_slice").distinct().dropna().join(ends, [*groups, "_slice"], "left")
    earlier = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(*_BEFORE)
    carried = materialize(
        parts.select(*groups, "_slice", F.last("_end", ignorenulls=True).over(earlier).alias("_carried")).dropna(),
        "asof-ends",
    )
    inside = Window.partitionBy(*groups, "_slice").orderBy(*order).rowsBetween(*_UP_TO_HERE)
    near = cut.withColumn("_near", F.last("_found", ignorenulls=True).over(inside)).filter("_row IS NOT NULL")
    joined = near.join(carried, [*groups, "_slice"], "left")
    whole = F.lit(True)
    for i in range(len(on)):
        whole = whole & F.col(f"_on{i}").isNotNull()
    return joined.select("_row.*", F.when(whole, F.coalesce("_near", "_carried")).alias(name))
