"""Connected components of a link table by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apronflow.sources.scratch import materialize


def _smallest(links: DataFrame) -> DataFrame:
    """(a, b, m): each link from either end, with the smallest of a and its neighbours."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b: two different nodes); the label is the
    smallest node that can be reached.

    Each round hangs larger neighbours on the smallest (large star), then smaller ones (small
    star), and writes the links; it ends when every link goes to a root. Group sums are combined
    before the shuffle and hub rows are met by a join that Spark can split, so a hub with a third
    of all links is no single task. Links never outgrow their first number.
    """
    now = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(rounds):
        large = _smallest(now).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # now a > b: hang a and its other smaller neighbours on the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = materialize(small.filter("a <> b").distinct(), "links")
        # done when no node has two parents and no parent has a parent
        counts = now.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("a").alias("nodes")).first()
        if counts.n == counts.nodes and now.join(now.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            )
    raise RuntimeError(f"components not found within {rounds} rounds")
