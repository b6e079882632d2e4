"""One row per passenger and per bag from passenger counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apronflow.operators.ranking import prefix_sum

CHUNK = 10_000


def bag_status(identifier: Column | str) -> Column:
    """delivered, delayed or lost in the ratio 85 : 10 : 5, drawn from a hash of the id."""
    column = F.col(identifier) if isinstance(identifier, str) else identifier
    draw = F.pmod(F.conv(F.substring(F.md5(column), 1, 8), 16, 10).cast("long"), F.lit(100))
    return F.when(draw < 85, "delivered").when(draw < 95, "delayed").otherwise("lost")


def number_passengers(flow: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows (terminal, gate, timestamp, first, last): runs of passenger numbers, at most
    ``chunk`` long, covering 1..N in the order of timestamp, terminal and gate."""
    keys = ["timestamp", "terminal", "gate"]
    totals = (
        flow.filter("passenger_count > 0")
        .groupBy(*keys)
        .agg(F.sum("passenger_count").cast("long").alias("_count"))
    )
    numbered = prefix_sum(totals, keys, "_count", name="_before")
    starts = F.sequence(F.lit(0).cast("long"), F.col("_count") - 1, F.lit(chunk).cast("long"))
    runs = numbered.select("*", F.explode(starts).alias("_offset"))
    return runs.select(
        *keys,
        (F.col("_before") + F.col("_offset") + 1).alias("first"),
        (F.col("_before") + F.least(F.col("_offset") + chunk, F.col("_count"))).alias("last"),
    )


def expand_passengers(flow: DataFrame) -> DataFrame:
    """passenger_id, terminal, gate, timestamp: one row per counted passenger.

    Counts are summed per timestamp and gate, numbered by a two-phase running sum, cut into
    bounded runs and spread by hash before they are exploded, so one huge count is many tasks.
    """
    # a fixed number of partitions: runs are small before the explode, so sizes measured
    # there must not merge them into few tasks
    n = int(flow.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = number_passengers(flow).repartition(n, "first")
    people = runs.select("*", F.explode(F.sequence("first", "last")).alias("number"))
    digits = F.col("number").cast("string")
    padded = F.when(F.col("number") < 100_000, F.lpad(digits, 5, "0")).otherwise(digits)
    return people.select(F.concat(F.lit("P"), padded).alias("passenger_id"), "terminal", "gate", "timestamp")


def expand_baggage(passengers: DataFrame) -> DataFrame:
    """One bag per passenger with the same number and a reproducible status."""
    bag = F.concat(F.lit("B"), F.substring("passenger_id", 2, 18))
    return passengers.select(
        bag.alias("baggage_id"), "passenger_id", bag_status(bag).alias("status")
    )


def _id_key(identifier: Column | str) -> Column:
    """A number that orders ids (a letter and at most 17 digits) like their texts."""
    digits = F.substring(identifier, 2, 17)
    return F.rpad(digits, 17, "0").cast("long") * 32 + F.length(digits)


def _id_text(letter: str, key: Column) -> Column:
    digits = F.lpad(F.shiftright(key, 5).cast("string"), 17, "0")
    return F.concat(F.lit(letter), F.substring(digits, F.lit(1), (key % 32).cast("int")))


def first_id(identifier: Column | str, letter: str) -> Column:
    """The smallest id of a group. Over numbers, as hash aggregation needs: a minimum of texts sorts all rows."""
    return _id_text(letter, F.min(_id_key(identifier)))


def last_id(identifier: Column | str, letter: str) -> Column:
    """The largest id of a group, see ``first_id``."""
    return _id_text(letter, F.max(_id_key(identifier)))
