"""Gate performance, pairing, load and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apronflow.functions.fixed_values import GATE_RECOMMENDATION, GATE_SUGGESTION, STANDING_SUGGESTIONS
from apronflow.functions.columns import text
from apronflow.operators.asof import asof_join
from apronflow.sources.scratch import materialize


def gate_performance(flights: DataFrame, clip: bool = True) -> DataFrame:
    """Flights, mean delay, utilization (percent of the busiest gate) and efficiency per gate.

    ``clip`` rounds to one decimal and keeps efficiency within 0..100. The busiest gate is a
    scalar subquery over the same aggregation: comparing whole structs keeps both uses of the
    aggregate identical, so its shuffle is planned once and reused.
    """
    gates = (
        flights.dropna(subset=["gate"])
        .groupBy("gate")
        .agg(F.count("flight_id").alias("flight_count"), F.avg("delay_minutes").alias("avg_delay"))
    )
    busiest = gates.select(F.max(F.struct("flight_count", "avg_delay")).getField("flight_count")).scalar()
    utilization = F.col("flight_count") / busiest * 100
    efficiency = 100 - F.col("avg_delay")
    if clip:
        utilization = F.bround(utilization, 1)
        bounded = F.least(F.greatest(efficiency, F.lit(0.0)), F.lit(100.0))
        # least and greatest skip nulls; a gate without delays has no efficiency
        efficiency = F.when(efficiency.isNotNull(), F.bround(bounded, 1))
    return gates.withColumns({"utilization": utilization, "efficiency": efficiency})


def gate_ranking(performance: DataFrame) -> DataFrame:
    """Best gate first; ties by gate name."""
    return performance.orderBy(F.desc("efficiency"), "gate")


def _top(performance: DataFrame, condition, k: int, best_first: bool, prefix: str) -> DataFrame:
    """The first k gates of a ranking, numbered; the window sees those k rows only."""
    direction = F.desc("efficiency") if best_first else F.asc("efficiency")
    chosen = performance.filter(condition).orderBy(direction, "gate").limit(k)
    position = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(direction, "gate"))
    return chosen.select(
        position.alias("position"),
        F.col("gate").alias(f"{prefix}_gate"),
        F.col("avg_delay").alias(f"{prefix}_delay"),
        F.col("efficiency").alias(f"{prefix}_efficiency"),
    )


def pair_gates(
    performance: DataFrame, k: int = 2, below: float = 60, above: float = 85, worst_first: bool = False
) -> DataFrame:
    """The i-th gate below one efficiency limit with the i-th gate above the other.

    Both lists run from high to low efficiency, so the "worst" gates are the least bad ones;
    ``worst_first`` starts with the truly worst.
    """
    worst = _top(performance, F.col("efficiency") < below, k, not worst_first, "worst")
    best = _top(performance, F.col("efficiency") > above, k, True, "best")
    return worst.join(best, "position")


def gate_suggestions(flights: DataFrame, worst_first: bool = False, limit: int = 5) -> DataFrame:
    """Reassignment suggestions from the data, then the standing ones."""
    pairs = pair_gates(gate_performance(flights), worst_first=worst_first)
    moves = pairs.select(
        F.col("position").alias("seq"),
        text(GATE_SUGGESTION["action"], F.col("worst_gate"), F.col("best_gate")).alias("action"),
        text(GATE_SUGGESTION["reason"], F.col("worst_gate"), F.bround("worst_delay", 1)).alias("reason"),
        text(GATE_SUGGESTION["impact"]).alias("impact"),
        F.when(F.col("worst_efficiency") < 50, "HIGH").otherwise("MEDIUM").alias("priority"),
    )
    standing = flights.sparkSession.createDataFrame(
        [(100 + i, *row) for i, row in enumerate(STANDING_SUGGESTIONS)],
        "seq INT, action STRING, reason STRING, impact STRING, priority STRING",
    )
    return moves.unionByName(standing).orderBy("seq").limit(limit)


def gate_recommendation(flights: DataFrame, worst_first: bool = False) -> DataFrame:
    """One move between the first gates of both lists, from unclipped efficiencies."""
    pair = pair_gates(gate_performance(flights, clip=False), 1, 60, 80, worst_first)
    return pair.select(
        text(GATE_RECOMMENDATION["action"], F.col("worst_gate"), F.col("best_gate")).alias("action"),
        text(GATE_RECOMMENDATION["reason"], F.col("worst_gate"), F.bround("worst_delay", 1)).alias("reason"),
        text(GATE_RECOMMENDATION["expected_improvement"]).alias("expected_improvement"),
    )


def gate_load(flights: DataFrame) -> DataFrame:
    """Largest and mean number of flights per gate, and the busiest gate (ties by name)."""
    counts = flights.dropna(subset=["gate"]).groupBy("gate").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.max("n").alias("max_flights"),
        F.avg("n").alias("avg_flights"),
        F.min_by("gate", F.struct(-F.col("n"), F.col("gate"))).alias("busiest_gate"),
    )


def conflict_slots(flights: DataFrame, minutes: int = 30) -> DataFrame:
    """Departures per gate and second, with the number of other departures within the window.

    Flights are counted per gate and second first, so a bucket as long as the window holds a
    bounded number of rows however many flights share the gate. A window around a second
    covers its own bucket, the end of the one before and the start of the one after; markers
    placed there read those parts off a running sum. Pairs are counted, never built.
    """
    width = minutes * 60
    slots = (
        flights.dropna(subset=["gate", "departure_time"])
        .groupBy("gate", F.unix_timestamp("departure_time").alias("second"))
        .agg(F.count(F.lit(1)).alias("departures"))
    )
    second, n = F.col("second"), F.col("departures")
    home = F.floor(second / width)
    none = F.lit(0).cast("long")
    points = F.array(
        *[
            F.struct(
                F.lit(side).alias("_side"),
                (home + side).alias("_bucket"),
                (second + side * width).alias("_at"),
                (n if side == 0 else none).alias("_n"),
            )
            for side in (-1, 0, 1)
        ]
    )
    placed = slots.select("gate", "second", "departures", F.inline(points))

    bucket = Window.partitionBy("gate", "_bucket")
    timeline = bucket.orderBy("_at")
    total = F.sum("_n").over(bucket)
    up_to = F.sum("_n").over(timeline.rangeBetween(Window.unboundedPreceding, 0))
    earlier = F.coalesce(F.sum("_n").over(timeline.rangeBetween(Window.unboundedPreceding, -1)), none)
    side = F.col("_side")
    parts = placed.withColumns({"_total": total, "_up_to": up_to, "_earlier": earlier}).select(
        "gate",
        "second",
        "departures",
        F.when(side < 0, F.col("_total") - F.col("_earlier"))
        .when(side == 0, F.col("_total"))
        .otherwise(F.col("_up_to"))
        .alias("_near"),
        F.when(side < 0, none)
        .when(side == 0, F.col("_total") - F.col("_up_to"))
        .otherwise(F.col("_up_to"))
        .alias("_ahead"),
    )
    near = parts.groupBy("gate", "second", "departures").agg(
        F.sum("_near").alias("_near"), F.sum("_ahead").alias("_ahead")
    )
    return near.select(
        "gate",
        "second",
        "departures",
        (F.col("_near") - 1).alias("others_within"),
        (F.floor(n * (n - 1) / 2) + n * F.col("_ahead")).cast("long").alias("pairs"),
    )


def gate_conflicts(flights: DataFrame, minutes: int = 30) -> DataFrame:
    """Flights that share their gate with another departure within the window.

    One row per flight with the number of other flights in conflict. The slot side of the join
    has one row per gate and second, so a crowded slot cannot multiply rows.
    """
    crowded = conflict_slots(flights, minutes).filter("others_within > 0")
    keyed = flights.withColumn("second", F.unix_timestamp("departure_time"))
    return keyed.join(crowded, ["gate", "second"]).select(
        "flight_id", "gate", "departure_time", "others_within"
    )


def gate_conflict_summary(flights: DataFrame, minutes: int = 30) -> DataFrame:
    """Flights, flights in conflict and conflicting pairs per gate."""
    return (
        conflict_slots(flights, minutes)
        .groupBy("gate")
        .agg(
            F.sum("departures").alias("flights"),
            F.sum(F.when(F.col("others_within") > 0, F.col("departures")).otherwise(0)).alias("in_conflict"),
            F.sum("pairs").alias("conflict_pairs"),
        )
    )


def nearest_conflicts(flights: DataFrame, minutes: int = 30, slices: int | None = None) -> DataFrame:
    """Flights in conflict with the nearest earlier and later conflicting flight of their gate.

    Flights of a gate are ordered by departure second, then ``flight_id``; the neighbours within the
    window are named with their distance in seconds, null where there is none. Rows without gate,
    departure or id are left out, and repeated rows of one flight count once.
    """
    keyed = (
        flights.dropna(subset=["gate", "departure_time", "flight_id"])
        .select("flight_id", "gate", "departure_time", F.unix_timestamp("departure_time").alias("second"))
        .dropDuplicates(["gate", "second", "flight_id"])
    )
    keyed = materialize(keyed, "departures")
    near = keyed
    for name, forward in (("earlier", False), ("later", True)):
        near = asof_join(
            near, keyed, ["gate"], ["second", "flight_id"], ["flight_id"], name, forward, strict=True, slices=slices
        )
    found = []
    for name in ("earlier", "later"):
        gap = F.abs(F.col("second") - F.col(f"{name}.second"))
        close = gap <= minutes * 60
        found.append(F.when(close, F.col(f"{name}.flight_id")).alias(f"{name}_flight"))
        found.append(F.when(close, gap).alias(f"{name}_seconds"))
    named = near.select("flight_id", "gate", "departure_time", *found)
    return named.filter("earlier_flight IS NOT NULL OR later_flight IS NOT NULL")
