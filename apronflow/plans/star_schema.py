"""BI star schema: two facts, four dimensions, three summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apronflow.operators.dimensions import dim_airlines, dim_dates, dim_terminals, dim_weather
from apronflow.operators.kpis import airline_summary, daily_summary, terminal_summary
from apronflow.operators.prepare import union_all
from apronflow.sources.scratch import materialize
from apronflow.sources.writers import write_star


def fact_flights(flights: DataFrame) -> DataFrame:
    return flights.select(
        "flight_id", "airline", "terminal", "weather", "day_of_week", "departure_time",
        "arrival_time", "delay_minutes", "delay_risk", "departure_hour", "is_peak_hour",
        "is_weekend", "date",
    )


def fact_passengers(flow: DataFrame) -> DataFrame:
    return flow.select("timestamp", "terminal", "gate", "passenger_count", "congestion", "hour", "date")


def star_tables(flights: DataFrame, flow: DataFrame, order: str = "seq") -> dict[str, DataFrame]:
    """All nine tables. Inputs carry ``date`` columns (see ``add_calendar``)."""
    return {
        "fact_flights": fact_flights(flights),
        "fact_passengers": fact_passengers(flow),
        "dim_airlines": dim_airlines(flights, order),
        "dim_terminals": dim_terminals(flights, order),
        "dim_weather": dim_weather(flights, order),
        "dim_dates": dim_dates(flights),
        "summary_daily": daily_summary(flights),
        "summary_airline": airline_summary(flights),
        "summary_terminal": terminal_summary(flights, flow),
    }


def build_star(
    flights: DataFrame, flow: DataFrame, path: str, order: str = "seq", parse_once: bool = False
) -> None:
    """Write the star schema.

    Every table reads only its own columns, which Parquet and ORC input serve directly.
    ``parse_once`` first copies the inputs to scratch Parquet; use it for CSV and JSON, which
    would otherwise be parsed for each of the nine tables.
    """
    if parse_once:
        flights, flow = materialize(flights, "flights"), materialize(flow, "flow")
    write_star(star_tables(flights, flow, order), path)


def count_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per star table, as one job."""
    return union_all(
        [
            df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
            for name, df in tables.items()
        ]
    )
