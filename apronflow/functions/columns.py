"""Small Column helpers shared by the rule modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def lookup(key: Column | str, table: dict, default) -> Column:
    """Value of a fixed table for ``key``; unknown and null keys get ``default``.

    The table is a literal inside the expression, so no join and no shuffle is planned.
    """
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(literal, as_column(key)), F.lit(default))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or null."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def nan_to_null(value: Column | str) -> Column:
    value = as_column(value)
    return F.when(~F.isnan(value), value)


def text(pattern: str, *args: Column) -> Column:
    """printf text; patterns without arguments are kept literally (they may contain ``%``)."""
    return F.format_string(pattern, *args) if args else F.lit(pattern)
