"""Calendar expressions: hours, peaks, nights, weekends, day names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from apronflow.functions.columns import as_column, flag
from apronflow.functions.fixed_values import (
    DAYS,
    NIGHT_AFTER,
    NIGHT_BEFORE,
    PEAK_HOURS,
    WEEKEND_NAMES,
)


def hour_from_minutes(minutes: Column | str) -> Column:
    """Hour of day of a minute-of-day number; values outside a day wrap around."""
    return F.pmod(F.floor(as_column(minutes) / 60), F.lit(24)).cast("int")


def is_peak(hour: Column | str, peaks: list[tuple[int, int]] = PEAK_HOURS) -> Column:
    """1 inside one of the closed hour ranges."""
    hour = as_column(hour)
    hit = F.lit(False)
    for first, last in peaks:
        hit = hit | hour.between(first, last)
    return flag(hit)


def is_night(hour: Column | str) -> Column:
    hour = as_column(hour)
    return flag((hour < NIGHT_BEFORE) | (hour > NIGHT_AFTER))


def is_weekend_name(day: Column | str) -> Column:
    """Weekend test on full English day names."""
    return flag(as_column(day).isin(WEEKEND_NAMES))


def is_weekend_number(day: Column | str) -> Column:
    """Weekend test on day numbers, Monday = 0."""
    return flag(as_column(day).isin(5, 6))


def is_weekend_time(when: Column | str) -> Column:
    return flag(F.weekday(as_column(when)) >= 5)


def day_name(when: Column | str) -> Column:
    return F.date_format(as_column(when), "EEEE")


def day_short(when: Column | str) -> Column:
    """Mon..Sun."""
    return F.date_format(as_column(when), "EEE")


def day_position(day: Column | str) -> Column:
    """0 for Mon .. 6 for Sun; null for other texts."""
    position = F.array_position(F.array(*[F.lit(d) for d in DAYS]), as_column(day)) - 1
    return F.when(position >= 0, position).cast("int")
