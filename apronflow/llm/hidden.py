"""Keep an input's other columns out of an operator's way.

An operator sees the columns it uses by name; all others travel in one struct column, so none of its
inner names can clash with them, and none is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIDDEN = "__others"


def hide(df: DataFrame, *used: str) -> DataFrame:
    """The columns ``used``, and all others in the struct ``HIDDEN``."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in used]
    return df.select(*used, *([F.struct(*others).alias(HIDDEN)] if others else []))


def show(df: DataFrame, columns: list[str], used: tuple[str, ...], results: list[str]) -> DataFrame:
    """``columns`` of the hidden input in their order, then ``results``, which replace columns of that name."""
    kept = [c for c in columns if c not in results]
    return df.select(*[F.col(c) if c in used else F.col(f"{HIDDEN}.`{c}`").alias(c) for c in kept], *results)
