"""Missing-value rules as aggregate expressions.

pandas drops missing values in ``mean`` but the reference also has a strict
rule ("any missing input -> missing result").  Both are plain aggregate
expressions here, usable in ``groupBy().agg`` and over windows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strict_avg(col: str | Column) -> Column:
    """A1: mean, or NULL when any input row is missing."""
    c = _c(col)
    return F.when(F.count(F.lit(1)) == F.count(c), F.avg(c))


def sum_or_zero(col: str | Column) -> Column:
    """pandas ``sum`` of nothing is 0."""
    return F.coalesce(F.sum(_c(col)), F.lit(0))
