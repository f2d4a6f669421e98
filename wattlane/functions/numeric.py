"""Numeric expressions (F9): half-even rounding and order-free sums."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

#: Steps of the fine part of a split double, per unit.
FINE = float(2 ** 26)


def round_half_even(col: str | Column, digits: int = 2) -> Column:
    """pandas/numpy ``round(digits)``: scale, round half to even on the double, unscale.

    This is not ``bround``: ``bround`` rounds the decimal text of the double,
    so a value stored as 8298.67499999... rounds up there and down in pandas.
    """
    c = F.col(col) if isinstance(col, str) else col
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def exact_sum(col: str | Column, over: WindowSpec | None = None) -> Column:
    """Sum of doubles that does not depend on the order of the rows.

    A plain double sum changes in its last bits with the partitioning, which
    flips ties of a later rounding.  Each value is split without loss into a
    whole number, a whole number of 2^-26 steps, and a rest below one step.  The
    first two are whole-number doubles, whose sums are exact in any order up
    to 2^53 (beyond it they round like any double; nothing overflows); the sum
    of the rests only moves bits far below the result's last one.  All of it
    stays in whole-stage codegen.
    """
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    whole = F.rint(c)
    steps = (c - whole) * F.lit(FINE)
    fine = F.rint(steps)

    def total(x: Column) -> Column:
        return F.sum(x) if over is None else F.sum(x).over(over)

    return total(whole) + (total(fine) + total(steps - fine)) / F.lit(FINE)


def exact_avg(col: str | Column, over: WindowSpec | None = None) -> Column:
    """Mean of the present values by :func:`exact_sum`; NULL when there is none."""
    c = F.col(col) if isinstance(col, str) else col
    n = F.count(c) if over is None else F.count(c).over(over)
    return F.try_divide(exact_sum(c, over), n.cast("double"))
