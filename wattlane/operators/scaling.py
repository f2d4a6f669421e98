"""Column scaling of the profile matrix (M1-M4).

Statistics are fitted on all rows of the wide profile (incomplete days
included, missing cells ignored), like an estimator's ``fit``: one aggregate
job returns two numbers per column, which become literals of the transform.
Conventions follow the reference's scalers, not MLlib's:

* min-max: ``(x - min) / (max - min)``, a constant column gives 0;
* z-norm: ``(x - mean) / std_pop``, a constant column gives 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ("no_scaling", "min_max_scaling", "z_norm_scaling")


def fit_scaler(df: DataFrame, cols: Sequence[str], method: str) -> dict[str, tuple[float, float]]:
    """Per column (offset, scale) so that scaled = (x - offset) / scale."""
    if method == "no_scaling":
        return {}
    if method == "min_max_scaling":
        aggs = [e for c in cols for e in (F.min(F.col(f"`{c}`")).alias(f"lo_{c}"),
                                          F.max(F.col(f"`{c}`")).alias(f"hi_{c}"))]
        row = df.agg(*aggs).first()
        out = {}
        for c in cols:
            lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
            rng = None if lo is None else hi - lo
            out[c] = (lo, 1.0 if not rng else rng)
        return out
    if method == "z_norm_scaling":
        aggs = [e for c in cols for e in (F.avg(F.col(f"`{c}`")).alias(f"mu_{c}"),
                                          F.stddev_pop(F.col(f"`{c}`")).alias(f"sd_{c}"))]
        row = df.agg(*aggs).first()
        return {c: (row[f"mu_{c}"], 1.0 if not row[f"sd_{c}"] else row[f"sd_{c}"]) for c in cols}
    raise ValueError(f"unknown scaling method {method!r}; known: {', '.join(METHODS)}")


def apply_scaler(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({
        c: (F.col(f"`{c}`") - F.lit(off)) / F.lit(scale) for c, (off, scale) in params.items()})


def scale_data(df: DataFrame, cols: Sequence[str], method: str) -> DataFrame:
    """M1-M4: ``no_scaling`` | ``min_max_scaling`` | ``z_norm_scaling``."""
    return apply_scaler(df, fit_scaler(df, cols, method))
