"""Centred rolling statistics per series (W1-W5) and the outlier mask.

pandas ``groupby(key).rolling(w, min_periods, center=True)`` frames count
**rows**, not hours.  In Spark that is a ``rowsBetween`` frame ordered by the
UTC instant.  A plain ``Window.partitionBy(key)`` would put a whole series in
one task; one postal code may hold a third of all rows, so by default the
series is cut into blocks of ``block_rows`` consecutive rows and each block
gets the few neighbouring rows its frames reach into (a halo).  The result is
exactly the unsplit one:

1. a small ``groupBy(key, chunk)`` count over coarse time chunks and a running
   sum over that small table give every chunk its row offset;
2. ``row_number`` inside (key, chunk) gives every row its global row index;
3. rows near a block border are copied to the neighbouring block, the frames
   are evaluated per (key, block), and only each block's own rows are kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattlane.functions.numeric import exact_avg


@dataclass(frozen=True)
class RollingSpec:
    """One rolling statistic with pandas ``rolling`` semantics."""

    name: str
    stat: str                 # 'mean' | 'std' | 'quantile'
    window: int
    min_periods: int
    center: bool = True
    q: float | None = None
    interpolation: str = "linear"   # quantile only: 'linear' | 'nearest'

    def bounds(self) -> tuple[int, int]:
        """(rows before, rows after) covered by the frame."""
        if not self.center:
            return self.window - 1, 0
        following = (self.window - 1) // 2
        return self.window - 1 - following, following


def interpolated(values: Column, q: float) -> Column:
    """Linearly interpolated quantile of an ascending array (pandas ``quantile``)."""
    at = F.lit(q) * (F.size(values) - 1)
    low = F.floor(at).cast("int")
    below = F.get(values, low)
    above = F.get(values, F.least(low + 1, F.size(values) - 1))
    return below + (above - below) * (at - low)


def nearest(values: Column, q: float) -> Column:
    """Element of an ascending array at round-half-even(q * (n - 1))."""
    return F.get(values, F.bround(F.lit(q) * (F.size(values) - 1), 0).cast("int"))


def _stat_expr(spec: RollingSpec, value: Column, w) -> Column:
    if spec.stat == "mean":
        stat = exact_avg(value, w)
    elif spec.stat == "std":
        stat = F.stddev_samp(value).over(w)
    elif spec.stat == "quantile":
        if spec.q is None:
            raise ValueError("quantile spec needs q")
        if spec.interpolation not in ("linear", "nearest"):
            raise ValueError(f"unknown interpolation {spec.interpolation!r}")
        pick = interpolated if spec.interpolation == "linear" else nearest
        # the frame's values are sorted once per row, in a one-element array for the lambda
        frame = F.array(F.sort_array(F.collect_list(value).over(w)))
        stat = F.get(F.transform(frame, lambda v: pick(v, spec.q)), 0)
    else:
        raise ValueError(f"unknown rolling stat {spec.stat!r}")
    return F.when(F.count(value).over(w) >= F.lit(spec.min_periods), stat)


def _keys_present(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def _day_chunk(order_col: str, chunk_days: int) -> Column:
    days = F.datediff(F.to_date(F.col(order_col)), F.lit("1970-01-01").cast("date"))
    return F.floor(days / F.lit(chunk_days))


def series_index(df: DataFrame, keys: Sequence[str], order: str, tiebreak: Sequence[str] = (),
                 out: str = "row_idx", chunk_days: int = 28) -> DataFrame:
    """0-based position of every row inside its series (keys), in ``order``.

    Equivalent to ``row_number() over (partition by keys order by order) - 1``
    but never sorts a whole series in one task: rows are numbered inside
    (key, time chunk) and shifted by the running count of earlier chunks,
    taken from a small per-chunk count table.
    """
    keys = list(keys)
    d = df.withColumn("_chunk", _day_chunk(order, chunk_days))
    counts = d.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    w_prev = (Window.partitionBy(*keys).orderBy("_chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*[F.col(k).alias(f"_o_{k}") for k in keys],
                            F.col("_chunk").alias("_o_chunk"),
                            F.coalesce(F.sum("_n").over(w_prev), F.lit(0)).alias("_off"))
    cond = [d[k].eqNullSafe(offsets[f"_o_{k}"]) for k in keys] + [d["_chunk"] == offsets["_o_chunk"]]
    d = d.join(offsets, cond, "inner").drop(*[f"_o_{k}" for k in keys], "_o_chunk")
    w_rn = Window.partitionBy(*keys, "_chunk").orderBy(order, *tiebreak)
    return (d.withColumn(out, F.col("_off") + F.row_number().over(w_rn) - F.lit(1))
             .drop("_chunk", "_off"))


def rolling(df: DataFrame, value: str, specs: Sequence[RollingSpec],
            keys: Sequence[str] = ("postalcode",), order: str = "ts_utc",
            tiebreak: Sequence[str] = (), split: bool = True,
            block_rows: int = 4096, chunk_days: int = 28) -> DataFrame:
    """Add one column per spec.

    Rows whose key is missing keep their place and get missing statistics
    (pandas drops them from the grouped rolling and re-aligns by index).
    ``order`` must be a date/timestamp column when ``split`` is on.

    All statistics are Spark window functions over one frame each; a quantile
    sorts the frame's values (at most ``window`` of them) and interpolates.
    Rows with equal ``order`` are ordered by ``tiebreak``; what is equal in both
    has no defined order.
    """
    keys = list(keys)
    order_cols = [order, *tiebreak]
    value_c = F.col(value)
    if not split:
        base = Window.partitionBy(*keys).orderBy(*order_cols)
        present = _keys_present(keys)
        return df.withColumns({
            s.name: F.when(present, _stat_expr(s, value_c, base.rowsBetween(-s.bounds()[0], s.bounds()[1])))
            for s in specs})

    pre = max(s.bounds()[0] for s in specs)
    fol = max(s.bounds()[1] for s in specs)
    block = max(block_rows, pre + 1, fol + 1)

    helper = ["_idx", "_blk", "_pos", "_tgt", "_core"]
    # 1-2. global row index inside the series, without a per-series task
    d = series_index(df, keys, order, tiebreak, out="_idx", chunk_days=chunk_days)

    # 3. block and halo copies: a row is also needed by the previous block when
    #    it is among the first `fol` rows of its block, and by the next block
    #    when it is among the last `pre` rows.
    d = (d.withColumn("_blk", F.floor(F.col("_idx") / F.lit(block)))
          .withColumn("_pos", F.col("_idx") - F.col("_blk") * F.lit(block)))
    targets = F.array(
        F.struct(F.col("_blk").alias("b"), F.lit(True).alias("core")),
        F.when(F.col("_pos") < F.lit(fol),
               F.struct((F.col("_blk") - 1).alias("b"), F.lit(False).alias("core"))),
        F.when(F.col("_pos") >= F.lit(block - pre),
               F.struct((F.col("_blk") + 1).alias("b"), F.lit(False).alias("core"))),
    )
    d = (d.withColumn("_tgt", F.explode(F.filter(targets, lambda t: t.isNotNull())))
          .withColumn("_blk", F.col("_tgt.b"))
          .withColumn("_core", F.col("_tgt.core")))

    present = _keys_present(keys)
    base = Window.partitionBy(*keys, "_blk").orderBy("_idx")
    out = d.drop("_pos", "_tgt").withColumns({
        s.name: _stat_expr(s, value_c, base.rowsBetween(-s.bounds()[0], s.bounds()[1]))
        for s in specs})
    out = out.withColumns({s.name: F.when(present, F.col(s.name)) for s in specs})
    return out.where(F.col("_core")).drop(*[h for h in helper if h in out.columns])


# The cleaning parameters of the reference pipeline.
CLEANING_SPECS = (
    RollingSpec("rolling_mean", "mean", window=48, min_periods=4),
    RollingSpec("rolling_std", "std", window=48, min_periods=4),
    RollingSpec("rolling_q10", "quantile", window=168, min_periods=24, q=0.1),
)
MAX_Z = 4.0
MIN_Z = -2.0
Q10_FACTOR = 0.7


def normalize_z(df: DataFrame, value: str = "consumption", mean: str = "rolling_mean",
                std: str = "rolling_std", out: str = "z_norm") -> DataFrame:
    """``(x - mean) / std``; a zero std gives NULL (pandas: inf/NaN)."""
    return df.withColumn(out, F.try_divide(F.col(value) - F.col(mean), F.col(std)))


def filter_extreme_values(df: DataFrame, value: str = "consumption", z: str = "z_norm",
                          q10: str = "rolling_q10", max_threshold: float = MAX_Z,
                          min_threshold: float = MIN_Z, q_factor: float = Q10_FACTOR,
                          out: str = "consumption_filtered") -> DataFrame:
    """Keep the value when ``min < z < max`` and ``x > q_factor * q10``, else missing."""
    cond = ((F.col(z) < F.lit(max_threshold)) & (F.col(z) > F.lit(min_threshold))
            & (F.col(value) > F.col(q10) * F.lit(q_factor)))
    return df.withColumn(out, F.when(cond, F.col(value)))


def clean_series(consumption: DataFrame, value: str = "consumption",
                 keys: Sequence[str] = ("postalcode",), time_col: str = "time",
                 zone: str = "Europe/Madrid", specs: Sequence[RollingSpec] = CLEANING_SPECS,
                 max_threshold: float = MAX_Z, min_threshold: float = MIN_Z,
                 q_factor: float = Q10_FACTOR, split: bool = True,
                 block_rows: int = 4096, tiebreak: Sequence[str] | None = None) -> DataFrame:
    """Local calendar, rolling stats, z-score and outlier mask in one window stage.

    Readings of the same instant are ordered by ``tiebreak``, by default by every
    other column that can be ordered, so the result does not depend on the order
    the rows arrive in.

    Adds ``ts_utc, localtime, hour, date, rolling_mean, rolling_std,
    rolling_q10, z_norm, consumption_filtered``.
    """
    from wattlane.functions.calendar import with_local_calendar
    from wattlane.sources.tables import nan_to_null

    if tiebreak is None:
        rest = [f for f in consumption.schema.fields if f.name not in (*keys, time_col)]
        tiebreak = [f.name for f in rest if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    df = with_local_calendar(nan_to_null(consumption, [value]), time_col, zone)
    df = rolling(df, value, specs, keys=keys, order="ts_utc", tiebreak=tiebreak, split=split, block_rows=block_rows)
    df = normalize_z(df, value=value)
    return filter_extreme_values(df, value=value, max_threshold=max_threshold,
                                 min_threshold=min_threshold, q_factor=q_factor)
