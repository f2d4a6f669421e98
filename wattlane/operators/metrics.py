"""Evaluation tables.

The reference prints metrics and draws figures; here each is a DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlane.operators.rolling import series_index
from wattlane.operators.splits import BROADCAST_ROWS, key_hash_bucket
from wattlane.session import cut_lineage


def accuracy_by_split(pred: DataFrame, label: str = "cluster", prediction: str = "prediction",
                      split: str = "split") -> DataFrame:
    """Share of rows whose prediction equals the label, per split."""
    hit = (F.col(prediction) == F.col(label)).cast("double")
    return pred.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))


def regression_metrics(pred: DataFrame, label: str, prediction: str,
                       by: Sequence[str] = ()) -> DataFrame:
    """MSE, RMSE and CVRMSE = RMSE / mean(label)."""
    mse = F.avg(F.pow(F.col(label) - F.col(prediction), 2))
    g = pred.groupBy(*by) if by else pred
    out = g.agg(F.count(F.lit(1)).alias("n"), mse.alias("mse"), F.avg(label).alias("mean_y"))
    return (out.withColumn("rmse", F.sqrt("mse"))
               .withColumn("cvrmse", F.try_divide(F.col("rmse"), F.col("mean_y"))))


def forecast_slices(pred: DataFrame, postalcodes: Sequence[str], hours: int = 96, npred: int = 10,
                    seed: int = 42, key: str = "postalcode", order: str = "ts_utc",
                    materialize: bool = True) -> DataFrame:
    """``npred`` windows of ``hours`` consecutive rows per postal code.

    The start of window i is md5-hashed from (seed, postal code, i) into
    ``[0, len - hours]`` - repeatable, unlike ``random.randint``.  Series
    of at most ``hours`` rows give no windows.  Row positions come from
    :func:`series_index`, so no series is sorted in one task.  Rows of one
    instant are ordered by all other columns that can be ordered, so the windows
    do not depend on the order the rows arrive in.
    """
    rows = pred.where(F.col(key).isin(list(postalcodes)))
    if materialize:
        # read three times below (chunk counts, numbering, series lengths)
        rows = cut_lineage(rows)
    rest = [f.name for f in rows.schema.fields
            if f.name not in (key, order) and not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    rows = series_index(rows, [key], order, tiebreak=rest, out="row_idx")
    lens = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_len"))
    starts = (lens.where(F.col("_len") > F.lit(hours))
                  .withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(npred - 1))))
                  .withColumn("_start", F.pmod(
                      F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key),
                                                           F.col("slice").cast("string"))), 1, 8),
                             16, 10).cast("long"),
                      F.col("_len") - F.lit(hours) + F.lit(1)))
                  .drop("_len"))
    # one row per (listed postal code, slice): bounded by len(postalcodes) * npred
    if len(postalcodes) * npred <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    j = rows.join(starts, key)
    return (j.where((F.col("row_idx") >= F.col("_start"))
                    & (F.col("row_idx") < F.col("_start") + F.lit(hours)))
             .withColumn("offset", (F.col("row_idx") - F.col("_start")).cast("int"))
             .drop("_start"))


__all__ = ["accuracy_by_split", "regression_metrics", "forecast_slices", "key_hash_bucket"]
