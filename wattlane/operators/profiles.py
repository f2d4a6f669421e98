"""Daily load profiles.

Long form: one row per (postalcode, bucket start hour, date) with the strict
bucket total and its share of the strict daily total.  Wide form: one row per
(postalcode, date), one column per bucket.

Plan shape: the strict daily total is a window over (postalcode, date); the
bucket aggregate groups by a superset of those keys, so Spark reuses the
window's hash partitioning and the whole long profile costs one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattlane.functions.calendar import bucket_start
from wattlane.functions.missing import strict_avg
from wattlane.functions.numeric import exact_avg


def bucket_hours(n_hours: int) -> list[int]:
    return list(range(0, 24, n_hours))


def strict_daily_total(df: DataFrame, value: str = "consumption_filtered",
                       keys: Sequence[str] = ("postalcode", "date"), scale: float = 24.0,
                       out: str = "daily_consumption") -> DataFrame:
    """A3: mean x 24 of the day broadcast to its rows; missing if any hour is missing."""
    w = Window.partitionBy(*keys)
    complete = F.count(F.lit(1)).over(w) == F.count(F.col(value)).over(w)
    return df.withColumn(out, F.when(complete, F.avg(F.col(value)).over(w) * F.lit(scale)))


def lenient_daily_total(df: DataFrame, value: str = "consumption_filtered",
                        keys: Sequence[str] = ("postalcode", "date"), scale: float = 24.0,
                        out: str = "daily_consumption") -> DataFrame:
    """Mean over present hours x 24, one row per day; the mean does not depend on row order."""
    present = df.where(F.col(keys[0]).isNotNull()) if keys else df
    for k in keys[1:]:
        present = present.where(F.col(k).isNotNull())
    return present.groupBy(*keys).agg((exact_avg(value) * F.lit(scale)).alias(out))


def profile_long(cleaned: DataFrame, n_hours: int = 3, value: str = "consumption_filtered",
                 key: str = "postalcode") -> DataFrame:
    """Long daily profile.

    Columns: postalcode, hour (bucket start), date, daily_consumption,
    consumption_filtered (bucket total), consumption (share of the day, %).
    A bucket with a missing hour is missing; the share is missing when the day
    is incomplete even if the bucket is complete.
    """
    # pandas groupby drops rows whose group key is missing
    rows = cleaned.select(key, "date", "hour", value).where(F.col(key).isNotNull() & F.col("date").isNotNull())
    df = strict_daily_total(rows, value=value, keys=(key, "date"))
    df = df.withColumn("hour", bucket_start("hour", n_hours))
    long = (df.groupBy(key, "hour", "date", "daily_consumption")
              .agg((strict_avg(value) * F.lit(n_hours)).alias("consumption_filtered")))
    share = F.try_divide(F.col("consumption_filtered") * F.lit(100.0), F.col("daily_consumption"))
    return long.withColumn("consumption", share)


def profile_wide(long: DataFrame, n_hours: int = 3, key: str = "postalcode",
                 value: str = "consumption") -> DataFrame:
    """A4, O3: pivot the share per bucket; days without any present share vanish.

    Bucket columns are named by their start hour ("0", "3", ...), in order.
    """
    hours = bucket_hours(n_hours)
    return (long.where(F.col(value).isNotNull())
                .groupBy(key, "date")
                .pivot("hour", hours)
                .agg(F.avg(value)))


def bucket_columns(n_hours: int = 3) -> list[str]:
    return [str(h) for h in bucket_hours(n_hours)]


def complete_days(wide: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows with every bucket present."""
    return wide.dropna(how="any", subset=list(cols) if cols else None)
