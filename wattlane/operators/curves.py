"""Tables behind the daily load-curve figure.

Hourly rows are joined to their lenient daily total and to the cluster
labels; the share of the day is then listed per day (A9), averaged per
(hour, cluster) (A10) and pivoted to one row per cluster (A11).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlane.operators.profiles import lenient_daily_total


def labelled_hours(cleaned: DataFrame, labels: DataFrame | None, key: str = "postalcode",
                   value: str = "consumption_filtered") -> DataFrame:
    """Hourly share of the lenient daily total, with cluster labels.

    Without labels every row is cluster 1.
    """
    rows = cleaned.drop("cluster").select(key, "date", "hour", "ts_utc", value)
    daily = lenient_daily_total(rows, value=value, keys=(key, "date"))
    df = (rows.join(daily, [key, "date"])
              .withColumn(value, F.try_divide(F.col(value) * F.lit(100.0), F.col("daily_consumption"))))
    if labels is not None:
        df = df.join(labels.select(key, "date", "cluster"), [key, "date"])
    if "cluster" not in df.columns:
        df = df.withColumn("cluster", F.lit(1))
    return df


def daily_curve_list(hours: DataFrame, key: str = "postalcode",
                     value: str = "consumption_filtered") -> DataFrame:
    """The day's values in time order, missing hours kept as NULL."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("ts_utc"), F.col(value).alias("v"))))
    return (hours.groupBy("date", key, "cluster")
                 .agg(F.transform(pairs, lambda s: s["v"]).alias(value)))


def centroids_long(hours: DataFrame, value: str = "consumption_filtered") -> DataFrame:
    """A10: mean per (hour, cluster), missing values ignored."""
    return hours.groupBy("hour", "cluster").agg(F.avg(value).alias(value))


def centroids_wide(hours: DataFrame, value: str = "consumption_filtered") -> DataFrame:
    """One row per cluster, one column per local hour 0..23."""
    return hours.groupBy("cluster").pivot("hour", list(range(24))).agg(F.avg(value))


def cluster_ids(hours: DataFrame) -> DataFrame:
    """A12."""
    return hours.select("cluster").distinct()
