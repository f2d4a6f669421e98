"""Daily aggregates (A5, A6, F9) and the cadaster summary.

pandas drops rows with a missing group key, sums of nothing are 0 and
``round(2)`` is half-to-even.  Means that get rounded are accumulated exactly
(fixed point), so a tie is decided the same way on every partitioning: ``where(key not null)``, ``coalesce(sum, 0)``
and numpy-style half-to-even rounding (``rint`` of the scaled value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlane.functions.calendar import LOCAL_ZONE, local_date, local_time, utc_column
from wattlane.functions.numeric import exact_avg, exact_sum, round_half_even

# Weather aggregation of the reference (column -> rule).
WEATHER_MEANS = ("airtemperature", "relativehumidity", "ghi", "sunelevation")
WEATHER_SUM24 = ("totalprecipitation",)


def weather_daily(weather: DataFrame, key: str = "postalcode", time_col: str = "time",
                  zone: str = LOCAL_ZONE) -> DataFrame:
    """A5: local-date weather: means, precipitation sum x 24, rounded to 2."""
    df = weather.withColumn("date", local_date(local_time(utc_column(weather, time_col), zone)))
    df = df.where(F.col(key).isNotNull() & F.col("date").isNotNull())
    aggs = {c: round_half_even(exact_avg(c), 2) for c in WEATHER_MEANS if c in df.columns}
    aggs.update({c: round_half_even(F.coalesce(exact_sum(c), F.lit(0.0)) * F.lit(24), 2)
                 for c in WEATHER_SUM24 if c in df.columns})
    order = [c for c in ("airtemperature", "relativehumidity", "totalprecipitation", "ghi",
                         "sunelevation") if c in aggs]
    return df.groupBy("date", key).agg(*[aggs[c].alias(c) for c in order])


def consumption_daily(cleaned: DataFrame, labels: DataFrame | None = None,
                      key: str = "postalcode", value: str = "consumption_filtered") -> DataFrame:
    """A6 + J4: lenient mean x 24 rounded to 2 as ``consumption``, labels left-joined."""
    df = cleaned.where(F.col(key).isNotNull() & F.col("date").isNotNull())
    daily = df.groupBy("date", key).agg(round_half_even(exact_avg(value) * F.lit(24), 2).alias("consumption"))
    if labels is not None:
        daily = daily.join(labels.select(key, "date", "cluster"), [key, "date"], "left")
    return daily


def daily_from_instants(rows: DataFrame, key: str = "postalcode", time_col: str = "time",
                        value: str = "consumption_filtered", zone: str = LOCAL_ZONE) -> DataFrame:
    """Local date for instant-stamped rows (input of :func:`consumption_daily`)."""
    return rows.withColumn("date", local_date(local_time(utc_column(rows, time_col), zone)))
