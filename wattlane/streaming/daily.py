"""A6 over a stream of hourly readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlane.functions.calendar import LOCAL_ZONE, utc_column
from wattlane.functions.numeric import exact_avg, round_half_even


def daily_consumption_stream(readings: DataFrame, key: str = "postalcode", time_col: str = "time",
                             value: str = "consumption_filtered", zone: str = LOCAL_ZONE,
                             lateness: str = "1 day") -> DataFrame:
    """Streaming daily consumption per key, one row per closed local day (append mode).

    Needs ``spark.sql.session.timeZone = UTC`` (as the batch operators' fast path).

    ``lateness`` is how late a reading may arrive and still count; state for
    a day is dropped once the watermark passes its end.
    """
    # event time must be TIMESTAMP: the local wall clock held as an instant
    # (UTC session), so 1-day windows start at local midnight
    df = (readings.withColumn("_local", F.from_utc_timestamp(utc_column(readings, time_col)
                                                             .cast("timestamp"), zone))
                  .where(F.col(key).isNotNull()))
    agg = (df.withWatermark("_local", lateness)
             .groupBy(F.window("_local", "1 day").alias("_day"), key)
             .agg(round_half_even(exact_avg(value) * F.lit(24), 2).alias("consumption")))
    return agg.select(F.to_date(F.col("_day.start").cast("timestamp_ntz")).alias("date"), key,
                      "consumption")
