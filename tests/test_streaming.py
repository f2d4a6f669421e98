"""The streaming daily aggregate equals the batch one on the same readings."""

import os
import tempfile

from pyspark.sql import functions as F

from wattlane.operators.daily import consumption_daily
from wattlane.operators.rolling import clean_series
from wattlane.sources.standins import meter_hourly
from wattlane.streaming import daily_consumption_stream

from .conftest import SF001


def test_stream_matches_batch(spark):
    cleaned = clean_series(meter_hourly(spark, SF001)).select("postalcode", "time", "date",
                                                               "consumption_filtered")
    src = tempfile.mkdtemp(prefix="wattlane-stream-src-")
    cleaned.drop("date").repartition(4).write.mode("overwrite").parquet(os.path.join(src, "in"))
    stream = spark.readStream.schema(cleaned.drop("date").schema).parquet(os.path.join(src, "in"))
    q = (daily_consumption_stream(stream, lateness="100000 days").writeStream.outputMode("update")
         .format("memory").queryName("daily_stream_test")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="wattlane-stream-ckpt-")).start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT date, postalcode, consumption AS c FROM daily_stream_test")
    want = consumption_daily(cleaned)
    assert got.count() == want.count()
    j = want.join(got, ["date", "postalcode"], "full_outer")
    assert j.where(~F.col("c").eqNullSafe(F.col("consumption"))).count() == 0
