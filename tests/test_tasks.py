"""End to end: the three tasks on stand-in inputs written as parquet files."""

import os
import tempfile

from pyspark.sql import functions as F

from wattlane.plans.tasks import run_tasks
from wattlane.sources import standins as S
from wattlane.sources.tables import read_consumption, read_socioeconomic, read_weather

SF01 = "/root/testdata/sf0.1"


def test_run_tasks_end_to_end(spark):
    d = tempfile.mkdtemp(prefix="wattlane-tasks-")
    S.meter_hourly(spark, SF01).write.parquet(os.path.join(d, "consumption"))
    S.hourly_weather(spark, SF01).withColumn("relativehumidity", F.lit(50.0)) \
        .withColumn("totalprecipitation", F.lit(0.0)).withColumn("sunelevation", F.lit(10.0)) \
        .write.parquet(os.path.join(d, "weather"))
    S.socio_events(spark, SF01).write.parquet(os.path.join(d, "socio"))
    # buildings: households are residential; polygons carry the consumption keys as postal codes
    fp = S.footprint_buildings(spark, SF01).withColumn(
        "currentUse", F.when(F.col("currentUse") == "HOUSEHOLD", "1_residential").otherwise(F.col("currentUse")))
    codes = {"25001": "click", "25002": "view", "25003": "purchase", "25004": "signup"}
    code = F.col("CODPOS")
    for k, v in codes.items():
        code = F.when(F.col("CODPOS") == k, v).otherwise(code)
    polys = S.postal_polygons(spark).withColumn("CODPOS", code)
    written = run_tasks(
        spark, read_consumption(spark, os.path.join(d, "consumption")),
        read_weather(spark, os.path.join(d, "weather")), read_socioeconomic(spark, os.path.join(d, "socio")),
        fp, polys, os.path.join(d, "out"), postalcodes=["click"],
        holdout_rows=500)    # the stand-in covers one month: shorter than 20 x 96 rows + folds
    assert set(written) == {"prepared", "load_curves", "day_ahead", "forecast"}
    labels = spark.read.parquet(written["load_curves"]["labels"])
    assert labels.count() > 0 and labels.select("cluster").distinct().count() == 3
    acc = spark.read.parquet(written["day_ahead"]["accuracy"]).toPandas()
    assert set(acc.split) <= {"train", "test"} and acc.accuracy.between(0, 1).all()
    m = spark.read.parquet(written["forecast"]["decision_tree_metrics"]).first()
    assert m.n > 0 and m.rmse >= 0
    assert spark.read.parquet(written["forecast"]["decision_tree_grid"]).count() == 80
