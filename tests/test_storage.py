"""Contracts of the input tables, month folders and buckets."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from wattlane.operators.enrich import forecast_dataset
from wattlane.sources.storage import open_series, write_series
from wattlane.sources.tables import read_consumption, read_socioeconomic, read_weather


def _path(name):
    return os.path.join(tempfile.mkdtemp(prefix="wattlane-storage-"), name)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _hours(spark, n=24 * 75):
    t = F.expr("timestamp_ntz'2024-01-15 00:00:00' + make_dt_interval(0, CAST(id % 1800 AS INT))")
    return spark.range(2 * n).select(F.when(F.col("id") < n, "a").otherwise("b").alias("postalcode"), t.alias("time"),
                                     (F.col("id") % 17).cast("double").alias("consumption"), F.lit(3).alias("contracts"))


def test_contract_names_every_offending_column(spark):
    p = _path("t")
    _hours(spark).select(F.lit(5).alias("postalcode"), "time", F.lit("x").alias("consumption")).write.parquet(p)
    with pytest.raises(ValueError, match=r"consumption: postalcode is int, not string; consumption is string, not number; contracts is missing"):
        read_consumption(spark, p)
    with pytest.raises(ValueError, match="weather: .*airtemperature is missing"):
        read_weather(spark, p)
    with pytest.raises(ValueError, match="socioeconomic: .*year is missing"):
        read_socioeconomic(spark, p)


def test_extra_columns_and_nan(spark):
    p = _path("t")
    _hours(spark).withColumn("extra", F.lit(float("nan"))).write.parquet(p)
    got = read_consumption(spark, p)
    assert got.columns[-1] == "extra" and got.where("extra is null").count() == 3600


def test_months_are_pruned(spark):
    p = _path("s")
    hours = _hours(spark).unionByName(_hours(spark).limit(2).withColumn("time", F.lit(None).cast("timestamp_ntz")))
    stored = write_series(hours, p, time="time", keys=("postalcode", "time"), buckets=4)
    assert stored.count() == 3602 and stored.columns == hours.columns
    feb = read_consumption(spark, p, start="2024-02-01", end="2024-03-01 12:00:00")
    assert "_month" not in feb.columns
    assert feb.exceptAll(hours.where("time >= '2024-02-01' and time < '2024-03-01 12:00:00'")).count() == 0
    assert feb.count() == 2 * (29 * 24 + 12)
    assert "PartitionFilters: [isnotnull(_month" in _plan(feb) and ">= 202402" in _plan(feb) and "<= 202403" in _plan(feb)
    assert len(stored.inputFiles()) <= 4 * 4 + 4
    assert read_consumption(spark, p).count() == 3602
    plain = _path("plain")
    hours.write.parquet(plain)
    assert read_consumption(spark, plain, "2024-02-01", "2024-03-01 12:00:00").exceptAll(feb).count() == 0


def test_stored_tables_join_without_an_exchange(spark):
    hours = _hours(spark)
    series = hours.select("postalcode", F.col("time").alias("ts_utc"), F.col("time").alias("localtime"), F.hour("time").alias("hour"),
                          "contracts", F.col("consumption").alias("consumption_filtered"), "consumption")
    weather = hours.where("hour(time) % 2 = 0").select("postalcode", "time", F.lit(9.5).alias("airtemperature"))
    socio = spark.createDataFrame([("a", dt.date(2024, 1, 1), 5.0), ("b", dt.date(2024, 1, 1), 6.0)], "postalcode string, year date, income double")
    cad = spark.createDataFrame([("a", 10), ("b", 20)], "postalcode string, builtarea int")
    pc, pw = _path("c"), _path("w")
    a = write_series(series, pc, buckets=4)
    b = write_series(weather, pw, time="time", keys=("postalcode", "time"), buckets=4)
    again = open_series(spark, pc, buckets=4), open_series(spark, pw, keys=("postalcode", "time"), buckets=4)
    want = forecast_dataset(series, weather, socio, cad)
    cols, want = want.columns, want.collect()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for left, right in ((a, b), again):
            joined = forecast_dataset(left, right, socio, cad)
            plan = _plan(joined)
            assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
            assert sorted(map(str, joined.select(*cols).collect())) == sorted(map(str, want)) and len(want) == 1800
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_an_empty_table_is_stored(spark):
    p = _path("e")
    stored = write_series(_hours(spark).limit(0), p, time="time", keys=("postalcode", "time"), buckets=2)
    assert stored.count() == 0 and stored.columns == ["postalcode", "time", "consumption", "contracts"]
