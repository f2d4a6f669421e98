"""Source cleaners and calendar helpers."""

import datetime as dt

import pandas as pd

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattlane.functions.calendar import bucket_start, weekday_iso_text, weekday_monday0, year_of
from wattlane.functions.numeric import exact_avg, round_half_even
from wattlane.sources.tables import nan_to_null, text_nan_to_null


def test_nan_becomes_null_and_text_sentinel(spark):
    df = spark.createDataFrame([(float("nan"), "NaN", 1), (2.0, "3.5", 2)], "x double, s string, i int")
    out = nan_to_null(df).select("x", text_nan_to_null("s").alias("s"), "i").collect()
    assert out[0].x is None and out[0].s is None and out[1].x == 2.0 and out[1].s == "3.5"
    # NaN would otherwise poison a mean and pass a lower bound test
    assert nan_to_null(df).agg(F.avg("x")).first()[0] == 2.0


def test_year_from_date_text_and_integer(spark):
    df = spark.createDataFrame([(dt.date(2023, 1, 1), "2023", 2023, "2023-06-30")],
                               "d date, t string, i int, s string")
    r = df.select(year_of("d", T.DateType()).alias("a"), year_of("t", T.StringType()).alias("b"),
                  year_of("i", T.IntegerType()).alias("c"), year_of("s", T.StringType()).alias("e")).first()
    assert (r.a, r.b, r.c, r.e) == (2023, 2023, 2023, 2023)


def test_weekday_bases_and_buckets(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 23)], "d date, h int")   # a Monday
    r = df.select(weekday_monday0("d").alias("w0"), weekday_iso_text("d").alias("wi"),
                  bucket_start("h", 3).alias("b")).first()
    assert (r.w0, r.wi, r.b) == (0, "1", 21)


def test_half_even_rounding_and_exact_mean(spark):
    df = spark.createDataFrame([(0.125,), (0.135,), (2.675,)], "x double")
    got = [r.r for r in df.select(round_half_even("x", 2).alias("r")).collect()]
    # pandas/numpy semantics (scale, round half to even, unscale): 2.675 -> 2.68,
    # where Python's correctly rounded round() gives 2.67
    assert got == pd.Series([0.125, 0.135, 2.675]).round(2).tolist()
    parts = spark.createDataFrame([(0.1,), (0.2,), (0.3,)] * 1000, "x double")
    a = parts.repartition(1).agg(exact_avg("x")).first()[0]
    b = parts.repartition(7).agg(exact_avg("x")).first()[0]
    assert a == b


def test_zoned_and_naive_inputs_give_the_same_local_calendar(spark):
    from wattlane.functions.calendar import with_local_calendar
    naive = spark.createDataFrame([(dt.datetime(2024, 3, 31, 0, 30),), (dt.datetime(2024, 10, 27, 0, 30),),
                                   (dt.datetime(2024, 10, 27, 1, 30),)], "time timestamp_ntz")
    want = [(r.ts_utc, r.localtime, r.hour, r.date) for r in
            with_local_calendar(naive).orderBy("ts_utc").collect()]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # the same instants as zoned timestamps, read in another session zone
        zoned = naive.select(F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("time"))
                             .cast("timestamp").alias("time"))
        got = [(r.ts_utc, r.localtime, r.hour, r.date) for r in
               with_local_calendar(zoned).orderBy("ts_utc").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == want
    # 00:30 UTC on 31 March is 01:30 CET (before the switch); 00:30 and 01:30 UTC
    # on 27 October are both 02:30 local (the repeated hour)
    assert [w[2] for w in want] == [1, 2, 2]


def test_text_instants_with_and_without_offset(spark):
    from wattlane.functions.calendar import utc_column
    rows = ["2024-01-01T00:00:00+02:00", "2024-01-01T00:00:00", "2024-01-01 00:00:00Z", "2024-01-01", "2024-06-01 12:30:00.5-03:30"]
    df = spark.createDataFrame([(r,) for r in rows], "time string")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = [str(r[0]) for r in df.select(utc_column(df, "time").cast("string")).collect()]
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got == ["2023-12-31 22:00:00", "2024-01-01 00:00:00", "2024-01-01 00:00:00", "2024-01-01 00:00:00", "2024-06-01 16:00:00.5"]


def test_exact_sums_lose_nothing_and_do_not_overflow(spark):
    from wattlane.functions.numeric import exact_sum
    get = lambda xs, agg: spark.createDataFrame([(x,) for x in xs], "x double").agg(agg("x")).first()[0]
    assert get([4e-7, 4e-7], exact_avg) == 4e-7
    assert get([1e13, 1e13], exact_avg) == 1e13 and get([1e300, 1e300], exact_sum) == 2e300
    assert get([0.1] * 10, exact_sum) == 1.0 and get([None, None], exact_avg) is None
    assert get([1e15, 0.1, -1e15, 0.2], exact_sum) == 0.1 + 0.2 or abs(get([1e15, 0.1, -1e15, 0.2], exact_sum) - 0.3) < 0.1


def test_no_machine_local_folder_on_a_cluster():
    import os

    import pytest

    from wattlane.session import scratch_folder
    for master in ("local", "local[4]", "local[*]"):
        assert os.path.isdir(scratch_folder(master))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://https://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch_folder(master)


def test_command_line_names_no_master(monkeypatch):
    from wattlane.plans import tasks
    seen = {}
    monkeypatch.setattr("wattlane.session.get_session", lambda **kw: seen.update(kw) or (_ for _ in ()).throw(SystemExit))
    import pytest
    with pytest.raises(SystemExit):
        tasks.main(["--consumption", "c", "--weather", "w", "--socioeconomic", "s", "--buildings", "b", "--polygons", "p", "--out", "o"])
    assert seen == {}
