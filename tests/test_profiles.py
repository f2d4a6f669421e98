"""Daily profiles: golden sample G1, strict vs lenient totals, pivot."""

import datetime as dt

from wattlane.operators.profiles import profile_long, profile_wide, strict_daily_total


def _day(spark, values):
    rows = [("25199", dt.date(2024, 9, 16), h, v, dt.datetime(2024, 9, 15, 22) + dt.timedelta(hours=h))
            for h, v in values]
    return spark.createDataFrame(rows, "postalcode string, date date, hour int, consumption_filtered double, "
                                       "ts_utc timestamp_ntz")


def test_golden_g1(spark):
    # bucket 0-2 misses an hour; buckets 3-5 and 6-8 complete (means 390.667 and 556)
    vals = [(0, 100.0), (1, None), (2, 120.0), (3, 390.0), (4, 391.0), (5, 391.0),
            (6, 556.0), (7, 550.0), (8, 562.0)]
    long = profile_long(_day(spark, vals)).toPandas().set_index("hour").sort_index()
    assert long.loc[0, "consumption_filtered"] != long.loc[0, "consumption_filtered"]  # NaN/None
    assert abs(long.loc[3, "consumption_filtered"] - 1172.0) < 1e-9
    assert abs(long.loc[6, "consumption_filtered"] - 1668.0) < 1e-9
    assert long["daily_consumption"].isna().all()
    assert long["consumption"].isna().all()
    assert profile_wide(profile_long(_day(spark, vals))).count() == 0   # all shares missing


def test_complete_day_shares_sum_to_100(spark):
    vals = [(h, float(10 + h)) for h in range(24)]
    df = _day(spark, vals)
    day = strict_daily_total(df).first()["daily_consumption"]
    assert abs(day - sum(10 + h for h in range(24))) < 1e-9
    wide = profile_wide(profile_long(df)).toPandas()
    shares = wide[[str(h) for h in range(0, 24, 3)]].iloc[0]
    assert abs(shares.sum() - 100.0) < 1e-9


def test_rows_with_missing_keys_are_dropped(spark):
    rows = [("a", dt.date(2024, 1, 1), h, 1.0) for h in range(24)] + [(None, dt.date(2024, 1, 1), 0, 5.0),
                                                                       ("a", None, 0, 5.0)]
    df = spark.createDataFrame(rows, "postalcode string, date date, hour int, consumption_filtered double")
    long = profile_long(df).toPandas()
    assert set(long.postalcode) == {"a"} and long.date.notna().all()
    assert abs(long.daily_consumption.iloc[0] - 24.0) < 1e-12


def test_day_without_rows_in_first_bucket(spark):
    """Absent hours are not missing values: the strict total uses the rows present,
    the absent bucket has no long row and leaves its wide cell empty."""
    from wattlane.operators.profiles import complete_days
    vals = [(h, 10.0) for h in range(3, 24)]
    long = profile_long(_day(spark, vals)).toPandas().set_index("hour").sort_index()
    assert 0 not in long.index and len(long) == 7
    assert abs(long["daily_consumption"].iloc[0] - 240.0) < 1e-9
    wide = profile_wide(profile_long(_day(spark, vals)))
    row = wide.first()
    assert row["0"] is None and abs(row["3"] - 12.5) < 1e-9
    assert complete_days(wide, [str(h) for h in range(0, 24, 3)]).count() == 0
