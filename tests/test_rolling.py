"""Rolling statistics by hand and the split-vs-unsplit plans."""

import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wattlane.operators.rolling import CLEANING_SPECS, RollingSpec, clean_series, rolling, series_index
from wattlane.sources.standins import meter_hourly

from .conftest import SF001


def _series(n=400, seed=0, gaps=True):
    rng = np.random.default_rng(seed)
    t0 = dt.datetime(2024, 3, 25)
    rows = []
    for pc in ("25001", "25193"):
        h = 0
        for i in range(n):
            h += 1 + (int(rng.integers(0, 3)) if gaps and i % 37 == 0 else 0)
            v = float(rng.normal(100, 20))
            if i % 53 == 0:
                v = float("nan")          # NaN at the source
            rows.append((pc, t0 + dt.timedelta(hours=h), v, 3))
    return pd.DataFrame(rows, columns=["postalcode", "time", "consumption", "contracts"])


def _by_hand(rows):
    """Mean, deviation and quantiles of rows i-24..i+23 and i-84..i+83 of each series, value by value."""
    out = {}
    for code in sorted({r[0] for r in rows}):
        series = sorted((r for r in rows if r[0] == code), key=lambda r: r[1])
        value = [r[2] for r in series]
        for i, r in enumerate(series):
            near = [v for v in value[max(0, i - 24):i + 24] if not math.isnan(v)]
            wide = sorted(v for v in value[max(0, i - 84):i + 84] if not math.isnan(v))
            mean = sum(near) / len(near) if len(near) >= 4 else math.nan
            std = math.sqrt(sum((v - mean) ** 2 for v in near) / (len(near) - 1)) if len(near) >= 4 else math.nan
            q10 = qn = math.nan
            if len(wide) >= 24:
                at = 0.1 * (len(wide) - 1)
                k = math.floor(at)
                q10 = wide[k] + (wide[min(k + 1, len(wide) - 1)] - wide[k]) * (at - k)
                qn = wide[round(at)]
            x = value[i]
            z = (x - mean) / std if std else math.nan
            out[code, r[1]] = (mean, std, q10, qn, x if -2 < z < 4 and x > 0.7 * q10 else math.nan)
    return out


def test_clean_series_by_hand(spark):
    pdf = _series()
    sdf = spark.createDataFrame(pdf, "postalcode string, time timestamp_ntz, consumption double, contracts int")
    specs = [*CLEANING_SPECS, RollingSpec("q10_nearest", "quantile", 168, 24, q=0.1, interpolation="nearest")]
    got = clean_series(sdf, specs=specs, block_rows=100).collect()
    want = _by_hand([(r.postalcode, r.time.to_pydatetime(), r.consumption) for r in pdf.itertuples()])
    assert len(got) == len(want)
    cols = ("rolling_mean", "rolling_std", "rolling_q10", "q10_nearest", "consumption_filtered")
    have = [[math.nan if r[c] is None else r[c] for c in cols] for r in got]
    np.testing.assert_allclose(have, [want[r.postalcode, r.time] for r in got], rtol=1e-9, atol=1e-9, equal_nan=True)


def test_tied_instants_do_not_depend_on_row_order(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(hours=i // 2), float(i * 7 % 13), i) for i in range(200)]
    schema = "postalcode string, time timestamp_ntz, consumption double, contracts int"
    out = [sorted(map(str, clean_series(spark.createDataFrame(x, schema).coalesce(1), block_rows=100).collect()))
           for x in (rows, rows[::-1])]
    assert out[0] == out[1]


def test_split_plan_equals_single_task_plan(spark):
    base = meter_hourly(spark, SF001).withColumn("ts_utc", F.col("time"))
    specs = list(CLEANING_SPECS) + [RollingSpec("qn", "quantile", 168, 24, q=0.1, interpolation="nearest")]
    a = rolling(base, "consumption", specs, split=True, block_rows=90, chunk_days=3)
    b = rolling(base, "consumption", specs, split=False)
    cols = ["postalcode", "ts_utc"] + [s.name for s in specs]
    da = a.select(*cols).toPandas().sort_values(cols[:2]).reset_index(drop=True)
    db = b.select(*cols).toPandas().sort_values(cols[:2]).reset_index(drop=True)
    assert len(da) == len(db) == base.count()
    for s in specs:
        np.testing.assert_allclose(da[s.name].astype(float), db[s.name].astype(float), rtol=1e-12,
                                   equal_nan=True)


def test_series_index_matches_row_number(spark):
    from pyspark.sql import Window
    base = meter_hourly(spark, SF001)
    got = series_index(base, ["postalcode"], "time", chunk_days=2)
    want = base.withColumn("row_idx", F.row_number().over(Window.partitionBy("postalcode").orderBy("time")) - 1)
    assert got.select("postalcode", "time", "row_idx").exceptAll(
        want.select("postalcode", "time", "row_idx")).count() == 0


def test_dst_days_and_constant_series(spark):
    # 2024-10-27 has 25 local hours, 2024-03-31 has 23; a constant series has std 0
    rows = []
    for day, hours in (("2024-03-30", 72), ("2024-10-26", 72)):
        t0 = dt.datetime.fromisoformat(day)
        rows += [("c", t0 + dt.timedelta(hours=h), 5.0, 1) for h in range(hours)]
    sdf = spark.createDataFrame(rows, "postalcode string, time timestamp_ntz, consumption double, contracts int")
    out = clean_series(sdf).toPandas()
    per_day = out.groupby("date").size()
    assert per_day[dt.date(2024, 3, 31)] == 23
    assert per_day[dt.date(2024, 10, 27)] == 25
    assert out["z_norm"].isna().all()                 # zero std -> missing, not inf
    assert out["consumption_filtered"].isna().all()


def test_missing_key_rows_keep_place_without_statistics(spark):
    rows = [(None if i == 10 else "a", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(i), 1)
            for i in range(60)]
    sdf = spark.createDataFrame(rows, "postalcode string, time timestamp_ntz, consumption double, contracts int")
    out = clean_series(sdf).toPandas()
    assert len(out) == 60
    assert out.loc[out.postalcode.isna(), "rolling_mean"].isna().all()
    assert out.loc[out.postalcode.notna(), "rolling_mean"].notna().all()


def test_no_python_in_the_plan(spark):
    plan = clean_series(meter_hourly(spark, SF001))._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan and "Arrow" not in plan
