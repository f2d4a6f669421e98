"""Scaling properties, splits and folds."""

import pytest
from pyspark.sql import functions as F

from wattlane.operators.scaling import scale_data
from wattlane.operators.metrics import forecast_slices
from wattlane.operators.splits import chrono_holdout, expanding_folds, hash_split, holdout_with_folds


def test_minmax_and_znorm(spark):
    rows = [(i, float(i), 7.0, float(i * i) if i != 3 else None) for i in range(10)]
    df = spark.createDataFrame(rows, "k int, a double, const double, b double")
    mm = scale_data(df, ["a", "const", "b"], "min_max_scaling").toPandas()
    assert mm["a"].between(0, 1).all() and mm["const"].eq(0).all()
    assert mm["b"].min() == 0 and mm["b"].max() == 1
    z = scale_data(df, ["a", "const"], "z_norm_scaling").toPandas()
    assert abs(z["a"].mean()) < 1e-12 and abs(z["a"].std(ddof=0) - 1) < 1e-12
    assert z["const"].eq(0).all()
    with pytest.raises(ValueError):
        scale_data(df, ["a"], "unknown")


def _ts(spark, n):
    return spark.range(n).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("postalcode"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(hours=(F.col("id") / 2).cast("int")))
        .alias("ts_utc"), F.col("id"))


def test_chrono_holdout_is_last_rows(spark):
    df = _ts(spark, 1001)
    got = chrono_holdout(df, 300).where("split = 'test'").select("id").toPandas()["id"]
    assert sorted(got) == list(range(701, 1001))


def test_folds_disjoint_and_ordered(spark):
    df = _ts(spark, 1000)
    f = expanding_folds(df, 5, 96).toPandas().sort_values("id")
    for i in range(5):
        test = f[f.test_fold == i]["id"]
        train = f[f.train_from_fold <= i]["id"]
        assert len(test) == 96 and train.max() < test.min()
        assert len(train) == 1000 - (5 - i) * 96
    assert f.test_fold.dropna().is_monotonic_increasing


def test_hash_split_independent_of_partitioning(spark):
    df = _ts(spark, 2000)
    a = hash_split(df, ["postalcode", "ts_utc"]).repartition(1)
    b = hash_split(df.repartition(7), ["postalcode", "ts_utc"])
    assert a.exceptAll(b).count() == 0
    share = a.where("split = 'test'").count() / 2000
    assert 0.15 < share < 0.25


def test_every_row_once_with_repeated_keys(spark):
    df = spark.createDataFrame([("a", "2024-01-01 %02d:00:00" % (i if i < 9 else 8), i) for i in range(11)],
                               "postalcode string, t string, id int").select("postalcode", F.col("t").cast("timestamp_ntz").alias("ts_utc"), "id")
    got = chrono_holdout(df, 4).collect()
    assert sorted(r.id for r in got) == list(range(11)) and sum(r.split == "test" for r in got) == 4
    assert {r.id for r in got if r.split == "test"} >= {8, 9, 10}
    folds = expanding_folds(df, 2, 3).collect()
    assert sorted(r.id for r in folds) == list(range(11)) and sum(r.test_fold is not None for r in folds) == 6


def test_one_ranking_equals_two(spark):
    df = _ts(spark, 1000)
    one = {r.id: (r.split, r.test_fold, r.train_from_fold) for r in holdout_with_folds(df, 200, 3, 50).collect()}
    hold = chrono_holdout(df, 200)
    two = {r.id: ("train", r.test_fold, r.train_from_fold) for r in expanding_folds(hold.where("split = 'train'"), 3, 50).collect()}
    two |= {r.id: ("test", None, None) for r in hold.where("split = 'test'").collect()}
    assert one == two


def test_series_of_exactly_one_window_gives_none(spark):
    df = _ts(spark, 192 + 2).withColumn("v", F.col("id"))            # 97 rows each
    short = df.where("postalcode = 'a' or id < 192")                  # b has 96 rows
    got = forecast_slices(short, ["a", "b"], hours=96, npred=10).groupBy("postalcode").count().collect()
    assert {r.postalcode: r["count"] for r in got} == {"a": 960}
