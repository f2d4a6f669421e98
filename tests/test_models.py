"""Model helpers, and fitted trees against exhaustive search."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wattlane.operators.enrich import dimension
from wattlane.operators.models import check_depth, columns_by_kind, fitted_as, preprocessing_stages, tree_grid, tree_regressor


def test_unseen_category_is_all_zero(spark):
    train = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "c")], "x double, t string")
    test = spark.createDataFrame([(1.5, "a"), (2.5, "zzz")], "x double, t string")
    stages, _ = preprocessing_stages(["x"], ["t"], impute=False)
    model = Pipeline(stages=stages).fit(train)
    rows = model.transform(test).select("t", vector_to_array("features").alias("f")).collect()
    got = {r.t: r.f for r in rows}
    assert got["a"][1:] == [1.0, 0.0, 0.0]          # known value keeps its slot (all 3 slots kept)
    assert got["zzz"][1:] == [0.0, 0.0, 0.0]        # unseen value -> zeros


def test_grid_has_every_point_and_fits_equal_ones_once(spark):
    g = tree_grid([15, 25, 40, 60], [5, 10, 15, 20])
    assert len(g) == 16 and len({fitted_as(p) for p in g}) == 12
    assert tree_regressor({"max_depth": 60, "min_samples_leaf": 5}, max_bins=64).getMaxBins() == 64
    stub = type("Model", (), {"depth": 30})()
    check_depth(stub, {"max_depth": 25})
    with pytest.raises(ValueError, match="limit"):
        check_depth(stub, {"max_depth": 40})


def test_regression_tree_finds_the_steps(spark):
    """Two thresholds on one of two features: the tree's predictions are the segment means."""
    from pyspark.ml.feature import VectorAssembler
    rows = [(float(i % 20), float(i % 7), 10.0 * (i % 20 > 6) + 5.0 * (i % 20 > 13)) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, _y double")
    x = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    m = tree_regressor({"max_depth": 40, "min_samples_leaf": 5}).fit(x)
    check_depth(m, {"max_depth": 40})
    assert m.transform(x).where("abs(prediction - _y) > 1e-9").count() == 0
    assert m.depth == 2 and set(m.featureImportances.indices.tolist()) == {0}


def test_classifier_equals_exhaustive_entropy_search(spark):
    """Depth 1: the split with the greatest gain over every feature and threshold."""
    import math

    from wattlane.operators.models import train_tree_classifier, tree_nodes
    rows = [(i, "train", (i * 7) % 11, (i * 5) % 6, (int((i * 7) % 11 > 4) + (i % 13 == 0)) % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "date int, split string, f int, g int, cluster int").withColumn("postalcode", F.lit("x"))
    res = train_tree_classifier(df, max_depth=1, min_leaf=20)

    def entropy(ys):
        return -sum(p * math.log2(p) for p in (sum(y == c for y in ys) / len(ys) for c in set(ys))) if ys else 0.0
    ys = [r[4] for r in rows]
    best = max((entropy(ys) - sum(len(s) / len(ys) * entropy(s) for s in (lo, hi)), name, t)
               for col, name in ((2, "f"), (3, "g")) for t in sorted({r[col] for r in rows})[:-1]
               for lo, hi in [([r[4] for r in rows if r[col] <= t], [r[4] for r in rows if r[col] > t])] if min(len(lo), len(hi)) >= 20)
    root = tree_nodes(spark, res.model.stages[-1], res.feature_names).where("node_id = 0").first()
    assert root.feature == best[1] and best[2] <= root.threshold < best[2] + 1 and abs(root.gain - best[0]) < 1e-9


def test_columns_by_kind(spark):
    df = spark.createDataFrame([(1, 2.0, "a", True)], "i int, d double, s string, b boolean") \
        .withColumn("ts", F.current_timestamp())
    assert columns_by_kind(df, exclude=["d"]) == (["i"], ["s"])


def test_dimension_broadcast_is_checked(spark):
    fact = spark.range(1000).withColumn("k", F.col("id") % 10)
    dim = spark.range(10).withColumnRenamed("id", "k").withColumn("v", F.col("k") * 2)
    plan = fact.join(dimension(dim, 100), "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    plan2 = fact.join(dimension(dim, 5), "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan2 or "AdaptiveSparkPlan" in plan2


def test_single_category_and_all_missing_feature(spark):
    from wattlane.operators.models import present_columns
    train = spark.createDataFrame([(1.0, "a", None), (2.0, "a", None)], "x double, t string, z double")
    stages, _ = preprocessing_stages(["x"], ["t"], impute=False)
    model = Pipeline(stages=stages).fit(train)
    rows = model.transform(train).select(vector_to_array("features").alias("f")).collect()
    assert all(len(r.f) == 2 for r in rows)                 # one slot for the single category
    assert present_columns(train, ["x", "z"]) == ["x"]


def test_wide_dimension_is_not_broadcast(spark):
    """500 columns, or long texts: the bytes count, not the rows."""
    def plan(dim):
        joined = spark.range(1000).withColumn("k", F.col("id") % 10).join(dim, "k")
        return joined._jdf.queryExecution().analyzed().toString()
    ten = spark.range(10).withColumnRenamed("id", "k")
    wide = ten.select("k", *[(F.col("k") * i).cast("double").alias(f"v {i}") for i in range(500)])
    assert "broadcast" in plan(dimension(wide)) and "broadcast" not in plan(dimension(wide, broadcast_bytes=10 * 500 * 8))
    texts = ten.withColumn("t", F.repeat(F.lit("é"), 5000)).withColumn("a", F.array(F.lit(1.5)))
    assert "broadcast" in plan(dimension(texts, broadcast_bytes=110_000)) and "broadcast" not in plan(dimension(texts, broadcast_bytes=100_000))
    assert "broadcast" in plan(dimension(ten.limit(0), broadcast_bytes=0))


def test_slices_do_not_depend_on_row_order(spark):
    """Repeated instants: the windows are the same however the rows arrive."""
    from wattlane.operators.metrics import forecast_slices
    rows = [("a", f"2024-01-01 {i // 6:02d}:00:00", i % 3, float(i)) for i in range(120)]
    schema = "postalcode string, t string, consumption int, predicted double"

    def windows(order):
        df = spark.createDataFrame(order, schema).withColumn("ts_utc", F.to_timestamp_ntz("t")).repartition(3)
        return sorted(map(tuple, forecast_slices(df, ["a"], hours=10, npred=4).select("slice", "offset", "consumption", "predicted").collect()))
    assert windows(rows) == windows(rows[::-1]) and len(windows(rows)) == 40
