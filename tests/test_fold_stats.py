"""Statistics and preprocessing of all folds at once, against plain per-fold sums."""

import math

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wattlane.operators.fold_stats import fold_categories, fold_preprocessing, fold_scalers

SCHEMA = "train_from_fold int, `a b` double, n int, empty double, t string, n_rows double"


def _folds(spark):
    rows = [(i % 4 if i % 9 else None, None if i % 5 == 0 else float("nan") if i % 7 == 0 else 1e9 + i % 3,
             i, None, None if i % 6 == 0 else f"v{i % 4}-{i % 8 // 7}", float(i)) for i in range(80)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_scalers_and_categories_equal_each_fold_by_itself(spark):
    rows, folds = _folds(spark)
    got = {(r.fold, r.feature): r for r in fold_scalers(folds, ["a b", "n", "empty", "n_rows"], 3).collect()}
    assert len(got) == 16
    for fold in range(4):
        train = [r for r in rows if r[0] is not None and r[0] <= fold]
        for at, name in ((1, "a b"), (2, "n"), (3, "empty"), (5, "n_rows")):
            xs = [r[at] for r in train if r[at] is not None and not math.isnan(r[at])]
            g = got[fold, name]
            assert (g.n_rows, g.n) == (len(train), len(xs))
            if not xs:
                assert g["mean"] is None and g["std"] is None
                continue
            mean = math.fsum(xs) / len(xs)
            assert math.isclose(g["mean"], mean)
            # values around 1e9 with a spread of 1: sums of squares would lose it
            assert math.isclose(g["std"], math.sqrt(math.fsum((x - mean) ** 2 for x in xs) / len(xs)), rel_tol=1e-6)
    first = {}
    for r in rows:
        if r[0] is not None and r[4] is not None:
            first[r[4]] = min(first.get(r[4], 9), r[0])
    assert {r.value: r.first_fold for r in fold_categories(folds, ["t"]).collect()} == first


def test_preprocessing_of_each_fold(spark):
    train = spark.createDataFrame([(0, 1.0, "b"), (0, 3.0, "c"), (0, None, "c"), (1, 8.0, "a"), (2, 5.0, None)],
                                  "train_from_fold int, x double, t string")
    stages = fold_preprocessing(train, ["x"], ["t"], n_splits=2)
    assert len(stages) == 3
    test = spark.createDataFrame([(4.0, "c"), (None, "a"), (2.0, None), (float("nan"), "zzz")], "x double, t string")

    def features(fold):
        sent = Pipeline(stages=stages[fold]).fit(train.where(F.col("train_from_fold") <= fold)).transform(test)
        return [r.f for r in sent.select(vector_to_array("features").alias("f")).collect()]
    assert features(0) == [[2.0, 0.0, 1.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]]      # knows b, c
    assert [f[1:] for f in features(1)] == [[0.0, 0.0, 1.0], [1.0, 0.0, 0.0], [0.0] * 3, [0.0] * 3]  # knows a, b, c
    sd = math.sqrt((9 + 1 + 16) / 3)
    assert all(math.isclose(f[0], (x - 4.0) / sd, abs_tol=1e-12) for f, x in zip(features(1), (4.0, 4.0, 2.0, 4.0)))


def test_nothing_to_scale(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fold_scalers(empty, ["n"], 3).count() == 0 and fold_scalers(empty, [], 3).count() == 0
    assert fold_categories(empty, ["t"]).count() == 0 and fold_categories(empty, []).count() == 0


def test_grid_search_needs_no_fit_per_fold(spark):
    """An MLlib estimator over the folds: a fold whose feature is all missing does not fail."""
    from wattlane.operators.models import grid_search, tree_regressor
    rows = [(i // 40, i // 40 - 1 if i >= 40 else None, float(i % 10), None if i < 40 else 1.0, "ab"[i % 2], float(i % 10 > 4))
            for i in range(120)]
    folds = spark.createDataFrame(rows, "train_from_fold int, test_fold int, x double, late double, t string, y double")
    res = grid_search(spark, folds, folds.limit(20), "y", ["x", "late"], ["t"], tree_regressor,
                      [{"max_depth": 2, "min_samples_leaf": 1}], n_splits=2)
    assert res.best["mean_mse"] == 0.0 and {r.fold for r in res.scores.collect()} == {0, 1}
    assert res.test_predictions.where("prediction <> y").count() == 0
