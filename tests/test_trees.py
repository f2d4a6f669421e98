"""Exact trees against a plain recursive search over every feature, threshold and missing side."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattlane.operators.models import exact_tree_grid, train_tree_classifier, tree_grid, tree_nodes
from wattlane.operators.trees import TreeModel, grow, route

ROWS = "tree int, y double, x array<double>"


def _impurity(ys, classes):
    if classes:
        return -sum(p * math.log2(p) for c in range(classes) if (p := sum(y == c for y in ys) / len(ys)))
    m = sum(ys) / len(ys)
    return sum((y - m) ** 2 for y in ys) / len(ys)


def _plain(rows, classes, max_depth, min_leaf, path=""):
    """{path: (feature, threshold, missing left, n)}"""
    ys = [y for y, _ in rows]
    whole = _impurity(ys, classes)
    best = None
    if len(path) < max_depth and whole > 1e-9:
        for f in range(len(rows[0][1])):
            known = sorted({x[f] for _, x in rows if x[f] is not None})
            lost = any(x[f] is None for _, x in rows)
            cuts = [((a + b) / 2, side) for a, b in zip(known, known[1:]) for side in ((True, False) if lost else (None,))]
            cuts += [(math.inf, False)] if lost and known else []
            for cut, side in cuts:
                left = [r for r in rows if (side if r[1][f] is None else r[1][f] <= cut)]
                right = [r for r in rows if not (side if r[1][f] is None else r[1][f] <= cut)]
                if min(len(left), len(right)) < min_leaf:
                    continue
                gain = whole - sum(len(s) * _impurity([y for y, _ in s], classes) for s in (left, right)) / len(rows)
                score = round(gain if classes else gain / whole, 10)
                found = (score, -f, -cut, bool(side), side if lost else len(left) > len(right), left, right)
                if best is None or found[:4] > best[:4]:
                    best = found
    if best is None:
        return {path: (None, None, None, len(rows))}
    out = {path: (-best[1], -best[2], best[4], len(rows))}
    out |= _plain(best[5], classes, max_depth, min_leaf, path + "l")
    return out | _plain(best[6], classes, max_depth, min_leaf, path + "r")


def _data(seed, n, classes):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        x = [float(rng.integers(0, 12)), float(rng.normal()), float(rng.integers(0, 3)), 5.0]
        y = float((x[0] > 4) + (x[1] > 0.3) * (x[2] == 1)) if classes else 10 * (x[0] > 4) + x[1] + round(float(rng.normal()), 2)
        x = [None if rng.random() < (0.25 if f == 0 else 0.1) and f < 3 else v for f, v in enumerate(x)]
        out.append((float(min(int(y) + (rng.random() < 0.1), classes - 1)) if classes else float(y), x))
    return out


def _got(nodes, classes, tree=0):
    return {r.path: (r.feature, r.threshold, r.missing_left, int(sum(r.stats) if classes else r.stats[0]))
            for r in nodes.where(F.col("tree") == tree).collect()}


@pytest.mark.parametrize("classes", [0, 3])
def test_trees_equal_plain_search(spark, classes):
    """Two trees at once, grown in tasks and level by level."""
    first, second = _data(1, 150, classes), _data(2, 120, classes)
    df = spark.createDataFrame([(0, *r) for r in first] + [(1, *r) for r in second], ROWS).repartition(5)
    limits = {0: (4, 5), 1: (3, 1)}
    whole = grow(df, limits, classes)
    parted = grow(df, limits, classes, task_rows=40)
    for nodes in (whole, parted):
        for tree, rows in ((0, first), (1, second)):
            got, want = _got(nodes, classes, tree), _plain(rows, classes, *limits[tree])
            assert got.keys() == want.keys()
            for path, (f, cut, side, n) in want.items():
                assert got[path][0] == f and got[path][2:] == (side, n)
                assert got[path][1] == cut or abs(got[path][1] - cut) < 1e-12
    routed = [route(df.withColumnsRenamed({"tree": "_tree", "x": "_x"}), whole, [1, 50], limit) for limit in (10 ** 6, 3)]
    a, b = (sorted((r._tree, r.y, str(r._x), str(r._at)) for r in d.collect()) for d in routed)
    assert a == b


def test_tree_deeper_than_thirty(spark):
    """A chain: the first value against the rest, again and again."""
    rows = [(0, 3.0 ** i, [float(i)]) for i in range(40)]
    nodes = grow(spark.createDataFrame(rows, ROWS), {0: (60, 1)})
    want = _plain([(y, x) for _, y, x in rows], 0, 60, 1)
    assert _got(nodes, 0).keys() == want.keys() and nodes.agg(F.max("depth")).first()[0] > 30
    model = TreeModel(nodes, ["x"])
    df = spark.createDataFrame([(float(i), 3.0 ** i) for i in range(40)], "x double, y double")
    assert model.transform(df).where("abs(prediction - y) > 1e-9 * y").count() == 0


def test_classifier_routes_missing_values(spark):
    rows = [(i, "train", None if i % 3 == 0 else float(i % 7), 1 if i % 3 == 0 else 0) for i in range(120)] + [(500, "test", None, 1), (501, "test", 2.0, 0)]
    df = spark.createDataFrame(rows, "date int, split string, f double, cluster int").withColumn("postalcode", F.lit("x"))
    res = train_tree_classifier(df)
    assert res.predictions.where("prediction <> cluster").count() == 0
    nodes = tree_nodes(spark, res.model.stages[-1], res.feature_names).orderBy("node_id").collect()
    assert [(n.node_id, n.feature, n.threshold, n.missing_left, n.left_child, n.right_child) for n in nodes] == [
        (0, "f", math.inf, False, 1, 2), (1, None, None, None, None, None), (2, None, None, None, None, None)]


def test_grid_points_are_fits_of_their_own(spark):
    """Every grid point on every fold equals a tree grown for it alone."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(260):
        a, t = float(rng.integers(0, 40)), "uvw"[int(rng.integers(0, 3))]
        rows.append((a, t, a * (t == "u") + float(rng.normal()), 0 if i < 200 else 1 if i < 230 else 2, 0 if 200 <= i < 230 else 1 if i >= 230 else -1))
    df = spark.createDataFrame(rows, "a double, t string, y double, train_from_fold int, test_fold int").withColumn(
        "test_fold", F.when(F.col("test_fold") >= 0, F.col("test_fold")))
    grid = tree_grid([2, 5, 40], [3, 9])
    res = exact_tree_grid(spark, df, df.limit(10), "y", ["a"], ["t"], grid, n_splits=2)
    got = {(r.max_depth, r.min_samples_leaf, r.fold): r.mse for r in res.scores.collect()}
    assert len(got) == 12
    x = lambda r: [r[0], *[float(r[1] == v) for v in "uvw"]]        # noqa: E731
    for (depth, leaf, fold), mse in got.items():
        train = [(r[2], x(r)) for r in rows if r[3] <= fold]
        tree = _plain(train, 0, depth, leaf)

        def at(v):
            path = ""
            while tree[path][0] is not None:
                path += "l" if v[tree[path][0]] <= tree[path][1] else "r"
            return path
        value = {}
        for y, v in train:
            value.setdefault(at(v), []).append(y)
        errors = [(r[2] - np.mean(value[at(x(r))])) ** 2 for r in rows if r[4] == fold]
        assert abs(np.mean(errors) - mse) < 1e-9
    assert res.best["mean_mse"] == min((got[g["max_depth"], g["min_samples_leaf"], 0] + got[g["max_depth"], g["min_samples_leaf"], 1]) / 2 for g in grid)
    assert res.test_predictions.count() == 10
