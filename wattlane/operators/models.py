"""Decision-tree models: exact trees of this library, other estimators on MLlib.

The classifier and the forecast's "Decision Tree" are exact trees
(``operators.trees``): every threshold, missing values routed, any depth; they
need no scaling and no imputation.  ``grid_search`` runs any MLlib estimator:

* Features are picked by column kind (numbers vs text), as the reference's
  ``select_dtypes`` does; other kinds (timestamps, dates) are left out.
* MLlib trees refuse missing values, so missing numbers become their fold's mean.
* Text features: ``StringIndexer(handleInvalid='keep')`` + ``OneHotEncoder``
  (dropLast): an unseen value becomes the all-zero vector, known values keep
  their slot - ``OneHotEncoder(handle_unknown='ignore')`` semantics.
* Numeric features are standardised with the mean and population std of the
  fold's training rows (trees are invariant to any scaling).
* The grid search takes the preprocessing of all folds from one aggregate and fits the
  trees of all parameter combinations of a fold concurrently (Spark schedules the jobs).
* MLlib trees are at most 30 deep.  A deeper grid value is fitted at 30; if the
  tree ends above that depth by itself, it is the tree the deeper value gives,
  and the grid point stands; if it reaches 30, the fit is an error.
* MLlib tries at most ``max_bins - 1`` thresholds per numeric feature (all of
  them for a feature of up to ``max_bins`` distinct values).  The default here
  is MAX_BINS; raise it for more thresholds at more memory per node.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (Imputer, OneHotEncoder, StandardScaler, StringIndexer,
                                VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattlane.operators.fold_stats import fold_preprocessing
from wattlane.operators.splits import fold_frames
from wattlane.operators.trees import TreeModel, feature_array, grow, node_table, route
from wattlane.session import cut_lineage, scratch_table_path

MLLIB_MAX_DEPTH = 30
#: Thresholds tried per numeric feature, plus one (MLlib's own default is 32).
MAX_BINS = 256


def columns_by_kind(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric columns, text columns) of ``df`` minus ``exclude``."""
    num, txt = [], []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if isinstance(f.dataType, T.NumericType) and not isinstance(f.dataType, T.BooleanType):
            num.append(f.name)
        elif isinstance(f.dataType, T.StringType):
            txt.append(f.name)
    return num, txt


def preprocessing_stages(numeric: Sequence[str], text: Sequence[str], scale: bool = True,
                         impute: bool = True) -> tuple[list, list[str]]:
    """Stages that build ``features``; returns (stages, feature names in vector order)."""
    stages, names, inputs = [], [], []
    num_in = list(numeric)
    if impute and num_in:
        imp_out = [f"_imp_{c}" for c in num_in]
        stages.append(Imputer(inputCols=num_in, outputCols=imp_out, strategy="mean"))
        inputs += imp_out
        names += list(num_in)
    else:
        inputs += num_in
        names += list(num_in)
    if scale and inputs:
        stages.append(VectorAssembler(inputCols=inputs, outputCol="_num_raw", handleInvalid="keep"))
        stages.append(StandardScaler(inputCol="_num_raw", outputCol="_num", withMean=True, withStd=True))
        inputs = ["_num"]
    if text:
        idx = [f"_idx_{c}" for c in text]
        ohe = [f"_ohe_{c}" for c in text]
        stages.append(StringIndexer(inputCols=list(text), outputCols=idx, handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        # the indexer's unknown bucket is the last category; dropLast makes it all zeros
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True))
        inputs += ohe
        names += [f"{c}=*" for c in text]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    return stages, names


def present_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns with at least one value in ``df`` (one aggregate row).

    An all-missing feature carries no information - a tree never splits on
    it - and MLlib's imputer cannot fit it, so it is left out.
    """
    if not cols:
        return []
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"n{i}"] > 0]


def with_missing_indicators(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``<col>_missing`` = 1.0 where the value is missing."""
    names = [f"{c}_missing" for c in cols]
    return df.withColumns({n: F.col(c).isNull().cast("double") for c, n in zip(cols, names)}), names


# ----------------------------------------------------------------------------- classifier

@dataclass
class ClassifierResult:
    model: PipelineModel | TreeModel
    predictions: DataFrame            # keys, label, split, prediction, probability
    feature_names: list[str]


def train_tree_classifier(ds: DataFrame, label: str = "cluster",
                          drop: Sequence[str] = ("date", "postalcode", "cluster", "consumption"),
                          split_col: str = "split", max_depth: int = 4, min_leaf: int = 20,
                          keys: Sequence[str] = ("postalcode", "date"), task_rows: int = 200_000) -> ClassifierResult:
    """Exact entropy tree (depth 4, at least 20 rows per leaf) on the 'train' rows.

    Labels are 0, 1, ...; missing features are routed by the splits.
    """
    numeric, _ = columns_by_kind(ds, exclude=[*drop, split_col])
    train = ds.where(F.col(split_col) == "train")
    numeric = present_columns(train, numeric)
    classes = int(train.agg(F.max(label)).first()[0]) + 1
    rows = train.select(F.lit(0).alias("tree"), F.col(label).cast("double").alias("y"), feature_array(train, numeric).alias("x"))
    model = TreeModel(grow(rows, {0: (max_depth, min_leaf)}, classes, task_rows), numeric, classes)
    pred = model.transform(ds).select(*keys, label, split_col, F.col("prediction").cast("int").alias("prediction"), "probability")
    return ClassifierResult(model=model, predictions=pred, feature_names=numeric)


def tree_nodes(spark: SparkSession, tree_model, feature_names: Sequence[str]) -> DataFrame:
    """Node table of a fitted tree (of an MLlib one: saved model data read back as a table)."""
    if isinstance(tree_model, TreeModel):
        return node_table(spark, tree_model, feature_names)
    path = scratch_table_path(spark, "tree")
    tree_model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    names = F.array(*[F.lit(n) for n in feature_names])
    is_split = F.col("leftChild") >= 0
    return nodes.select(
        F.col("id").cast("int").alias("node_id"),
        F.when(is_split, F.get(names, F.col("split.featureIndex"))).alias("feature"),
        F.when(is_split, F.get(F.col("split.leftCategoriesOrThreshold"), 0)).alias("threshold"),
        F.when(is_split, F.col("gain")).alias("gain"),
        F.col("impurity"),
        F.col("prediction"),
        F.col("impurityStats").alias("class_counts"),
        F.when(is_split, F.col("leftChild")).alias("left_child"),
        F.when(is_split, F.col("rightChild")).alias("right_child"),
    )


# ----------------------------------------------------------------------------- regressor

@dataclass
class GridResult:
    scores: DataFrame                 # max_depth, min_samples_leaf, fold, mse
    best: dict
    model: PipelineModel | TreeModel
    test_predictions: DataFrame


def _mse(pred: DataFrame, label: str) -> float:
    return pred.agg(F.avg(F.pow(F.col(label) - F.col("prediction"), 2))).first()[0]


def tree_regressor(params: dict, seed: int = 42, max_bins: int = MAX_BINS):
    """MLlib regression tree for one grid point, at most MLLIB_MAX_DEPTH deep."""
    from pyspark.ml.regression import DecisionTreeRegressor
    return DecisionTreeRegressor(labelCol="_y", featuresCol="features", maxDepth=min(params["max_depth"], MLLIB_MAX_DEPTH),
                                 minInstancesPerNode=params["min_samples_leaf"], maxBins=max_bins, seed=seed)


def fitted_as(params: dict) -> tuple:
    """Grid points with the same value are one fit: depths beyond MLlib's limit are fitted at it."""
    return tuple(min(v, MLLIB_MAX_DEPTH) if k == "max_depth" else v for k, v in sorted(params.items()))


def check_depth(model, params: dict) -> None:
    """Raise if a tree asked to be deeper than MLlib allows has grown to the limit."""
    if params.get("max_depth", 0) > MLLIB_MAX_DEPTH and getattr(model, "depth", 0) >= MLLIB_MAX_DEPTH:
        raise ValueError(f"a tree of max_depth {params['max_depth']} reached MLlib's limit of {MLLIB_MAX_DEPTH}")


def tree_grid(depths: Sequence[int] = (15, 25, 40, 60),
              leaves: Sequence[int] = (5, 10, 15, 20)) -> list[dict]:
    """Every depth with every leaf size."""
    return [{"max_depth": d, "min_samples_leaf": lf} for d, lf in itertools.product(depths, leaves)]


def grid_search(spark: SparkSession, folds: DataFrame, test: DataFrame, label: str,
                numeric: Sequence[str], text: Sequence[str], build, grid: Sequence[dict],
                n_splits: int = 5, parallelism: int | None = None) -> GridResult:
    """Every grid point on every expanding fold, mean MSE, best refitted on all training rows.

    Preprocessing is that of each fold's training rows, from statistics of all
    folds gathered at once (``fold_stats``).  ``scores`` has every grid point as
    asked for; points that differ only beyond MLlib's depth are fitted once.
    """
    grid = list(grid)
    keys = sorted(grid[0])
    # every fold's scalers and encoders come from one aggregate each; MLlib trees refuse
    # missing values: numeric features that have any value are imputed with the fold's mean
    numeric = present_columns(folds.where(F.col("train_from_fold").isNotNull()), numeric)

    first_train = folds.where(F.col("train_from_fold") == 0).limit(1).count()
    if not first_train:
        raise ValueError(f"too few training rows for {n_splits} folds: every fold needs rows "
                         "before its test block")
    stages = fold_preprocessing(folds, numeric, text, n_splits)

    def prepare(fold):
        tr, te = fold_frames(folds, fold)
        prep = Pipeline(stages=stages[fold]).fit(tr)        # ready stages: no job
        trp = prep.transform(tr).select("features", F.col(label).cast("double").alias("_y")).persist()
        tep = prep.transform(te).select("features", F.col(label).cast("double").alias("_y")).persist()
        return fold, trp, tep

    same: dict[tuple, list[dict]] = {}
    for g in grid:
        same.setdefault(fitted_as(g), []).append(g)

    def fit_one(task):
        (fold, trp, tep), points = task
        m = build(points[0]).fit(trp)
        for params in points:
            check_depth(m, params)
        mse = _mse(m.transform(tep), "_y")
        return [(*[params[k] for k in keys], fold, mse) for params in points]

    # one fold at a time (each fold's training rows are nearly the whole
    # training set: only one persisted copy exists at any moment); the grid
    # points of a fold are fitted concurrently
    rows = []
    with ThreadPoolExecutor(max_workers=parallelism or len(grid)) as pool:
        for fold in range(n_splits):
            prepared = prepare(fold)
            rows += itertools.chain.from_iterable(pool.map(fit_one, [(prepared, g) for g in same.values()]))
            prepared[1].unpersist()
            prepared[2].unpersist()
    schema = ", ".join(f"{k} int" for k in keys) + ", fold int, mse double"
    scores = spark.createDataFrame(rows, schema)
    mean: dict[tuple, list[float]] = {}
    for r in rows:
        mean.setdefault(tuple(r[:len(keys)]), []).append(r[-1])
    best_key = min(mean, key=lambda p: (sum(mean[p]) / len(mean[p]),
                                        [tuple(g[k] for k in keys) for g in grid].index(p)))
    best_params = dict(zip(keys, best_key))
    best = {**best_params, "mean_mse": sum(mean[best_key]) / len(mean[best_key])}
    all_train = folds.where(F.col("train_from_fold").isNotNull())
    model = Pipeline(stages=[*stages[n_splits], build(best_params)]).fit(
        all_train.withColumn("_y", F.col(label).cast("double")))
    check_depth(model.stages[-1], best_params)
    tp = model.transform(test)
    test_pred = tp.drop(*[c for c in tp.columns if c.startswith("_") or c == "features"])
    return GridResult(scores=scores, best=best, model=model, test_predictions=test_pred)


def exact_tree_grid(spark: SparkSession, folds: DataFrame, test: DataFrame, label: str, numeric: Sequence[str], text: Sequence[str],
                    grid: Sequence[dict], n_splits: int = 5, task_rows: int = 200_000) -> GridResult:
    """M18-M24 with exact regression trees: every grid point at its own depth on every expanding fold.

    All folds and leaf sizes are grown together, each to the deepest depth
    asked for; shallower grid points are the same trees cut there.  Trees do not
    change when features are scaled, so none are; text values are 0/1 features,
    and one that a fold's training rows lack is constant there and never split on.
    """
    train = folds.where(F.col("train_from_fold").isNotNull())
    numeric = present_columns(train, numeric)
    texts = {c: sorted(r[0] for r in train.select(c).distinct().collect() if r[0] is not None) for c in text}
    x, y = feature_array(folds, numeric, texts).alias("x"), F.col(label).cast("double").alias("y")
    rows = cut_lineage(folds.select("train_from_fold", "test_fold", y, x))
    if not rows.where("train_from_fold = 0").limit(1).count():
        raise ValueError(f"too few training rows for {n_splits} folds: every fold needs rows "
                         "before its test block")
    depths, leaves = sorted({g["max_depth"] for g in grid}), sorted({g["min_samples_leaf"] for g in grid})
    tree = lambda fold, leaf: fold * len(leaves) + leaf                                    # noqa: E731
    every = F.explode(F.array(*[F.lit(i) for i in range(len(leaves))])).alias("leaf")
    fold = F.explode(F.sequence(F.col("train_from_fold").cast("int"), F.lit(n_splits - 1))).alias("fold")
    copies = rows.where(F.col("train_from_fold") < n_splits).select(fold, "y", "x").select(
        (F.col("fold") * len(leaves)).alias("first"), "y", "x", every).select((F.col("first") + F.col("leaf")).cast("int").alias("tree"), "y", "x")
    limits = {tree(f, i): (depths[-1], m) for f in range(n_splits) for i, m in enumerate(leaves)}
    nodes = grow(copies, limits, task_rows=task_rows)
    tests = rows.where(F.col("test_fold").between(0, n_splits - 1)).select(F.col("test_fold").cast("int").alias("fold"), "y", F.col("x").alias("_x"), every)
    routed = route(tests.withColumn("_tree", (F.col("fold") * len(leaves) + F.col("leaf")).cast("int")), nodes, depths)
    each = routed.select("fold", "leaf", "y", F.posexplode("_at").alias("at", "s"))
    error = each.groupBy("fold", "leaf", "at").agg(F.avg(F.pow(F.col("y") - F.col("s")[1] / F.col("s")[0], 2)).alias("mse"))
    mse = {(r.fold, depths[r.at], leaves[r.leaf]): r.mse for r in error.collect()}           # folds x grid points
    scored = [(g["max_depth"], g["min_samples_leaf"], f, mse[f, g["max_depth"], g["min_samples_leaf"]]) for g in grid for f in range(n_splits)]
    scores = spark.createDataFrame(scored, "max_depth int, min_samples_leaf int, fold int, mse double")
    mean = [sum(mse[f, g["max_depth"], g["min_samples_leaf"]] for f in range(n_splits)) / n_splits for g in grid]
    best = {**grid[mean.index(min(mean))], "mean_mse": min(mean)}
    last = rows.where("train_from_fold is not null").select(F.lit(0).alias("tree"), "y", "x")
    model = TreeModel(grow(last, {0: (best["max_depth"], best["min_samples_leaf"])}, task_rows=task_rows), numeric, 0, texts)
    return GridResult(scores=scores, best=best, model=model, test_predictions=model.transform(test))


def grid_search_tree_regressor(spark: SparkSession, folds: DataFrame, test: DataFrame, label: str,
                               numeric: Sequence[str], text: Sequence[str],
                               depths: Sequence[int] = (15, 25, 40, 60),
                               leaves: Sequence[int] = (5, 10, 15, 20), n_splits: int = 5,
                               seed: int = 42, parallelism: int | None = None) -> GridResult:
    """The reference's single model: regression tree over depth x min-leaf."""
    return grid_search(spark, folds, test, label, numeric, text,
                       lambda p: tree_regressor(p, seed), tree_grid(depths, leaves),
                       n_splits=n_splits, parallelism=parallelism)
