"""Task 3: hourly consumption forecast.

hourly rows joined to socioeconomic, cadaster and weather (inner); rows with
a target; chronological hold-out of the last 20 x 96 x len(postalcodes)
rows; grid search of a regression tree over five expanding folds of 96 rows;
refit; MSE / RMSE / CVRMSE on the hold-out; predicted vs actual windows for
the listed postal codes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlane.operators.enrich import forecast_dataset
from wattlane.operators.metrics import forecast_slices, regression_metrics
from wattlane.operators.models import GridResult, columns_by_kind, exact_tree_grid, grid_search, tree_grid
from wattlane.operators.splits import holdout_size, holdout_with_folds, with_row_id

TARGET = "consumption_filtered"
# Columns the reference removes before choosing features.
NOT_FEATURES = ("localtime", "time", "consumption_filtered", "consumption")
# The reference's grid.
DEPTHS = (15, 25, 40, 60)
LEAVES = (5, 10, 15, 20)

# Models by name -> (builder of an MLlib estimator, or None for the exact tree; grid).  The reference has one.
MODELS = {
    "Decision Tree": (None, tree_grid(DEPTHS, LEAVES)),
}


@dataclass
class Forecast:
    grids: dict[str, GridResult]
    metrics: dict[str, DataFrame]
    holdout: DataFrame
    make_slices: Callable[[str], DataFrame]

    @property
    def grid(self) -> GridResult:
        return next(iter(self.grids.values()))

    @property
    def slices(self) -> dict[str, DataFrame]:
        """Predicted-vs-actual windows per model; predicted when asked for."""
        return {name: self.make_slices(name) for name in self.grids}


def electricity_consumption_forecast(spark: SparkSession, cleaned: DataFrame, weather: DataFrame,
                                     socio: DataFrame, cadaster: DataFrame,
                                     postalcodes: Sequence[str], n_splits: int = 5,
                                     fold_rows: int = 96, parallelism: int | None = None,
                                     models: dict | None = None,
                                     holdout_rows: int | None = None) -> Forecast:
    """``holdout_rows`` defaults to the reference's 20 x 96 rows per listed postal code.

    The joined table is written once; hold-out and folds come from one ranking of
    its last rows, joined to it by row id.
    """
    data = with_row_id(forecast_dataset(cleaned, weather, socio, cadaster))
    with_target = data.where(F.col(TARGET).isNotNull())
    numeric, text = columns_by_kind(with_target, exclude=(*NOT_FEATURES, "_rid"))
    n_test = holdout_rows if holdout_rows is not None else holdout_size(len(postalcodes))
    hold = holdout_with_folds(with_target, n_test, n_splits, fold_rows).drop("_rid")
    folds = hold.where(F.col("split") == "train")
    test = hold.where(F.col("split") == "test")
    grids, metrics = {}, {}
    for name, (build, grid_points) in (models or MODELS).items():
        if build is None:
            g = exact_tree_grid(spark, folds, test, TARGET, numeric, text, grid_points, n_splits=n_splits)
        else:
            g = grid_search(spark, folds, test, TARGET, numeric, text, build, grid_points,
                            n_splits=n_splits, parallelism=parallelism)
        grids[name] = g
        metrics[name] = regression_metrics(g.test_predictions, TARGET, "prediction")

    def make_slices(name: str) -> DataFrame:
        all_rows = grids[name].model.transform(data.drop("_rid").where(F.col("postalcode").isin(list(postalcodes))))
        pred = all_rows.select("postalcode", "ts_utc", "localtime", "consumption",
                               F.col("prediction").alias("predicted"))
        return forecast_slices(pred, postalcodes, hours=fold_rows, npred=10)

    return Forecast(grids=grids, metrics=metrics, holdout=hold.drop("test_fold", "train_from_fold"), make_slices=make_slices)


def write_outputs(result: Forecast, base_path: str) -> dict[str, str]:
    """Per model the grid scores, hold-out metrics and predicted-vs-actual windows."""
    from wattlane.sources.sinks import write_tables
    tables, slices = {}, result.slices
    for name, g in result.grids.items():
        slug = name.lower().replace(" ", "_")
        tables[f"{slug}_grid"] = g.scores
        tables[f"{slug}_metrics"] = result.metrics[name]
        tables[f"{slug}_windows"] = slices[name]
    return write_tables(tables, base_path)
