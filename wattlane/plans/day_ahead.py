"""Task 2: day-ahead classification of the daily load-curve cluster.

weather -> daily weather; cleaned consumption -> daily consumption + labels;
left joins with socioeconomic, cadaster and weather; labelled days only;
80/20 key-hash split; entropy tree (depth 4, 20 rows per leaf); accuracy per
split; node table of the tree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from wattlane.operators.daily import consumption_daily, weather_daily
from wattlane.operators.enrich import classification_dataset, labelled_days
from wattlane.operators.metrics import accuracy_by_split
from wattlane.operators.models import train_tree_classifier, tree_nodes
from wattlane.operators.splits import hash_split
from wattlane.session import cut_lineage


@dataclass
class DayAhead:
    dataset: DataFrame
    predictions: DataFrame
    accuracy: DataFrame
    spark: SparkSession
    result: object

    @property
    def nodes(self) -> DataFrame:
        """M14 node table (saves the tree model when first asked for)."""
        return tree_nodes(self.spark, self.result.model.stages[-1], self.result.feature_names)


def predict_day_ahead(spark: SparkSession, consumption_days: DataFrame, weather: DataFrame,
                      socio: DataFrame, cadaster: DataFrame, labels: DataFrame | None = None,
                      daily_input: bool = False) -> DayAhead:
    """``consumption_days``: cleaned hourly rows (``date`` column), or already
    daily rows when ``daily_input``."""
    cons = consumption_days if daily_input else consumption_daily(consumption_days, labels)
    ds = labelled_days(classification_dataset(cons, weather_daily(weather), socio, cadaster))
    # one row per labelled day: materialised once in the shared folder, the
    # imputer, the tree levels and the predictions all read it
    ds = cut_lineage(hash_split(ds, ["postalcode", "date"], test_pct=20, seed=42))
    res = train_tree_classifier(ds)
    acc = accuracy_by_split(res.predictions)
    return DayAhead(dataset=ds, predictions=res.predictions, accuracy=acc, spark=spark, result=res)


def write_outputs(result: DayAhead, base_path: str) -> dict[str, str]:
    """Predictions, accuracy per split and the tree's node table."""
    from wattlane.sources.sinks import write_tables
    return write_tables({"predictions": result.predictions, "accuracy": result.accuracy,
                         "tree_nodes": result.nodes}, base_path)
