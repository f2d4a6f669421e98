"""Cadaster preparation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlane.functions.missing import sum_or_zero

# Column renames and filter values of the reference.
CADASTER_RENAMES = {
    "numberOfDwellings": "households",
    "reference": "cadastralref",
    "value": "builtarea",
    "currentUse": "currentuse",
    "conditionOfConstruction": "condition",
}
POSTAL_RENAMES = {"PROV": "provincecode", "CODPOS": "postalcode"}
RESIDENTIAL = "1_residential"
FUNCTIONAL = "functional"
CADASTER_COLUMNS = ("postalcode", "currentuse", "condition", "households", "cadastralref", "builtarea")


def _isin(col: str, values: str | Sequence[str]):
    if isinstance(values, str):
        return F.col(col) == F.lit(values)
    return F.col(col).isin(list(values))


def rename_cadaster(buildings: DataFrame) -> DataFrame:
    """P1."""
    return buildings.withColumnsRenamed(
        {k: v for k, v in CADASTER_RENAMES.items() if k in buildings.columns})


def rename_postal(polygons: DataFrame) -> DataFrame:
    """P2."""
    return polygons.withColumnsRenamed(
        {k: v for k, v in POSTAL_RENAMES.items() if k in polygons.columns})


def residential_buildings(buildings_with_area: DataFrame,
                          use_values: str | Sequence[str] = RESIDENTIAL,
                          condition_values: str | Sequence[str] = FUNCTIONAL) -> DataFrame:
    """Renamed, selected, filtered buildings with a postal code."""
    df = rename_cadaster(buildings_with_area).select(*CADASTER_COLUMNS)
    return (df.where(_isin("currentuse", use_values) & _isin("condition", condition_values))
              .where(F.col("postalcode").isNotNull()))


def cadaster_by_area(buildings_with_area: DataFrame,
                     use_values: str | Sequence[str] = RESIDENTIAL,
                     condition_values: str | Sequence[str] = FUNCTIONAL) -> DataFrame:
    """Built area and households per postal code (partial aggregation before the shuffle)."""
    df = residential_buildings(buildings_with_area, use_values, condition_values)
    return df.groupBy("postalcode").agg(sum_or_zero("builtarea").cast("long").alias("builtarea"),
                                        sum_or_zero("households").cast("long").alias("households"))


def append_buildings(*parts: DataFrame) -> DataFrame:
    """Bag union by column name; columns missing in a part become NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
