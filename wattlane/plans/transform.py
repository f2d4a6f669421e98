"""Data preparation shared by the three tasks.

Hourly consumption -> cleaned series; buildings x postal polygons -> built
area and households per postal code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from wattlane.operators.cadaster import cadaster_by_area, rename_postal
from wattlane.operators.rolling import clean_series
from wattlane.operators.spatial import join_within, to_cadaster_crs


def transform_consumption_data(consumption: DataFrame, buildings: DataFrame, postal_polygons: DataFrame,
                               polygons_srid: int = 25831, cell: float | None = None,
                               ) -> tuple[DataFrame, DataFrame]:
    """(cleaned hourly series, cadaster per postal code).

    ``buildings``: GML field names and a ``geometry`` ring (cadaster CRS);
    ``postal_polygons``: ``PROV``, ``CODPOS``, ``exterior``, ``holes`` in
    ``polygons_srid``.
    """
    cleaned = clean_series(consumption)
    polys = to_cadaster_crs(rename_postal(postal_polygons), polygons_srid)
    with_area = join_within(buildings, polys.select("postalcode", "exterior", "holes"), cell=cell)
    return cleaned, cadaster_by_area(with_area)
