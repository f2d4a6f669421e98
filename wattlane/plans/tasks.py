"""All three tasks from input files to output tables.

    python -m wattlane.plans.tasks --consumption C.parquet --weather W.parquet \
        --socioeconomic S.parquet --buildings a.gml b.gml --polygons P.parquet \
        --out OUT_DIR [--polygons-srid 4326] [--postalcodes 25001 25193]

Inputs are read with Spark (parquet; GML through the XML source), every
result is written as parquet under ``OUT_DIR/<task>/<table>``.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from wattlane.plans.day_ahead import predict_day_ahead
from wattlane.plans.day_ahead import write_outputs as write_day_ahead
from wattlane.plans.forecast import electricity_consumption_forecast
from wattlane.plans.forecast import write_outputs as write_forecast
from wattlane.plans.load_curves import identify_load_curves
from wattlane.plans.load_curves import write_outputs as write_load_curves
from wattlane.plans.transform import transform_consumption_data
from wattlane.session import cut_lineage
from wattlane.sources.gml import read_gml_buildings
from wattlane.sources.sinks import write_tables
from wattlane.sources.tables import read_consumption, read_socioeconomic, read_weather


def run_tasks(spark: SparkSession, consumption: DataFrame, weather: DataFrame, socio: DataFrame,
              buildings: DataFrame, polygons: DataFrame, out_dir: str,
              postalcodes: Sequence[str], polygons_srid: int = 25831,
              scaling_method: str = "z_norm_scaling", n_clusters: int = 3,
              do_silhouette: bool = False,
              holdout_rows: int | None = None) -> dict[str, dict[str, str]]:
    out = out_dir.rstrip("/")
    cleaned, cadaster = transform_consumption_data(consumption, buildings, polygons, polygons_srid)
    # read by all three tasks: materialised once in the shared folder
    cleaned = cut_lineage(cleaned)
    written = {"prepared": write_tables({"cadaster_by_area": cadaster}, f"{out}/prepared")}
    curves = identify_load_curves(cleaned, scaling_method, n_clusters, do_silhouette)
    written["load_curves"] = write_load_curves(curves, f"{out}/load_curves")
    day = predict_day_ahead(spark, cleaned, weather, socio, cadaster, curves.labels)
    written["day_ahead"] = write_day_ahead(day, f"{out}/day_ahead")
    fc = electricity_consumption_forecast(spark, cleaned, weather, socio, cadaster, postalcodes,
                                          holdout_rows=holdout_rows)
    written["forecast"] = write_forecast(fc, f"{out}/forecast")
    return written


def main(argv: Sequence[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--consumption", required=True)
    ap.add_argument("--weather", required=True)
    ap.add_argument("--socioeconomic", required=True)
    ap.add_argument("--buildings", nargs="+", required=True)
    ap.add_argument("--buildings-row-tag", default="bu-ext2d:Building")
    ap.add_argument("--polygons", required=True)
    ap.add_argument("--polygons-srid", type=int, default=25831)
    ap.add_argument("--postalcodes", nargs="+", default=["25001", "25193"])
    ap.add_argument("--out", required=True)
    a = ap.parse_args(argv)
    from wattlane.session import get_session
    spark = get_session()   # the launcher names the master
    run_tasks(spark, read_consumption(spark, a.consumption), read_weather(spark, a.weather),
              read_socioeconomic(spark, a.socioeconomic),
              read_gml_buildings(spark, a.buildings, a.buildings_row_tag),
              spark.read.parquet(a.polygons), a.out, a.postalcodes, a.polygons_srid)


if __name__ == "__main__":
    main()
