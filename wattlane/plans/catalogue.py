"""Query catalogue: one Spark query per operator group of the inventory.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame over the
stand-in tables.  Its DuckDB twin (same column names) lives in
:mod:`wattlane.plans.oracle_sql`; entries without a twin are checked by
unit tests against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wattlane.operators.rolling import clean_series
from wattlane.sources import standins as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CLEAN_COLS = ["postalcode", "time", "consumption", "contracts", "localtime", "hour", "date",
              "rolling_mean", "rolling_std", "rolling_q10", "z_norm", "consumption_filtered"]


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def cleaned_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned hourly series every later step starts from."""
    return clean_series(S.meter_hourly(spark, sf_dir))


@query("clean_series")
def q_clean_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned_meter(spark, sf_dir).select(*CLEAN_COLS)


@query("clean_many_series")
def q_clean_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One short series per user."""
    return clean_series(S.meter_users(spark, sf_dir)).select(*CLEAN_COLS)


@query("clean_skewed_series")
def q_clean_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series with a third of all rows, with tied instants."""
    return clean_series(S.meter_skewed(spark, sf_dir)).select(*CLEAN_COLS)


# ------------------------------------------------------------------ rolling, calendar

@query("rolling_nearest_q10")
def q_rolling_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wattlane.functions.calendar import with_local_calendar
    from wattlane.operators.rolling import RollingSpec, rolling
    spec = RollingSpec("rolling_q10_nearest", "quantile", window=168, min_periods=24, q=0.1,
                       interpolation="nearest")
    df = with_local_calendar(S.meter_hourly(spark, sf_dir))
    return rolling(df, "consumption", [spec]).select("postalcode", "time", "consumption",
                                                     "rolling_q10_nearest")


@query("calendar_fields")
def q_calendar_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from wattlane.functions import calendar as C
    from wattlane.sources.tables import read_table
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts"])
    ev = C.with_local_calendar(ev, "ts")
    return ev.select(
        "event_id", "localtime", "hour", "date",
        C.year_of("localtime").alias("year"),
        C.month_number("localtime").alias("month"),
        C.month_text("localtime").alias("month_text"),
        C.weekday_monday0("date").alias("weekday"),
        C.weekday_iso_text("localtime").alias("weekday_iso"),
        C.bucket_start("hour", 3).alias("bucket"),
        C.year_of(F.date_format("date", "yyyy"), T.StringType()).alias("year_from_text"),
    )


# ------------------------------------------------------------------ daily totals, profiles

@query("strict_daily_total")
def q_strict_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wattlane.operators.profiles import strict_daily_total
    df = strict_daily_total(cleaned_meter(spark, sf_dir))
    return df.select("postalcode", "time", "date", "consumption_filtered", "daily_consumption")


@query("lenient_daily_total")
def q_lenient_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wattlane.operators.profiles import lenient_daily_total
    return lenient_daily_total(cleaned_meter(spark, sf_dir))


def profile_long_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wattlane.operators.profiles import profile_long
    return profile_long(cleaned_meter(spark, sf_dir), n_hours=3)


def profile_wide_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wattlane.operators.profiles import profile_wide
    return profile_wide(profile_long_meter(spark, sf_dir), n_hours=3)


@query("daily_profile_long")
def q_profile_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_long_meter(spark, sf_dir)


@query("daily_profile_wide")
def q_profile_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_wide_meter(spark, sf_dir)


def _scaled(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    from wattlane.operators.profiles import bucket_columns, complete_days
    from wattlane.operators.scaling import scale_data
    cols = bucket_columns(3)
    return complete_days(scale_data(profile_wide_meter(spark, sf_dir), cols, method), cols)


@query("unscaled")
def q_unscaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(spark, sf_dir, "no_scaling")


@query("scaled_minmax")
def q_scaled_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(spark, sf_dir, "min_max_scaling")


@query("scaled_znorm")
def q_scaled_znorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(spark, sf_dir, "z_norm_scaling")


# ------------------------------------------------------------------ curves

def rule_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels for complete profile days: weekend days are cluster 1, working days 0."""
    from pyspark.sql import functions as F

    from wattlane.operators.profiles import bucket_columns, complete_days
    days = complete_days(profile_wide_meter(spark, sf_dir), bucket_columns(3))
    return days.select("postalcode", "date",
                       F.when(F.weekday("date") >= 5, 1).otherwise(0).alias("cluster"))


def labelled_meter_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wattlane.operators.curves import labelled_hours
    return labelled_hours(cleaned_meter(spark, sf_dir), rule_labels(spark, sf_dir))


@query("daily_curve_list")
def q_daily_curve_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wattlane.operators.curves import daily_curve_list
    return daily_curve_list(labelled_meter_hours(spark, sf_dir))


@query("centroids_long")
def q_centroids_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wattlane.operators.curves import centroids_long
    return centroids_long(labelled_meter_hours(spark, sf_dir))


@query("centroids_wide")
def q_centroids_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wattlane.operators.curves import centroids_wide
    return centroids_wide(labelled_meter_hours(spark, sf_dir))


@query("cluster_ids")
def q_cluster_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wattlane.operators.curves import cluster_ids
    return cluster_ids(labelled_meter_hours(spark, sf_dir))


# ------------------------------------------------------------------ daily aggregates, datasets

@query("weather_daily")
def q_weather_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wattlane.operators.daily import weather_daily
    return weather_daily(S.weather_hourly_rows(spark, sf_dir))


@query("consumption_daily")
def q_consumption_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wattlane.operators.daily import consumption_daily
    return consumption_daily(cleaned_meter(spark, sf_dir), rule_labels(spark, sf_dir))


def nation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels for every nation day, not determined by any one feature: summer half-year and
    weekend give four classes, a key hash moves 15 % of the days to the next one."""
    from pyspark.sql import functions as F

    from wattlane.operators.daily import daily_from_instants
    from wattlane.operators.splits import key_hash_bucket
    rows = daily_from_instants(S.nation_daily_orders(spark, sf_dir))
    rule = F.month("date").between(4, 9).cast("int") + 2 * (F.weekday("date") >= 5).cast("int")
    moved = (key_hash_bucket(["postalcode", "date"], seed=7) < 15).cast("int")
    # same key order as the daily aggregate it is joined to: the join reuses its partitioning
    return (rows.groupBy("date", "postalcode").agg(F.count(F.lit(1)).alias("_n"))
                .select("postalcode", "date", ((rule + moved) % 4).cast("int").alias("cluster")))


def cadaster_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wattlane.operators.cadaster import cadaster_by_area
    return cadaster_by_area(S.buildings_raw(spark, sf_dir), use_values="ECONOMY",
                            condition_values=("Brand#17", "Brand#2"))


def classification_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wattlane.operators.daily import consumption_daily, daily_from_instants, weather_daily
    from wattlane.operators.enrich import classification_dataset, labelled_days
    cons = consumption_daily(daily_from_instants(S.nation_daily_orders(spark, sf_dir)),
                             nation_labels(spark, sf_dir))
    ds = classification_dataset(cons, weather_daily(S.weather_hourly_rows(spark, sf_dir)),
                                S.socio_nation(spark, sf_dir), cadaster_nation(spark, sf_dir))
    return labelled_days(ds)


@query("classification_dataset")
def q_classification_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classification_rows(spark, sf_dir)


def forecast_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wattlane.operators.enrich import forecast_dataset
    return forecast_dataset(cleaned_meter(spark, sf_dir), S.hourly_weather(spark, sf_dir),
                            S.socio_events(spark, sf_dir), S.area_events(spark, sf_dir))


@query("forecast_dataset")
def q_forecast_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast_rows(spark, sf_dir)


# ------------------------------------------------------------------ cadaster

@query("cadaster_by_area")
def q_cadaster_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cadaster_nation(spark, sf_dir)


@query("append_buildings")
def q_append_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three 'municipality' files: small, medium and large buildings; the
    large-building file carries no dwelling count."""
    from pyspark.sql import functions as F

    from wattlane.operators.cadaster import append_buildings
    b = S.buildings_raw(spark, sf_dir)
    small = b.where(F.col("value") < 17)
    medium = b.where((F.col("value") >= 17) & (F.col("value") < 34))
    large = b.where(F.col("value") >= 34).drop("numberOfDwellings")
    return append_buildings(small, medium, large)


# ------------------------------------------------------------------ splits, metrics

AREA_PARTS = 4                           # user groups per event type: enough rows for the hold-out
PLOT_CODES = ["click-0", "view-0"]       # the two postal codes plotted (stand-in values)


def forecast_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Cleaned series, weather, socioeconomic and cadaster by (event type, user group)."""
    return (clean_series(S.meter_hourly(spark, sf_dir, AREA_PARTS)), S.hourly_weather(spark, sf_dir, AREA_PARTS),
            S.socio_events(spark, sf_dir, AREA_PARTS), S.area_events(spark, sf_dir, AREA_PARTS))


def forecast_area_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wattlane.operators.enrich import forecast_dataset
    return forecast_dataset(*forecast_inputs(spark, sf_dir))


def forecast_with_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    return forecast_area_rows(spark, sf_dir).where(F.col("consumption_filtered").isNotNull())


def holdout_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hold-out of 20 x 96 rows per plotted code, and the folds, from one ranking."""
    from wattlane.operators.splits import holdout_size, holdout_with_folds
    return holdout_with_folds(forecast_with_target(spark, sf_dir), holdout_size(len(PLOT_CODES)))


@query("forecast_features")
def q_forecast_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wattlane.operators.enrich import forecast_features
    return forecast_features(forecast_rows(spark, sf_dir))


def profile_mean_prediction(train: DataFrame) -> DataFrame:
    """Rule-made predictions: mean training target of the same postal code and hour."""
    from pyspark.sql import functions as F
    return train.groupBy("postalcode", "hour").agg(F.avg("consumption_filtered").alias("prediction"))


@query("hash_split")
def q_hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wattlane.operators.splits import hash_split
    return hash_split(classification_rows(spark, sf_dir), ["postalcode", "date"]).select(
        "postalcode", "date", "cluster", "split")


@query("chrono_holdout")
def q_chrono_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdout_rows(spark, sf_dir).select("postalcode", "ts_utc", "consumption_filtered", "split")


@query("expanding_folds")
def q_expanding_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    return holdout_rows(spark, sf_dir).where(F.col("split") == "train").select(
        "postalcode", "ts_utc", "test_fold", "train_from_fold")


#: The features of the fold statistics below: numbers with and without missing values, and texts.
FOLD_NUMERIC, FOLD_TEXT = ["hour", "contracts", "gappy"], ["postalcode", "month", "weekday"]


def fold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from wattlane.session import cut_lineage
    hold = holdout_rows(spark, sf_dir).withColumn(
        "gappy", F.when(F.col("hour") % 5 != 0, F.col("consumption")))      # a feature with gaps
    return cut_lineage(hold.select("train_from_fold", *FOLD_NUMERIC, *FOLD_TEXT))


@query("fold_scalers")
def q_fold_scalers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and std of every numeric feature in every fold, from one aggregate."""
    from wattlane.operators.fold_stats import fold_scalers
    return fold_scalers(fold_rows(spark, sf_dir), FOLD_NUMERIC)


@query("fold_categories")
def q_fold_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fold that knows each text value."""
    from wattlane.operators.fold_stats import fold_categories
    return fold_categories(fold_rows(spark, sf_dir), FOLD_TEXT)


@query("accuracy_by_split")
def q_accuracy_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from wattlane.operators.metrics import accuracy_by_split
    from wattlane.operators.splits import hash_split
    ds = hash_split(classification_rows(spark, sf_dir), ["postalcode", "date"])
    pred = ds.withColumn("prediction", F.when(F.col("airtemperature") > 25, 1).otherwise(0))
    return accuracy_by_split(pred)


@query("regression_metrics")
def q_regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from wattlane.operators.metrics import regression_metrics
    hold = holdout_rows(spark, sf_dir)
    prof = profile_mean_prediction(hold.where(F.col("split") == "train"))
    test = hold.where(F.col("split") == "test").join(prof, ["postalcode", "hour"])
    return regression_metrics(test, "consumption_filtered", "prediction")


@query("forecast_slices")
def q_forecast_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from wattlane.operators.metrics import forecast_slices
    hold = holdout_rows(spark, sf_dir)
    prof = profile_mean_prediction(hold.where(F.col("split") == "train"))
    pred = (forecast_area_rows(spark, sf_dir).join(prof, ["postalcode", "hour"], "left")
            .withColumnRenamed("prediction", "predicted"))
    return forecast_slices(pred, PLOT_CODES, hours=96, npred=10).select(
        "postalcode", "slice", "offset", "localtime", "predicted", "consumption")


# ------------------------------------------------------------------ clustering

N_CLUSTERS = 3
SCALING = "z_norm_scaling"


def load_curves_result(spark: SparkSession, sf_dir: str, do_silhouette: bool = False):
    from wattlane.plans.load_curves import identify_load_curves
    return identify_load_curves(cleaned_meter(spark, sf_dir), scaling_method=SCALING,
                                n_clusters=N_CLUSTERS, do_silhouette=do_silhouette)


@query("ward_labels")
def q_ward_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_curves_result(spark, sf_dir).labels


@query("ward_merges")
def q_ward_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_curves_result(spark, sf_dir).ward.merges


@query("ward_top_merges")
def q_ward_top_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_curves_result(spark, sf_dir).tables["top_merges"]


@query("silhouette_sweep")
def q_silhouette_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_curves_result(spark, sf_dir, do_silhouette=True).tables["silhouette"]


def embedding_dims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    from pyspark.sql import functions as F

    from wattlane.sources.tables import read_table
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    lo, hi = emb.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if lo != hi:
        raise ValueError(f"vectors of one length are needed, found {lo} to {hi}")
    dim = lo or 0
    cols = [f"e{i}" for i in range(dim)]
    return emb.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c)
                                           for i, c in enumerate(cols)]), cols


@query("ward_embeddings")
def q_ward_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wattlane.operators.ward import ward
    emb, cols = embedding_dims(spark, sf_dir)
    return ward(emb, cols, [10], keys=["vec_id"]).labels[10]


@query("kmeans_labels")
def q_kmeans_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wattlane.operators.ward import kmeans_labels
    emb, cols = embedding_dims(spark, sf_dir)
    return kmeans_labels(emb, cols, ["vec_id"], k=10)


@query("silhouette_given_labels")
def q_silhouette_given_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wattlane.operators.silhouette import euclidean_silhouette, silhouette_score
    from wattlane.sources.tables import read_table
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    plain = euclidean_silhouette(emb, "embedding", ["label"]).drop("labelling", "n")
    return silhouette_score(emb, "embedding", "label").join(plain)          # one row each


# ------------------------------------------------------------------ models

def day_ahead_result(spark: SparkSession, sf_dir: str):
    from wattlane.operators.daily import consumption_daily, daily_from_instants
    from wattlane.plans.day_ahead import predict_day_ahead
    cons = consumption_daily(daily_from_instants(S.nation_daily_orders(spark, sf_dir)),
                             nation_labels(spark, sf_dir))
    return predict_day_ahead(spark, cons, S.weather_hourly_rows(spark, sf_dir),
                             S.socio_nation(spark, sf_dir), cadaster_nation(spark, sf_dir),
                             daily_input=True)


@query("tree_classify")
def q_tree_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_ahead_result(spark, sf_dir).predictions


@query("tree_accuracy")
def q_tree_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_ahead_result(spark, sf_dir).accuracy


@query("tree_nodes")
def q_tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_ahead_result(spark, sf_dir).nodes


def forecast_result(spark: SparkSession, sf_dir: str):
    from wattlane.plans.forecast import electricity_consumption_forecast
    return electricity_consumption_forecast(spark, *forecast_inputs(spark, sf_dir), PLOT_CODES)


@query("grid_results")
def q_grid_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast_result(spark, sf_dir).grid.scores


@query("tree_forecast")
def q_tree_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast_result(spark, sf_dir).grid.test_predictions.select(
        "postalcode", "ts_utc", "consumption_filtered", "prediction")


@query("forecast_metrics")
def q_forecast_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast_result(spark, sf_dir).metrics["Decision Tree"]


# ------------------------------------------------------------------ spatial

@query("within_join")
def q_within_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wattlane.operators.cadaster import rename_postal
    from wattlane.operators.spatial import join_within
    polys = rename_postal(S.postal_polygons(spark))
    return join_within(S.footprints(spark, sf_dir), polys, cell=500.0).select("cadastralref", "postalcode")


@query("cadaster_spatial_by_area")
def q_cadaster_spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cadaster preparation path: spatial join, rename, filter, sum per area."""
    from wattlane.operators.cadaster import cadaster_by_area, rename_postal
    from wattlane.operators.spatial import join_within
    polys = rename_postal(S.postal_polygons(spark))
    joined = join_within(S.footprint_buildings(spark, sf_dir), polys, cell=500.0)
    return cadaster_by_area(joined, use_values="HOUSEHOLD", condition_values="functional")


@query("ring_centroid")
def q_ring_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from wattlane.functions.geometry import centroid
    fp = S.footprints(spark, sf_dir).select(F.col("cadastralref").alias("id"),
                                            centroid("geometry").alias("c"))
    pg = S.postal_polygons(spark).select(F.col("CODPOS").alias("id"), centroid("exterior", "holes").alias("c"))
    return fp.unionByName(pg).select("id", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))


def lonlat_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer points placed around Lleida in degrees."""
    from pyspark.sql import functions as F

    from wattlane.sources.tables import read_table
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal"])
    return c.select("c_custkey",
                    (F.lit(0.3) + (F.col("c_custkey") % 100) * F.lit(0.006)).alias("lon"),
                    (F.lit(41.5) + (F.col("c_acctbal") + F.lit(1000.0)) / F.lit(100000.0)).alias("lat"))


@query("reproject")
def q_reproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from wattlane.functions.geometry import lonlat_to_tm
    p = lonlat_points(spark, sf_dir).withColumn("_p", lonlat_to_tm("lon", "lat"))
    return p.select("c_custkey", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))


@query("profile_csv")
def q_profile_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long profile written as CSV to the shared folder and read back."""
    from wattlane.session import scratch_table_path
    from wattlane.sources.sinks import read_profile_csv, write_profile_csv
    path = scratch_table_path(spark, "profile-csv")
    write_profile_csv(profile_long_meter(spark, sf_dir), path)
    return read_profile_csv(spark, path)


@query("gml_buildings")
def q_gml_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 round trip: footprint buildings written as GML features, read back by element paths."""
    from wattlane.session import scratch_table_path
    from wattlane.sources.gml import read_gml_buildings, write_gml_buildings
    path = scratch_table_path(spark, "gml")
    write_gml_buildings(S.building_parts(spark, sf_dir), path)
    from pyspark.sql import functions as F
    rings = F.flatten(F.transform("parts", lambda p: F.concat(F.array(p["exterior"]), p["holes"])))
    b = read_gml_buildings(spark, path, row_tag="Building").withColumn("rings", rings)
    return b.select(
        "reference", "currentUse", "conditionOfConstruction", "numberOfDwellings", "value",
        F.transform("rings", lambda r: F.size(r)).alias("ring_sizes"),
        F.flatten(F.transform(F.flatten("rings"), lambda p: F.array(p["x"], p["y"]))).alias("coords"))


@query("within_join_parts")
def q_within_join_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 on whole buildings: every patch must lie within."""
    from wattlane.operators.cadaster import rename_postal
    from wattlane.operators.spatial import join_within
    polys = rename_postal(S.postal_polygons(spark))
    return join_within(S.building_parts(spark, sf_dir), polys, cell=500.0, parts="parts").select("reference", "postalcode")


@query("wkt_within")
def q_wkt_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons from a table with WKT text."""
    from wattlane.functions.geometry import polygon_from_wkt
    from wattlane.operators.spatial import join_within
    polys = S.nation_wkt(spark, sf_dir).withColumn("p", polygon_from_wkt("wkt")).select("postalcode", "p.exterior", "p.holes")
    return join_within(S.footprints(spark, sf_dir), polys, cell=500.0).select("cadastralref", "postalcode")


@query("text_missing")
def q_text_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text 'NaN' as missing, counted."""
    from pyspark.sql import functions as F

    from wattlane.sources.tables import read_table, text_nan_to_null
    ev = read_table(spark, sf_dir, "events", ["user_id", "event_type"])
    text = F.when(F.col("user_id") % 10 == 0, F.lit("NaN")).otherwise(F.col("event_type"))
    return ev.select(text_nan_to_null(text).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("unlabelled_curves")
def q_unlabelled_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without labels every hour is in cluster 1."""
    from wattlane.operators.curves import centroids_long, labelled_hours
    return centroids_long(labelled_hours(cleaned_meter(spark, sf_dir), None))


@query("tables_round_trip")
def q_tables_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figure tables written with write_tables; the wide profile read back."""
    from wattlane.session import scratch_table_path
    from wattlane.sources.sinks import write_tables
    paths = write_tables({"wide": profile_wide_meter(spark, sf_dir)}, scratch_table_path(spark, "tables"))
    return spark.read.parquet(paths["wide"])


@query("stored_months")
def q_stored_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consumption table stored by month, read back through its contract for one span of days."""
    from pyspark.sql import functions as F

    from wattlane.session import scratch_table_path
    from wattlane.sources.storage import write_series
    from wattlane.sources.tables import read_consumption
    rows = S.nation_daily_orders(spark, sf_dir).withColumnRenamed("consumption_filtered", "consumption")
    path = scratch_table_path(spark, "series")
    write_series(rows.withColumn("contracts", F.lit(1)), path, time="time", keys=("postalcode", "time"), buckets=2)
    return read_consumption(spark, path, start="1995-03-10", end="1996-02-05")


@query("stored_forecast_dataset")
def q_stored_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10 from stored series: both sides of the weather join come in buckets of its keys."""
    from wattlane.operators.enrich import forecast_dataset
    from wattlane.session import scratch_table_path
    from wattlane.sources.storage import write_series
    series = write_series(cleaned_meter(spark, sf_dir), scratch_table_path(spark, "cleaned"), buckets=8)
    weather = write_series(S.hourly_weather(spark, sf_dir), scratch_table_path(spark, "weather"), time="time",
                           keys=("postalcode", "time"), buckets=8)
    return forecast_dataset(series, weather, S.socio_events(spark, sf_dir), S.area_events(spark, sf_dir))
