"""Task 1: typical daily load curves.

cleaned hourly series -> long profile -> wide profile -> scaling (fitted on
all days) -> complete days -> Ward -> labels, merge tree, curve tables and,
optionally, the silhouette sweep over k = 2..9.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlane.operators import curves
from wattlane.operators.profiles import bucket_columns, complete_days, profile_long, profile_wide
from wattlane.operators.scaling import scale_data
from wattlane.operators.silhouette import EUCLIDEAN, euclidean_silhouette, silhouette_score
from wattlane.operators.ward import WardResult, ward
from wattlane.session import cut_lineage

# The sweep range of the reference.
SWEEP_KS = tuple(range(2, 10))


@dataclass
class LoadCurves:
    labels: DataFrame                       # postalcode, date, cluster
    ward: WardResult
    matrix: DataFrame                       # scaled complete days
    tables: dict[str, DataFrame] = field(default_factory=dict)


def profile_matrix(cleaned: DataFrame, scaling_method: str = "no_scaling", n_hours: int = 3) -> DataFrame:
    """Scaled complete days.  The wide profile (one row per day, far smaller
    than the hourly input) is checkpointed once: the scaler fit, Ward and the
    silhouette sweep all read it."""
    cols = bucket_columns(n_hours)
    wide = cut_lineage(profile_wide(profile_long(cleaned, n_hours=n_hours), n_hours=n_hours))
    return complete_days(scale_data(wide, cols, scaling_method), cols)


def identify_load_curves(cleaned: DataFrame, scaling_method: str = "no_scaling", n_clusters: int = 3,
                         do_silhouette: bool = True, n_hours: int = 3) -> LoadCurves:
    cols = bucket_columns(n_hours)
    matrix = profile_matrix(cleaned, scaling_method, n_hours)
    ks = sorted({n_clusters, *(SWEEP_KS if do_silhouette else ())})
    res = ward(matrix, cols, ks, keys=["postalcode", "date"])
    labels = res.labels[n_clusters].withColumn("date", F.col("date").cast("date"))
    hours = curves.labelled_hours(cleaned, labels)
    tables = {
        "daily_curves": curves.daily_curve_list(hours),
        "centroids_long": curves.centroids_long(hours),
        "centroids_wide": curves.centroids_wide(hours),
        "cluster_ids": curves.cluster_ids(hours),
        "merges": res.merges,
        "top_merges": res.top_merges(n_clusters),
    }
    if do_silhouette:
        tables["silhouette"] = silhouette_sweep(matrix, res, cols, SWEEP_KS)
    return LoadCurves(labels=labels, ward=res, matrix=matrix, tables=tables)


def silhouette_sweep(matrix: DataFrame, res: WardResult, cols, ks=SWEEP_KS) -> DataFrame:
    """M9: Euclidean and squared Euclidean silhouette of the tree cut at each k (one tree, one pass for all cuts)."""
    keys = ["postalcode", "date"]
    cuts = cut_lineage(reduce(DataFrame.unionByName, [res.labels[k].withColumn("k", F.lit(k)) for k in ks]))
    rows = matrix.join(cuts, keys)
    squared = silhouette_score(rows, cols, "cluster", by=["k"])
    wide = cuts.groupBy(*keys).agg(*[F.max(F.when(F.col("k") == k, F.col("cluster"))).alias(f"k{k}") for k in ks])
    plain = euclidean_silhouette(matrix.join(wide, keys), cols, [f"k{k}" for k in ks])
    plain = plain.select(F.substring("labelling", 2, 10).cast("int").alias("k"), EUCLIDEAN)
    return squared.join(plain, "k", "left")


def write_outputs(result: LoadCurves, base_path: str) -> dict[str, str]:
    """Labels and the tables behind the dendrogram, curve and silhouette figures."""
    from wattlane.sources.sinks import write_tables
    return write_tables({"labels": result.labels, **result.tables}, base_path)
