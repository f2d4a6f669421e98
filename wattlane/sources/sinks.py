"""Sinks (S6, S7): the tables behind the reference's figures, written by Spark.

Figures are not drawn; every figure's data is a DataFrame written as parquet
(or CSV for the long daily profile, with the column order of the reference's
sample export).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Column order of the long-profile CSV export.
PROFILE_CSV_COLUMNS = ("postalcode", "hour", "date", "daily_consumption", "consumption_filtered",
                       "consumption")
PROFILE_CSV_SCHEMA = ("postalcode string, hour int, date date, daily_consumption double, "
                      "consumption_filtered double, consumption double")


def write_profile_csv(long_profile: DataFrame, path: str) -> None:
    """Header CSV, missing values as empty fields."""
    (long_profile.select(*PROFILE_CSV_COLUMNS).write.mode("overwrite")
     .option("header", True).option("nullValue", "").option("emptyValue", "").csv(path))


def read_profile_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(PROFILE_CSV_SCHEMA).csv(path)


def write_tables(tables: dict[str, DataFrame], base_path: str, mode: str = "overwrite") -> dict[str, str]:
    """One parquet table per figure; returns name -> path."""
    out = {}
    for name, df in tables.items():
        p = f"{base_path.rstrip('/')}/{name}"
        df.write.mode(mode).parquet(p)
        out[name] = p
    return out
