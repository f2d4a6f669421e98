"""Table scans (S1-S3) with the missing-value rule applied at the source.

NaN is "missing" in the pandas world; in Spark a NaN survives ``avg`` and
passes ``NaN > x``.  Every floating column is therefore turned into NULL at
read time, so all later aggregates and windows see one kind of missing.  The
three input tables have contracts: a missing or unfitting column is named when
the table is opened, not found by a failing task later.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Replace NaN by NULL in the given (default: all float/double) columns."""
    if cols is None:
        cols = [f.name for f in df.schema.fields
                if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    cols = list(cols)
    if not cols:
        return df
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType))
                           for c in cols})


def text_nan_to_null(col: str | Column) -> Column:
    """The text sentinel ``'NaN'`` as missing (string columns)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(c, F.lit("NaN"))


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: Iterable[str] | None = None,
               schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet scan with optional column list and NaN -> NULL.

    Selecting the columns right after the scan lets Catalyst prune the
    ``ReadSchema``; filters written later are pushed into the scan.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(table_path(sf_dir, name))
    if columns is not None:
        df = df.select(*columns)
    return nan_to_null(df)


# The columns the tasks use, by input table; a kind is a type or 'number'/'instant'.
CONSUMPTION_CONTRACT = {"postalcode": "string", "time": "instant", "consumption": "number", "contracts": "number"}
WEATHER_CONTRACT = {"postalcode": "string", "time": "instant", "airtemperature": "number", "relativehumidity": "number",
                    "ghi": "number", "sunelevation": "number", "totalprecipitation": "number"}
SOCIOECONOMIC_CONTRACT = {"postalcode": "string", "year": "year"}

_KINDS = {
    "string": (T.StringType,),
    "number": (T.NumericType,),
    "instant": (T.TimestampType, T.TimestampNTZType, T.StringType),
    "year": (T.DateType, T.IntegralType, T.StringType, T.TimestampType, T.TimestampNTZType),
}


def check_contract(df: DataFrame, contract: dict[str, str], table: str) -> DataFrame:
    """``df`` itself if it has every column of the contract in a fitting type; else an error that names them all.

    Only the schema is looked at.  Columns beyond the contract are kept.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f"{c} is missing" if c not in types else f"{c} is {types[c].simpleString()}, not {kind}"
             for c, kind in contract.items() if c not in types or not isinstance(types[c], _KINDS[kind])]
    if wrong:
        raise ValueError(f"{table}: {'; '.join(wrong)}")
    return df


def read_consumption(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Hourly consumption (postalcode, time, consumption, contracts), from ``start`` up to before ``end``."""
    return nan_to_null(_between(check_contract(spark.read.parquet(path), CONSUMPTION_CONTRACT, "consumption"), start, end))


def read_weather(spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
                 contract: dict[str, str] | None = None) -> DataFrame:
    """Hourly weather per postal code, from ``start`` up to before ``end``."""
    return nan_to_null(_between(check_contract(spark.read.parquet(path), contract or WEATHER_CONTRACT, "weather"), start, end))


def read_socioeconomic(spark: SparkSession, path: str) -> DataFrame:
    """S3: yearly socioeconomic features per postal code."""
    return nan_to_null(check_contract(spark.read.parquet(path), SOCIOECONOMIC_CONTRACT, "socioeconomic"))


def _between(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Rows with ``start <= time < end`` (UTC text, as '2024-03-01' or '2024-03-01 06:00:00').

    Where the table is stored by month (``storage.write_series``), the month
    folders are filtered too, so files outside the span are never opened.
    """
    from wattlane.functions.calendar import to_utc_ntz, utc_column
    from wattlane.sources.storage import MONTH, month_of
    time = utc_column(df, "time")
    if start is not None:
        first = to_utc_ntz(F.lit(start))
        df = df.where(time >= first)
        df = df.where(F.col(MONTH) >= month_of(first)) if MONTH in df.columns else df
    if end is not None:
        last = to_utc_ntz(F.lit(end))
        df = df.where(time < last)
        df = df.where(F.col(MONTH) <= month_of(last)) if MONTH in df.columns else df
    return df.drop(MONTH)
