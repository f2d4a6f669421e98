"""Feature tables of the two prediction tasks.

Dimension tables (socioeconomic per (area, year), cadaster per area) are
materialised once in the shared checkpoint folder and measured; a dimension
of at most ``broadcast_rows`` rows and ``broadcast_bytes`` bytes, however wide its
rows, is broadcast, a larger one is joined by sort-merge.  The planner alone would not broadcast them: it estimates an
aggregate as large as its input, and every sort-merge join re-shuffles the
fact table on the next key.  With the dimensions broadcast, the fact table
keeps the partitioning of its own aggregation, and only the fact-to-fact
weather join (per day or hour) shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattlane.functions.calendar import (month_number, month_text, utc_column,
                                         weekday_iso_text, weekday_monday0, year_of)
from wattlane.session import cut_lineage


# Rows and measured bytes a dimension may hold and still be broadcast to every task.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 << 20


def measured_bytes(df: DataFrame) -> Column:
    """Bytes of a row as text and numbers: measured where the width varies, the type's own width elsewhere."""
    fixed, varying = 16, []
    for f in df.schema.fields:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            fixed += 16
            varying.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            fixed += 64
            varying.append(F.coalesce(F.octet_length(F.to_json(F.struct(c.alias("c")))), F.lit(0)))
        else:
            fixed += 16 if isinstance(f.dataType, T.DecimalType) else 8
    return F.aggregate(F.array(*varying), F.lit(fixed).cast("long"), lambda a, b: a + b) if varying else F.lit(fixed).cast("long")


def dimension(df: DataFrame, broadcast_rows: int | None = BROADCAST_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Materialise a dimension once; broadcast it when its rows and its measured bytes are within the bounds."""
    if broadcast_rows is None:
        return df
    d = cut_lineage(df)
    rows, size = d.agg(F.count(F.lit(1)), F.coalesce(F.sum(measured_bytes(d)), F.lit(0))).first()
    return F.broadcast(d) if rows <= broadcast_rows and size <= broadcast_bytes else d


def dimensions(dfs: list[DataFrame], broadcast_rows: int | None = BROADCAST_ROWS) -> list[DataFrame]:
    """:func:`dimension` for several tables, materialised concurrently (independent jobs)."""
    if broadcast_rows is None or len(dfs) < 2:
        return [dimension(d, broadcast_rows) for d in dfs]
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=len(dfs)) as pool:
        return list(pool.map(lambda d: dimension(d, broadcast_rows), dfs))


def socio_with_year(socio: DataFrame) -> DataFrame:
    """``year`` as INT whatever its source type (date, text or integer)."""
    return socio.withColumn("year", year_of("year", socio.schema["year"].dataType))


def classification_dataset(consumption_daily: DataFrame, weather_daily: DataFrame,
                           socio: DataFrame, cadaster: DataFrame,
                           key: str = "postalcode",
                           broadcast_rows: int | None = BROADCAST_ROWS) -> DataFrame:
    """Daily rows with socioeconomic, cadaster and weather features."""
    socio_d, cad_d = dimensions([socio_with_year(socio), cadaster], broadcast_rows)
    df = consumption_daily.withColumn("year", F.year("date"))
    df = df.join(socio_d, [key, "year"], "left")
    df = df.join(cad_d, [key], "left")
    df = df.join(weather_daily, [key, "date"], "left")
    return df.withColumns({"month": month_number("date"), "weekday": weekday_monday0("date")})


def labelled_days(dataset: DataFrame, label: str = "cluster") -> DataFrame:
    """Keep rows with a label."""
    return dataset.dropna(subset=[label])


def forecast_dataset(cleaned: DataFrame, weather: DataFrame, socio: DataFrame,
                     cadaster: DataFrame, key: str = "postalcode",
                     weather_time: str = "time",
                     broadcast_rows: int | None = BROADCAST_ROWS) -> DataFrame:
    """Hourly rows joined to all dimensions (inner joins).

    The weather join uses the UTC instant; the local wall clock repeats an hour
    on the autumn DST day.
    """
    base = (cleaned.select(key, "ts_utc", "localtime", "hour", "contracts",
                           "consumption_filtered", "consumption")
                   .withColumn("year", F.year("localtime")))
    w = weather.withColumn("_wts", utc_column(weather, weather_time))
    socio_d, cad_d = dimensions([socio_with_year(socio), cadaster], broadcast_rows)
    df = (base.join(socio_d, [key, "year"])
              .join(cad_d, [key])
              .join(w, (base[key] == w[key]) & (base["ts_utc"] == w["_wts"]))
              .drop(w[key]).drop("_wts"))
    return df.withColumns({"month": month_text("localtime"), "weekday": weekday_iso_text("localtime")})


def forecast_features(dataset: DataFrame, target: str = "consumption_filtered") -> DataFrame:
    """Drop time and target columns' siblings, keep rows with a target."""
    return (dataset.where(F.col(target).isNotNull())
                   .drop("localtime", "time", "consumption"))
