"""Stored series: month folders for date filters, buckets for joins without an exchange.

``write_series`` lays an hourly (or daily) table out once:

* one folder per UTC month, so a reader with ``start``/``end`` opens only the
  files of those months;
* inside them ``buckets`` files by the join keys.  Two tables stored with the
  same number of buckets on the same keys are joined bucket by bucket, without
  shuffling either.  The keys hold the time beside the postal code: a code with a third
  of all rows would otherwise be one bucket.

Rows are dealt to the buckets before they are written, so a table has at most
months x buckets files.  Buckets are known to Spark through a table of the session's
catalogue; ``open_series`` gives a stored folder a table again in another session.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder column; readers drop it.
MONTH = "_month"


def month_of(ts: Column) -> Column:
    """UTC month of a naive instant as a number, 202403 for March 2024; null where the instant is."""
    return (F.year(ts) * 100 + F.month(ts)).cast("int")


def write_series(df: DataFrame, path: str, time: str = "ts_utc", keys: Sequence[str] = ("postalcode", "ts_utc"),
                 buckets: int = 32, table: str | None = None) -> DataFrame:
    """Store ``df`` by month of ``time`` and in ``buckets`` buckets of ``keys``; returns it as stored.

    ``path`` must not exist.  Rows without an instant are kept, in a folder of
    their own, which a date filter never opens.
    """
    from wattlane.functions.calendar import utc_column
    stored = df.withColumn(MONTH, month_of(utc_column(df, time))).repartition(buckets, *keys)
    table = table or f"series_{uuid.uuid4().hex}"
    (stored.write.partitionBy(MONTH).bucketBy(buckets, *keys).sortBy(*keys).mode("errorifexists")
     .option("path", path).format("parquet").saveAsTable(table))
    return df.sparkSession.table(table).drop(MONTH)


def open_series(spark: SparkSession, path: str, keys: Sequence[str] = ("postalcode", "ts_utc"), buckets: int = 32,
                table: str | None = None) -> DataFrame:
    """A folder of :func:`write_series` as a bucketed table of this session; ``keys`` and ``buckets`` as it was written."""
    table = table or f"series_{uuid.uuid4().hex}"
    fields = [f for f in spark.read.parquet(path).schema.fields if f.name != MONTH]
    quoted = ", ".join(_quoted(k) for k in keys)
    spark.sql(f"CREATE TABLE {table} ({', '.join(f'{_quoted(f.name)} {f.dataType.simpleString()}' for f in fields)}, {MONTH} INT) "
              f"USING parquet PARTITIONED BY ({MONTH}) CLUSTERED BY ({quoted}) SORTED BY ({quoted}) INTO {int(buckets)} BUCKETS "
              f"LOCATION {json.dumps(path)}")
    spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    return spark.table(table).drop(MONTH)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
