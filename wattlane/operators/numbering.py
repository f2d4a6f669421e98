"""Global row numbers without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattlane.session import written_table


def _table(df: DataFrame) -> DataFrame:
    return written_table(df, "numbers")


def global_index(df: DataFrame, order: Sequence[str], out: str = "row_no") -> DataFrame:
    """``df`` with the 0-based position of every row in ``order``, written to the shared checkpoint folder.

    Rows are range-partitioned by (order, stored salt), counted per partition,
    and numbered inside their partition; the salt spreads equal rows.  Rows
    equal in ``order`` are numbered in any order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = _table(df.withColumn("_salt", F.monotonically_increasing_id()))
    ranged = _table(salted.repartitionByRange(parts, *order, "_salt").withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)   # one row per partition
    offsets = (ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    inside = Window.partitionBy("_part").orderBy(*order, "_salt")
    return (ranged.withColumn("_no", F.row_number().over(inside)).join(F.broadcast(offsets), "_part")
            .withColumn(out, (F.col("_off") + F.col("_no") - 1).cast("long")).drop("_part", "_no", "_off", "_salt"))
