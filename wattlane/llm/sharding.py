"""Operator 2: sharding by jump consistent hashing, in DataFrame expressions only.

A stable key (the id) is mapped to one of ``n`` shards without a ring table.
Going from ``n`` to ``n + 1`` shards moves a row only into the new shard, and
only about one row in ``n + 1``.

The key is the first 64 bits of the md5 of the id as text; the jump sequence
is the published one (Lamping and Veach): a 64-bit linear congruential step
per jump.  Spark's long product raises on overflow, so the step is taken in
DECIMAL(38), where a 64-bit state times the 62-bit factor fits exactly.

Slots number the rows of a shard without gaps, in the order of
(id, text checksum, size): rows are range-partitioned by (shard, order, salt),
counted per (shard, partition), and numbered inside (shard, partition).  The
salt splits any run of equal rows, so no shard and no hot id meets in one
task.

Nulls: a null id is the key of the empty text; a null text has no bytes and
checksum 0.  Repeated rows get a slot each.  An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattlane.llm.common import materialise, text_or_empty

#: Fixed values of the published generator: factor and modulus.
FACTOR, MODULUS = 2862933555777941757, 2 ** 64


def stable_key(col: Column) -> Column:
    """The first 64 bits of md5(id as text), as an unsigned DECIMAL(20)."""
    digest = F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def jump_shard(key: str, shards: int) -> Column:
    """Shard 0 .. shards-1 of the DECIMAL(20) column named ``key``.

    Every jump goes at least one shard on, so ``shards`` jumps always end it; as
    about ln(shards) are expected, a few are run first and the rest only for
    the rows that need them.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    jump = f"""if(s.j >= {shards}, s,
        transform(array(cast(pmod(s.k * {FACTOR}BD + 1BD, {MODULUS}BD) as decimal(20,0))), k ->
          named_struct('k', k, 'b', s.j, 'j', cast(floor(cast(s.j + 1 as double)
            * (2147483648D / cast(cast(k div 8589934592BD as bigint) + 1L as double))) as bigint)))[0])"""
    few = min(shards, 8 + 4 * math.ceil(math.log(shards + 1)))
    return F.expr(f"""aggregate(sequence(1, {few}),
        named_struct('k', cast(`{key}` as decimal(20,0)), 'b', -1L, 'j', 0L),
        (s, i) -> {jump},
        r -> cast(if(r.j >= {shards}, r.b, aggregate(sequence(1, {shards}), r, (s, i) -> {jump}, t -> t.b)) as int))""")


def shard_rows(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
               grow: bool = True) -> DataFrame:
    """Rows (id, size, text_crc32, shard, slot[, grown_shard]) of every row of ``df``."""
    spark = df.sparkSession
    text = text_or_empty(text_col)
    base = df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                     F.crc32(text.cast("binary")).alias("crc"), stable_key(F.col(id_col)).alias("key"))
    base = base.select("id", "size", "crc", jump_shard("key", shards).alias("shard"),
                       (jump_shard("key", shards + 1) if grow else F.lit(None).cast("int")).alias("grown"),
                       F.monotonically_increasing_id().alias("salt"))
    base = materialise(base, "shard-rows")  # the texts are read once; the range sampling reads this
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["id", "crc", "size", "salt"]
    ranged = materialise(base.repartitionByRange(parts, "shard", *order)
                         .withColumn("part", F.spark_partition_id()), "shard-ranges")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy("shard", "part").agg(F.count("*").alias("n"))
               .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*order))
    return (ranged.withColumn("number", number).join(offsets, ["shard", "part"])
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
                    (F.col("offset") + F.col("number") - 1).cast("long").alias("slot"),
                    F.col("grown").alias("grown_shard")))
