"""All pairs of rows, block by block, without shuffling a row more than once.

Rows are packed: a pack is one row of a table in the shared folder and holds some
hundred or thousand rows.  Two tables of packs meet in Spark's cartesian product,
whose tasks read a part of each table from its files; a tile is a pack at home and
a visiting one.  What a task holds are the packs of one part, and what it writes is
up to its function, which sees all tiles of a home pack one after another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlane.session import ship_package, small_batches, written_table

Tile = tuple[int, pa.Table, pa.Table]


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    table = table.drop_columns(["_pack"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table.combine_chunks())
    return pa.table({"no": pa.array([key[0].as_py()], pa.int64()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def packed(df: DataFrame, by: str, size: int, name: str) -> DataFrame:
    """Packs (no, rows) of about ``size`` rows of ``df``, dealt by the hash of ``by``."""
    ship_package(df.sparkSession)
    packs = max(1, -(-df.count() // size))
    return written_table(df.withColumn("_pack", F.pmod(F.xxhash64(by), F.lit(packs))).groupBy("_pack")
                         .applyInArrow(_pack, "no long, rows binary"), name)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[Tile]:
    last, home = None, None
    for batch in batches:
        for no, mine, other in zip(batch.column("no"), batch.column("home"), batch.column("visiting")):
            if no != last:
                last, home = no, pa.ipc.open_stream(mine.as_buffer()).read_all()
            yield no.as_py(), home, pa.ipc.open_stream(other.as_buffer()).read_all()


def product(home: DataFrame, visiting: DataFrame, once: bool = False) -> DataFrame:
    """Pairs (no, home, visiting) of packs; with ``once`` a pack visits only those of no greater number, itself too."""
    mine = home.select("no", F.col("rows").alias("home")).hint("shuffle_replicate_nl")
    met = mine.crossJoin(visiting.select(F.col("no").alias("_visitor"), F.col("rows").alias("visiting")))
    return (met.where("no <= _visitor") if once else met).select("no", "home", "visiting")


def over_tiles(home: DataFrame, visiting: DataFrame, work: Callable[[Iterator[Tile]], Iterator[pa.Table]], schema: str, name: str,
               once: bool = False, batch: int = 4) -> DataFrame:
    """What ``work`` makes of the tiles (number of the home pack, home, visiting), as a table; tiles of a home pack follow each other in a task.

    With ``once`` two packs of the same table meet in one tile, not in two.  ``batch`` tiles are handed to Python at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in work(_tiles(batches)):
            yield from table.to_batches()

    with small_batches(home.sparkSession, batch):   # a row is a tile
        return written_table(product(home, visiting, once).mapInArrow(run, schema), name)
