"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlane.session import ship_package, written_table

#: A node with more than this share of all edges is heavy; there are at most twice as many as its inverse.
HEAVY_SHARE = 1 / 1000
#: At most so many edges are finished in one task.
TASK_EDGES = 500_000


def connected(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least node of the component of each of ``n`` nodes, for edges (i, j)."""
    least = np.arange(n)
    while True:
        before = least.copy()
        m = np.minimum(least[i], least[j])
        for side in (i, j):
            np.minimum.at(least, side, m)
            np.minimum.at(least, before[side], m)
        least = least[least]
        if (least == before).all():
            return least


def _in_task(table: pa.Table) -> pa.Table:
    ends = pa.concat_arrays([*table.column("a").chunks, *table.column("b").chunks])
    nodes = pc.unique(ends)
    nodes = nodes.take(pc.sort_indices(nodes))
    at = pc.index_in(ends, value_set=nodes).to_numpy().reshape(2, -1)
    return pa.table({"node": nodes, "component": nodes.take(pa.array(connected(len(nodes), *at)))})


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Edges (a, b) with ``m``, the least of a and its neighbours b.

    The minima are one row per node, added up before the shuffle.  Edges of
    heavy nodes get theirs from a broadcast of at most ``2 / HEAVY_SHARE`` rows,
    so they stay where they are; only edges of other nodes meet by node.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree")).select(
        F.col("a").alias("n"), F.least("a", "m").alias("m"), "degree")
    heavy = least.where(F.col("degree") > total * HEAVY_SHARE).select("n", "m")
    light = edges.join(F.broadcast(heavy.select("n")), edges.a == F.col("n"), "left_anti")
    at_heavy = edges.join(F.broadcast(heavy), edges.a == heavy.n).select("a", "b", "m")
    return light.join(least.select("n", "m"), light.a == F.col("n")).select("a", "b", "m").union(at_heavy)


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component), component = least node.

    Alternating large-star / small-star rounds: every neighbourhood is linked to
    its least node.  A round is two grouped minima, pre-aggregated, and a
    distinct; the edges of a node with very many neighbours are never rows of
    one task.  The number of rounds grows with the logarithm of the longest path.
    Every round is a table in the shared folder.  At most ``task_edges`` edges need
    no rounds: one task of bounded size joins them, which spares the driver the plans
    and broadcasts of tens of small jobs.
    """
    cur = written_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .distinct(), f"{name}-edges")
    for i in range(max_rounds):
        total = cur.count()
        if not total:
            break
        if total <= task_edges:
            ship_package(edges.sparkSession)
            kind = cur.schema["a"].dataType.simpleString()
            return written_table(cur.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_in_task, f"node {kind}, component {kind}"), name)
        # large star: every larger neighbour of a node is linked to the least of its neighbourhood
        sym = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _with_least(sym, total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours are linked to the least of them
        small = _with_least(low, total).select(
            F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        nxt = written_table(small.select("e.a", "e.b").where("a <> b").distinct(), f"{name}-{i}")
        # stars only: no node is both a centre and a leaf, no leaf has two centres
        centres = nxt.select(F.col("b").alias("n")).distinct()
        unfinished = (nxt.join(centres, nxt.a == centres.n, "left_semi").limit(1).count()
                      or nxt.groupBy("a").count().where("count > 1").limit(1).count())
        cur = nxt
        if not unfinished:
            break
    else:
        raise RuntimeError("components: not finished within max_rounds")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
