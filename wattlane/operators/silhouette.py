"""Silhouette score (M9): Euclidean from blocked distance sums, squared Euclidean from sufficient statistics.

*Euclidean* (``euclidean_silhouette``).  The sum of the distances of a row to a
cluster is additive over blocks of rows.  Rows are packed into blocks and stripes of
``stripe`` blocks, which meet as the tiles of :mod:`wattlane.operators.tiles`: the
distances of a block and a stripe are one matrix product, added up in the task over
its stripes to (row, cluster, sum, count).  Neither pairs nor copies of the rows are
shuffled, so what is written grows with the rows (times the clusters and the parts
the stripes are read in, about as many as there are cores).  Several labellings of
the same rows (all cuts of a tree) share the distances.  The work is that of all
pairs, as the score's definition asks for; no task holds more than its blocks.

*Squared Euclidean* (``silhouette_samples``).  The mean squared distance of a point x to a cluster C needs only |C|, the
vector sum S_C and the sum of squared norms Q_C:

    sum_{y in C} ||x - y||^2 = |C| ||x||^2 - 2 x.S_C + Q_C

so the score is exact in O(n k), at every size.  a(x) averages over the other
members of x's cluster, b(x) is the smallest mean over another cluster, a
singleton scores 0 - ``silhouette_score(metric='sqeuclidean')``.  Output
columns carry the metric in their name.

The statistics are a table, packed into rows of at most ``pack_doubles`` numbers
each; such a row is small enough to be broadcast.  Few clusters make one
packed row, very many make several, which every point meets one after another.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlane.operators.tiles import Tile, over_tiles, packed
from wattlane.session import cut_lineage, written_table

SCORE = "silhouette_sqeuclidean"
EUCLIDEAN = "silhouette_euclidean"
#: Clusters whose sums a task keeps for a block before it writes them.
KEPT_SUMS = 4096
#: Clusters of a stripe that are summed by a matrix product.
FEW = 64


def _vec(cols: Sequence[str] | str) -> Column:
    if isinstance(cols, str):
        return F.transform(F.col(cols), lambda x: x.cast("double"))
    return F.array(*[F.col(f"`{c}`").cast("double") for c in cols])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, t: acc + t)


def _dimension(d: DataFrame) -> int:
    lo, hi, missing = d.agg(F.min(F.size("_x")), F.max(F.size("_x")), F.count_if(F.col("_x").isNull())).first()
    if lo != hi or missing:
        raise ValueError(f"vectors of one length are needed, found {lo} to {hi} and {missing} missing")
    return lo or 0


def silhouette_samples(df: DataFrame, features: Sequence[str] | str, label: str, by: Sequence[str] = (),
                       pack_doubles: int = 1_000_000) -> DataFrame:
    """Adds ``silhouette_sqeuclidean`` per row; rows of different ``by`` values are scored apart."""
    by = list(by)
    d = cut_lineage(df.withColumns({"_x": _vec(features), "_rid": F.monotonically_increasing_id()})
                    .withColumn("_nx", _dot(F.col("_x"), F.col("_x"))))
    dim = _dimension(d)
    stats = cut_lineage(d.groupBy(*by, F.col(label).alias("c")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("_nx").alias("q"),
        F.array(*[F.sum(F.col("_x")[i]) for i in range(dim)]).alias("s")))
    packs = max(1, -(-stats.count() * (dim + 2) // pack_doubles))
    pack = F.pmod(F.xxhash64("c"), F.lit(packs)).cast("int")
    packed = stats.groupBy(*by, pack.alias("_pack")).agg(F.collect_list(F.struct("c", "n", "q", "s")).alias("_cs"))
    if packs == 1:
        packed = F.broadcast(packed)
    met = d.withColumn("_pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1)))).join(packed, [*by, "_pack"])
    totals = F.transform("_cs", lambda c: F.struct(
        (c["c"] == F.col(label)).alias("own"), c["n"].alias("n"),
        (c["n"] * F.col("_nx") - F.lit(2.0) * _dot(F.col("_x"), c["s"]) + c["q"]).alias("t")))
    met = met.withColumn("_ts", totals).withColumns({
        "_own": F.get(F.filter("_ts", lambda t: t["own"]), 0),
        "_other": F.array_min(F.transform(F.filter("_ts", lambda t: ~t["own"]), lambda t: t["t"] / t["n"]))})
    if packs > 1:
        met = d.join(met.groupBy("_rid").agg(F.max("_own").alias("_own"), F.min("_other").alias("_other")), "_rid")
    n, a, b = F.col("_own.n"), F.try_divide(F.col("_own.t"), F.col("_own.n") - F.lit(1.0)), F.col("_other")
    score = F.when(b.isNull(), F.lit(None)).when(n <= 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    return met.withColumn(SCORE, score).drop("_x", "_nx", "_rid", "_pack", "_cs", "_ts", "_own", "_other")


def silhouette_score(df: DataFrame, features: Sequence[str] | str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """M9: per ``by`` one row (n, silhouette_sqeuclidean); rows without a label are left out."""
    s = silhouette_samples(df.where(F.col(label).isNotNull()), features, label, by)
    return s.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(SCORE).alias(SCORE))


# ---------------------------------------------------------------------- Euclidean

def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``x`` and ``y``; near ones are taken from the differences, without cancellation."""
    middle = y.mean(axis=0)
    x, y = x - middle, y - middle
    nx, ny = np.einsum("ij,ij->i", x, x)[:, None], np.einsum("ij,ij->i", y, y)[None, :]
    squares = nx + ny - 2 * (x @ y.T)
    i, j = np.nonzero(squares <= 1e-4 * (nx + ny))
    for a, b in zip(np.array_split(i, len(i) // 100_000 + 1), np.array_split(j, len(i) // 100_000 + 1)):
        squares[a, b] = ((x[a] - y[b]) ** 2).sum(axis=1)
    return np.sqrt(np.maximum(squares, 0))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)


def _labelling(labels: pa.ChunkedArray, at: int) -> tuple[np.ndarray, list[str]]:
    """Code of every row in labelling ``at``, -1 without a label, and the labels by code."""
    flat = labels.combine_chunks().flatten()
    one = flat.take(pa.array(np.arange(at, len(flat), len(flat) // len(labels)))).dictionary_encode()
    return one.indices.fill_null(-1).to_numpy(zero_copy_only=False), one.dictionary.to_pylist()


def _sums_to(d: np.ndarray, code: np.ndarray, k: int) -> np.ndarray:
    """Per row of ``d`` the sums over the columns of each of the ``k`` codes."""
    if k <= FEW:
        member = np.zeros((len(code), k))
        member[np.arange(len(code)), code] = 1.0
        return d @ member
    order = np.argsort(code, kind="stable")
    return np.add.reduceat(d[:, order], np.searchsorted(code[order], np.arange(k)), axis=1)


def _written(home: pa.Table, sums: dict[tuple[int, str], list]) -> pa.Table:
    rid, at, cluster, own, s, n = [], [], [], [], [], []
    mine = [_labelling(home.column("labels"), i) for i in range(1 + max(i for i, _ in sums))]
    for (i, label), (total, count) in sums.items():
        code, names = mine[i]
        here = np.flatnonzero(code >= 0)
        rid.append(home.column("rid").to_numpy()[here])
        at.append(np.full(len(here), i, np.int32))
        cluster += [label] * len(here)
        own.append(code[here] == (names.index(label) if label in names else -2))
        s.append(total[here])
        n.append(np.full(len(here), count))
    rid, at, own, s, n = (np.concatenate(v) for v in (rid, at, own, s, n))
    return pa.table({"rid": pa.array(rid, pa.int64()), "at": pa.array(at, pa.int32()), "cluster": pa.array(cluster, pa.string()),
                     "own": pa.array(own, pa.bool_()), "s": pa.array(s, pa.float64()), "n": pa.array(n, pa.int64())})


def _sums(tiles: Iterator[Tile]) -> Iterator[pa.Table]:
    """Per row at home and labelling: sum of distances to, and number of, the visitors of each cluster."""
    last, before, sums = None, None, {}
    for no, home, visiting in tiles:
        if sums and (no != last or len(sums) > KEPT_SUMS):
            yield _written(before, sums)
            sums = {}
        last, before = no, home
        d = distances(_matrix(home.column("x")), _matrix(visiting.column("x")))
        d[home.column("rid").to_numpy()[:, None] == visiting.column("rid").to_numpy()[None, :]] = 0.0
        for at in range(len(home.column("labels")[0])):
            code, names = _labelling(visiting.column("labels"), at)
            there = code >= 0
            if not there.any():
                continue
            found, counts = _sums_to(d if there.all() else d[:, there], code[there], len(names)), np.bincount(code[there])
            for i, label in enumerate(names):
                total = sums.setdefault((at, label), [np.zeros(len(d)), 0])
                total[0] += found[:, i]
                total[1] += int(counts[i])
    if sums:
        yield _written(before, sums)


def _cluster_sums(d: DataFrame, block: int, stripe: int) -> DataFrame:
    """Partial sums (rid, at, cluster, own, s, n): one per row, cluster and part of the stripes."""
    return over_tiles(packed(d, "rid", block, "silhouette-blocks"), packed(d, "rid", block * stripe, "silhouette-stripes"), _sums,
                      "rid long, at int, cluster string, own boolean, s double, n long", "silhouette-sums")


def euclidean_silhouette(df: DataFrame, features: Sequence[str] | str, labels: Sequence[str], block: int = 512, stripe: int = 8) -> DataFrame:
    """M9: rows (labelling, n, silhouette_euclidean), one per column in ``labels``; rows without a label are left out of it.

    A labelling of one cluster has a null score; a row that is its cluster's only one scores 0.
    """
    named = F.array(*[F.col(f"`{c}`").cast("string") for c in labels])
    d = written_table(df.select(F.monotonically_increasing_id().alias("rid"), _vec(features).alias("_x"), named.alias("labels")), "silhouette-rows")
    _dimension(d)
    parts = _cluster_sums(d.withColumnRenamed("_x", "x"), block, stripe)
    whole = parts.groupBy("rid", "at", "cluster").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("own").alias("own"))
    per_row = whole.groupBy("rid", "at").agg(
        F.max(F.when(F.col("own"), F.col("n"))).alias("n"), F.max(F.when(F.col("own"), F.try_divide(F.col("s"), F.col("n") - 1))).alias("a"),
        F.min(F.when(~F.col("own"), F.col("s") / F.col("n"))).alias("b"))
    score = F.when(F.col("b").isNull(), F.lit(None)).when(F.col("n") <= 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    names = F.array(*[F.lit(c) for c in labels])
    return per_row.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias(EUCLIDEAN)).select(
        names[F.col("at")].alias("labelling"), "n", EUCLIDEAN)
