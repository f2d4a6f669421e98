"""Ward agglomerative clustering by certified components.

Exact Ward at every size.  Identical vectors are one weighted leaf.  The cost of
two clusters is ``sqrt(2 |A| |B| / (|A| + |B|)) * ||c_A - c_B||``.

*Certified components.*  Ward's cost is reducible: merging two clusters brings
the result no nearer to a third one than the nearer of the two was.  So every
merge of cost <= r happens inside one connected component of the graph of
cluster pairs with cost <= r, and components can be merged independently, each
by a nearest-neighbour chain up to r in a task of its own.  When at most
``task_clusters`` clusters are left, they are one component and the tree is
finished in one task of bounded size.

*Rounds.*  With more clusters left a round takes a radius r and finds the graph,
near ones by cells or all pairs tile by tile.

Cells: the cost is never below the distance of the centres, so pairs with cost <= r lie
in neighbouring cells of width r over a few columns of high variance.  A cell is
cut into blocks; a pair of blocks is a group of bounded size that emits a minimum
spanning forest of its pairs, never the pairs.  r is the largest whose cells hold
``pairs_per_cluster`` pairs per cluster, at least twice the last one where that one
is finished.

Tiles: where the nearest neighbour of most clusters is farther than that r, as with
vectors of many dimensions, cells select nothing, and all pairs are looked at once, as tiles
(:mod:`wattlane.operators.tiles`), by one matrix product in single precision that finds all that may
cost at most r and a few more, whose costs are then taken exactly.  r is a quantile of the costs of a sample (of at
most ``BLOCK`` clusters, which meet all others), aimed at ``DEGREE`` neighbours per cluster or twice ``JOINED_EDGES``
pairs; of more pairs those of least cost count.  These pairs, without the vectors, are handled in one task: mutual nearest neighbours
merge in turns, and the costs of what they make follow from the pairs' (Lance-Williams).  The costs of a
cluster beyond r are known from below only; a cluster whose nearest neighbour is known so waits for
the next round.  So a round does nearly all merges of cost <= r; heights and centres are then
taken from the vectors, component by component.

With more than ``JOINED_EDGES`` clusters r is a quantile of the costs of nearest neighbours, too, and the tiles emit
their pairs with cost <= r, a spanning forest of them where they are many.  The quantile is
halved after a round with too large a component, else it grows.

The forests together hold the components at r and at every smaller radius.  A component
of more than ``task_clusters`` clusters is taken apart at the median cost of its nearest
neighbours, up to ``TRIES`` times; what is too large even then merges its mutual nearest
neighbours, which the forests hold, too.  At most ``TASK_EDGES`` edges are handled in one
task, more by components over Spark.  The choices change the work, never the tree.

*Tree.*  A cluster is known by (least leaf, number of leaves).  Merges are
numbered by height over a range partitioning; nodes ``0..m-1`` are leaves (in
order of their vectors), node ``m + i`` is merge ``i``.

*Labels.*  The tree is cut at the largest k asked for by pointer jumping over
the merges below the cut; smaller k join those clusters by the merges above it
(fewer rows than k).  Clusters are numbered by size, then by their least leaf.
Rows get labels by equi-joins on the vector and the leaf.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlane.operators.components import TASK_EDGES, components, connected
from wattlane.operators.numbering import global_index
from wattlane.operators.tiles import Tile, over_tiles, packed
from wattlane.session import ship_package, written_table


def _table(df: DataFrame) -> DataFrame:
    return written_table(df, "ward")

#: Columns that make up a cell.
CELL_COLUMNS = 3
#: Radii tried per round: the widest range halved so many times.
RADII = 24
#: Clusters of a block.
BLOCK = 512
#: Blocks of a group of clusters.
STRIPE = 8
#: Packs that all clusters make, and numbers of a pack at most.
PACKS, PACK_DOUBLES = 24, 2 ** 20
#: Radii at which a component is taken apart.
TRIES = 4
#: The quantile of nearest costs a first round over tiles takes, and the least and largest one, where components are run.
SHARE, LEAST_SHARE, MOST_SHARE = 0.6, 0.05, 0.9
#: Neighbours per cluster and pairs in all that a round over tiles aims at, and turns of merges in a task; neighbours where components are run.
DEGREE, JOINED_EDGES, TURNS, FEW = 128, 1_500_000, 200, 16
#: Rounding of single and double precision.
SINGLE, DOUBLE = 2.0 ** -23, 2.0 ** -52
#: A merge is certified up to this share of the radius; the rest is room for rounding.
CERTAIN = 1 - 1e-9

_STATE = "rep long, n long, w double, h double, x array<double>"
_TASK_ROWS = _STATE + ", lrep long, ln long, rrep long, rn long"


@dataclass
class WardResult:
    labels: dict[int, DataFrame]      # k -> rows with `cluster`
    merges: DataFrame                 # merge_id, left_node, right_node, height, size
    leaves: int

    def top_merges(self, p: int) -> DataFrame:
        """M8: the last ``p - 1`` merges (``truncate_mode='lastp'``)."""
        return self.merges.orderBy(F.col("height").desc(), F.col("merge_id").desc()).limit(max(p - 1, 0))


# ---------------------------------------------------------------------- inside a task

def _squares(x: np.ndarray, w: np.ndarray, i: int) -> np.ndarray:
    """Squared costs of cluster ``i`` and every other."""
    d = x - x[i]
    return 2 * w[i] * w / (w[i] + w) * np.einsum("ij,ij->i", d, d)


def chain_merges(x: np.ndarray, w: np.ndarray, radius: float) -> list[tuple[int, int, float, float]]:
    """All merges of cost <= radius, by a nearest-neighbour chain: (kept slot, merged slot, cost, weight).

    ``x`` and ``w`` are changed: a kept slot holds the merged cluster.  A search
    looks at approximate costs of all clusters first, then exactly at those that
    may be least; ties go to the chain's last but one, then to the lowest slot.
    """
    centred = x - x.mean(axis=0)
    norms = np.einsum("ij,ij->i", centred, centred)
    open_ = np.ones(len(x), bool)       # neither merged into another slot nor without a neighbour in reach
    live = np.arange(len(x))
    merges, chain, start = [], [], 0
    while True:
        if not chain:
            while start < len(x) and not open_[start]:
                start += 1
            if start == len(x):
                return merges
            chain = [start]
        i = chain[-1]
        if open_.sum() < len(live) / 2:
            live = np.flatnonzero(open_)
        weight = 2 * w[i] * w[live] / (w[i] + w[live])
        about = weight * (norms[live] + norms[i] - 2 * (centred[live] @ centred[i]))
        about[~open_[live] | (live == i)] = np.inf
        least = about.min(initial=np.inf)
        j = -1
        if np.isfinite(least):
            slack = 1e-13 * (len(x[0]) + 8) * weight * (norms[live] + norms[i])
            near = live[about - slack <= least + slack.max()]
            d = x[near] - x[i]
            exact = 2 * w[i] * w[near] / (w[i] + w[near]) * np.einsum("ij,ij->i", d, d)
            at = exact == exact.min()
            j = chain[-2] if len(chain) > 1 and chain[-2] in near[at] else int(near[at].min())
            cost = float(np.sqrt(exact.min()))
        if j < 0 or cost > radius:
            open_[chain.pop()] = False  # its neighbours only move away
        elif len(chain) > 1 and j == chain[-2]:
            del chain[-2:]
            a, b = min(i, j), max(i, j)
            for v in (x, centred):
                v[a] = (w[a] * v[a] + w[b] * v[b]) / (w[a] + w[b])
            w[a] += w[b]
            norms[a] = centred[a] @ centred[a]
            open_[b] = False
            merges.append((a, b, cost, float(w[a])))
        else:
            chain.append(j)


def spanning_forest(x: np.ndarray, w: np.ndarray, home: np.ndarray, right: np.ndarray | None, radius: float) -> list[tuple[int, int, float]]:
    """Minimum spanning forest (i, j, cost) of the pairs with cost <= radius of which one is at ``home``.

    With ``right`` only pairs of a right and a left one count.
    """
    best, source, todo = np.full(len(w), np.inf), np.zeros(len(w), int), np.ones(len(w), bool)
    edges = []
    for _ in range(len(w)):
        cost = np.where(todo, best, np.inf)
        i = int(cost.argmin())
        if np.isfinite(cost[i]):
            edges.append((int(source[i]), i, float(cost[i])))
        else:
            i = int(todo.argmax())
        todo[i] = False
        cost = np.sqrt(_squares(x, w, i))
        nearer = todo & (home | home[i]) & (cost <= radius) & (cost < best)
        if right is not None:
            nearer &= right != right[i]
        best[nearer], source[nearer] = cost[nearer], i
    return edges


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1).copy()


def _run_component(table: pa.Table) -> pa.Table:
    """Merges and remaining clusters of one component; ``radius`` is the same in all its rows."""
    table = table.sort_by("rep")
    x, w = _vectors(table.column("x")), table.column("w").to_numpy().copy()
    rep, n, h = (table.column(c).to_numpy().copy() for c in ("rep", "n", "h"))
    rows, gone = [], np.zeros(len(rep), bool)
    for a, b, cost, weight in chain_merges(x, w, table.column("radius")[0].as_py()):
        parts = sorted([(int(rep[a]), int(n[a])), (int(rep[b]), int(n[b]))])
        rep[a], n[a], h[a], gone[b] = min(rep[a], rep[b]), n[a] + n[b], max(cost, h[a], h[b]), True
        rows.append((int(rep[a]), int(n[a]), weight, float(h[a]), None, *parts[0], *parts[1]))
    rows += [(int(rep[i]), int(n[i]), float(w[i]), float(h[i]), x[i].tolist(), None, None, None, None) for i in np.flatnonzero(~gone)]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), *[pa.int64()] * 4]
    names = [c.split()[0] for c in _TASK_ROWS.split(", ")]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


# ---------------------------------------------------------------------- one round

def _cell(dims: Sequence[int], radius: Column | float) -> list[Column]:
    return [F.floor(F.col("x")[i] / F.lit(radius)).cast("long") for i in dims]


def _radius(state: DataFrame, dims: Sequence[int], widest: float, clusters: int, budget: int) -> float | None:
    """The largest radius whose cells hold at most ``budget`` pairs per cluster; None: any."""
    if clusters <= budget or not widest > 0:
        return None
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.lit(widest / 2 ** i).alias("r")) for i in range(RADII)]))
    cells = state.select("x", levels.alias("l")).select("l.level", F.struct(*_cell(dims, F.col("l.r"))).alias("cell"))
    per_level = (cells.groupBy("level", "cell").agg(F.count(F.lit(1)).cast("double").alias("n"))
                 .groupBy("level").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
                 .where(F.col("pairs") * 3 ** len(dims) <= float(budget) * clusters).agg(F.min("level")).first()[0])
    return widest / 2 ** (RADII - 1 if per_level is None else per_level)


def _forests(state: DataFrame, dims: Sequence[int], radius: float, block: int) -> DataFrame:
    """Edges (a, b, cost) of spanning forests that together hold a minimum spanning forest of all pairs with cost <= radius."""
    own, none = _cell(dims, radius), (0,) * len(dims)   # the own cell and the half of its neighbours that comes after it
    cells = F.array(*[F.struct(F.array(*[c + o for c, o in zip(own, off)]).alias("cell"), F.lit(off == none).alias("home"))
                      for off in product((-1, 0, 1), repeat=len(dims)) if off >= none])
    entries = _table(state.select("rep", F.explode(cells).alias("e")).select("rep", "e.cell", "e.home"))
    sizes = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.max("home").alias("lived")).where("m > 1 and lived")
    sizes = sizes.select("cell", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    placed = (entries.join(sizes, "cell").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
              .select("cell", "rep", "home", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
              .select("cell", "rep", "home", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"),
                      (F.col("mine") > F.col("other")).alias("right")))

    def search(table: pa.Table) -> pa.Table:
        rep = table.column("rep").to_numpy()
        home, right = (table.column(c).to_numpy() for c in ("home", "right"))
        apart = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
        found = spanning_forest(_vectors(table.column("x")), table.column("w").to_numpy(), home, right if apart else None, radius)
        i, j, cost = (np.array(v) for v in zip(*found)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))
        return pa.table({"a": pa.array(rep[i], pa.int64()), "b": pa.array(rep[j], pa.int64()), "cost": pa.array(cost, pa.float64())})

    return (placed.join(state.select("rep", "w", "x"), "rep").groupBy("cell", "lo", "hi")
            .applyInArrow(search, "a long, b long, cost double"))


class _Near:
    """The pairs of a tile that may have a cost <= radius.

    A cost is <= r where ``|x|^2 - r^2 / 2w + |y|^2 - r^2 / 2v - 2 x.y <= 0``, which is one matrix product of vectors
    with two more columns.  It is taken in single precision where its error is far below the least bound, and
    a pair counts up to that error, so none is missed; exact costs are for the caller.
    """

    def __init__(self, home: pa.Table, visiting: pa.Table, radius: float):
        (x, w), (y, v) = (_weighted(t) for t in (home, visiting))
        middle, square = y.mean(axis=0), radius * radius
        x, y = x - middle, y - middle
        p, q = np.einsum("ij,ij->i", x, x) - square / (2 * w), np.einsum("ij,ij->i", y, y) - square / (2 * v)
        most = max(float(np.abs(p).max() + square / (2 * w.min())), float(np.abs(q).max() + square / (2 * v.min()))) or 1.0
        error = 4 * (x.shape[1] + 10) * most
        exact = error * SINGLE > 0.02 * square * (1 / (2 * w.max()) + 1 / (2 * v.max()))
        kind, self.slack = (np.float64, error / most * DOUBLE) if exact else (np.float32, error / most * SINGLE)
        scale = np.sqrt(most)
        self.home = np.column_stack([x / scale, p / most, np.ones(len(x))]).astype(kind)
        self.visiting = np.column_stack([y * (-2 / scale), np.ones(len(y)), q / most]).astype(kind)
        self.room, self.near = np.empty((BLOCK, 2 * BLOCK), kind), np.empty((BLOCK, 2 * BLOCK), bool)

    def pairs(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): i from ``lo`` to ``hi`` at home, less ``lo``, and j visiting."""
        mine, found = self.home[lo:hi], []
        for at in range(0, len(self.visiting), 2 * BLOCK):
            other = self.visiting[at:at + 2 * BLOCK]
            shape = len(mine), len(other)
            room, near = (r.ravel()[:len(mine) * len(other)].reshape(shape) for r in (self.room, self.near))
            i, j = np.divmod(np.flatnonzero(np.less_equal(np.matmul(mine, other.T, out=room), self.slack, out=near)), len(other))
            found.append((i, j + at))
        i, j = (np.concatenate(c) for c in zip(*found))
        return i, j


def _weighted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return _vectors(table.column("x")), table.column("w").to_numpy()


def _pair_costs(x: np.ndarray, w: np.ndarray, y: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Costs of the clusters ``i`` of (x, w) and ``j`` of (y, v)."""
    cost = np.empty(len(i))
    for at in np.array_split(np.arange(len(i)), len(i) // 20_000 + 1):
        d = x[i[at]] - y[j[at]]
        cost[at] = np.sqrt(2 * w[i[at]] * v[j[at]] / (w[i[at]] + v[j[at]]) * np.einsum("ij,ij->i", d, d))
    return cost


def _sample_of(most: int):
    def sample(tiles: Iterator[Tile]) -> Iterator[pa.Table]:
        """Of the first ``BLOCK`` clusters at home: each one's least cost per tile (``nearest``) and the ``most`` least costs of all."""
        for _, home, whole in tiles:
            home = home.slice(0, BLOCK)
            for visiting in (whole.slice(at, BLOCK * STRIPE) for at in range(0, len(whole), BLOCK * STRIPE)):
                (x, w), (y, v) = (_weighted(t) for t in (home, visiting))
                middle = y.mean(axis=0)
                a, b = x - middle, y - middle
                about = a @ (b.T * -2)
                about += np.einsum("ij,ij->i", a, a)[:, None]
                about += np.einsum("ij,ij->i", b, b)
                about *= 2 * w[:, None] * v / (w[:, None] + v)
                rep, other = home.column("rep").to_numpy(), visiting.column("rep").to_numpy()
                about[rep[:, None] == other[None, :]] = np.inf
                i, j = np.flatnonzero(np.isfinite(about.min(axis=1))), about.argmin(axis=1)
                yield pa.table({"rep": rep[i], "cost": _pair_costs(x, w, y, v, i, j[i]), "nearest": np.ones(len(i), bool)})
                least = np.argpartition(about, min(most, about.size) - 1, axis=None)[:most]
                i, j = np.divmod(least[np.isfinite(about.ravel()[least])], len(v))
                yield pa.table({"rep": rep[i], "cost": _pair_costs(x, w, y, v, i, j), "nearest": np.zeros(len(i), bool)})
    return sample


def _sampled(packs: DataFrame, degree: float) -> tuple[np.ndarray, float]:
    """Costs of the nearest neighbours of at most ``BLOCK`` clusters of a pack, and the cost up to which they have ``degree`` neighbours on average."""
    first = packs.agg(F.min("no")).first()[0]
    found = over_tiles(packs.where(F.col("no") == first).coalesce(1), packs, _sample_of(max(1, int(BLOCK * degree))),
                       "rep long, cost double, nearest boolean", "ward-sample", batch=1)
    nearest = np.array([r.cost for r in found.where("nearest").groupBy("rep").agg(F.min("cost").alias("cost")).collect()])
    least = found.where("not nearest").select("cost").orderBy("cost").limit(max(1, int(len(nearest) * degree)))
    return nearest, max(least.agg(F.max("cost")).first()[0], float(nearest.min()))


def _close_of(radius: float, complete: bool = False):
    def close(tiles: Iterator[Tile]) -> Iterator[pa.Table]:
        """Edges (a, b, cost) of the pairs with cost <= radius, or of a spanning forest of them; in the tile of a pack and itself a pair once.

        ``complete``: all of them, with the weights (wa, wb).
        """
        for _, whole, visiting in tiles:
            near, (x, w), (y, v) = _Near(whole, visiting, radius), _weighted(whole), _weighted(visiting)
            rep, other = whole.column("rep").to_numpy(), visiting.column("rep").to_numpy()
            itself = np.array_equal(rep, other)
            for at in range(0, len(whole), BLOCK):
                i, j = near.pairs(at, at + BLOCK)
                i += at
                if itself:
                    i, j = i[rep[i] < other[j]], j[rep[i] < other[j]]
                if not len(i):
                    continue
                if not complete and len(i) > 4 * (min(BLOCK, len(whole) - at) + len(other)):
                    a, b, cost = _tile_forest(whole.take(pa.array(np.unique(i))), visiting.take(pa.array(np.unique(j))), radius)
                else:
                    a, b, cost = rep[i], other[j], _pair_costs(x, w, y, v, i, j)
                at_most = cost <= radius
                edges = {"a": a[at_most], "b": b[at_most], "cost": cost[at_most]}
                yield pa.table(edges | ({"wa": w[i[at_most]], "wb": v[j[at_most]]} if complete else {}))
    return close


def _tile_forest(home: pa.Table, visiting: pa.Table, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning forest of the clusters of a tile, each once, also of the pairs on one side."""
    both = pa.concat_tables([home, visiting])
    ids, at = np.unique(both.column("rep").to_numpy(), return_index=True)
    found = spanning_forest(_vectors(both.column("x"))[at], both.column("w").to_numpy()[at], np.ones(len(ids), bool), None, radius)
    i, j, cost = (np.array(c) for c in zip(*found)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))
    return ids[i], ids[j], cost


def _mutual(edges: DataFrame) -> DataFrame:
    """(rep, comp, radius) of pairs that are each other's nearest neighbour."""
    pair = F.struct("cost", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    nearest = edges.select(F.explode(F.array("a", "b")).alias("rep"), pair.alias("pair")).groupBy("rep").agg(F.min("pair").alias("pair"))
    both = nearest.groupBy("pair").agg(F.count(F.lit(1)).alias("both")).where("both = 2")
    return both.select(F.explode(F.array("pair.lo", "pair.hi")).alias("rep"), F.col("pair.lo").alias("comp"),
                       F.lit(float("inf")).alias("radius"))


def _median_nearest(edges: DataFrame) -> float:
    """Median over the clusters of the cost of their nearest neighbour."""
    nearest = edges.select(F.explode(F.array("a", "b")).alias("rep"), "cost").groupBy("rep").agg(F.min("cost").alias("cost"))
    return nearest.agg(F.percentile_approx("cost", 0.5)).first()[0]


def _nearest_edges(ends: np.ndarray, lo: np.ndarray, hi: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Per node that ends an edge (``ends``: rows of low and high ends) its least edge by (cost, lo, hi)."""
    node, edge = ends.ravel(), np.tile(np.arange(len(lo)), 2)
    order = np.lexsort((hi[edge], lo[edge], cost[edge], node))
    return edge[order][np.r_[True, np.diff(node[order]) > 0]]


def assigned_in_task(a: np.ndarray, b: np.ndarray, cost: np.ndarray, radius: float, most: int) -> list[tuple[int, int, float]]:
    """(rep, comp, radius) as :func:`_assigned` gives them."""
    out: list[tuple[int, int, float]] = []
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    for tries in range(1, TRIES + 1):
        near = cost <= radius
        lo, hi, cost = lo[near], hi[near], cost[near]
        ids, ends = np.unique(np.r_[lo, hi], return_inverse=True)
        ends = ends.reshape(2, -1)
        comp = connected(len(ids), *ends)
        large = np.bincount(comp, minlength=len(ids))[comp] > most
        out += [(int(r), int(c), radius * CERTAIN) for r, c in zip(ids[~large], ids[comp[~large]])]
        inside = large[ends[0]]
        if not inside.any():
            break
        lo, hi, cost, ends = lo[inside], hi[inside], cost[inside], ends[:, inside]
        least = _nearest_edges(ends, lo, hi, cost)
        smaller = float(np.median(cost[least])) * (1 + 1e-6)
        if tries == TRIES or not smaller < radius:
            edge, times = np.unique(least, return_counts=True)
            for e in edge[times == 2].tolist():
                out += [(int(lo[e]), int(lo[e]), float("inf")), (int(hi[e]), int(lo[e]), float("inf"))]
            break
        radius = smaller
    return out


def _assigned(edges: DataFrame, radius: float, most: int) -> DataFrame:
    """Clusters with the component to run and its certified radius, a lower or no one where it was too large at ``radius``: (rep, comp, radius)."""
    if edges.count() <= TASK_EDGES:
        def run(table: pa.Table) -> pa.Table:
            found = assigned_in_task(*(table.column(c).to_numpy() for c in ("a", "b", "cost")), radius, most)
            return pa.table({c: pa.array(v, t) for c, v, t in zip(("rep", "comp", "radius"), zip(*found), (pa.int64(), pa.int64(), pa.float64()))})

        return _table(edges.where(F.col("cost") <= radius).withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "rep long, comp long, radius double"))
    parts: list[DataFrame] = []
    for tries in range(1, TRIES + 1):
        comp = _table(components(edges.where(F.col("cost") <= radius).select("a", "b"), "ward-components"))
        sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        parts.append(comp.join(sizes.where(F.col("size") <= most), "component").select(
            F.col("node").alias("rep"), F.col("component").alias("comp"), F.lit(radius * CERTAIN).alias("radius")))
        large = _table(comp.join(sizes.where(F.col("size") > most), "component").select("node"))
        if not large.limit(1).count():
            break
        inside = edges.where(F.col("cost") <= radius).join(large, F.col("a") == F.col("node"), "left_semi")
        edges = _table(inside)          # both ends of such an edge are in one component
        smaller = _median_nearest(edges) * (1 + 1e-6)
        if tries == TRIES or not smaller < radius:
            parts.append(_mutual(edges))
            break
        radius = smaller
    return _table(reduce(DataFrame.union, parts))


class _Joins:
    """Costs of clusters after the merges of a turn, by the Lance-Williams formula, from those of the pairs up to ``reach`` (all squared)."""

    def __init__(self, w: np.ndarray, lo: np.ndarray, hi: np.ndarray, between: np.ndarray, reach: float):
        n = len(w)
        self.w, self.reach, self.root, self.mate, self.between = w, reach, np.arange(n), np.full(n, -1), np.zeros(n)
        self.root[hi] = lo
        self.mate[lo], self.mate[hi], self.between[lo] = hi, lo, between
        self.after = w.copy()
        self.after[lo] += w[hi]

    def side(self, mine: np.ndarray, third: np.ndarray, weight: np.ndarray, value: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, ...]:
        """(cluster after the merge, third one, cost, exact) for the costs of its parts, ``mine``, and third ones of these weights.

        The cost of a part that is not among the pairs is beyond the reach, which gives a bound from below.
        """
        key, first, at = np.unique(self.root[mine] * len(self.w) + third, return_index=True, return_inverse=True)
        lo, other = np.divmod(key, len(self.w))
        costs, known = np.full((len(key), 2), self.reach), np.zeros((len(key), 2), bool)
        part = (mine != lo[at]).astype(int)
        costs[at, part], known[at, part] = value, exact
        a, b, c = self.w[lo], self.w[self.mate[lo]], weight[first]
        known = known.all(axis=1)
        cost = ((a + c) * costs[:, 0] + (b + c) * costs[:, 1] - c * self.between[lo]) / (a + b + c)
        return lo, other, np.where(known, cost, cost * CERTAIN), known

    def __call__(self, p: np.ndarray, q: np.ndarray, value: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, ...]:
        """The pairs (p, q, cost, exact) after the merges."""
        now = self.mate >= 0
        touched = now[p] | now[q]
        kept = [c[~touched] for c in (p, q, value, exact)]
        p, q, value, exact = (c[touched] for c in (p, q, value, exact))
        apart = self.root[p] != self.root[q]
        p, q, value, exact = (c[apart] for c in (p, q, value, exact))
        swap = ~now[p] | (now[q] & (self.root[q] < self.root[p]))
        mine, third = np.where(swap, q, p), np.where(swap, p, q)
        mine, third, value, exact = self.side(mine, third, self.w[third], value, exact)
        both = now[third]
        kept = [np.r_[k, c[~both]] for k, c in zip(kept, (mine, third, value, exact))]
        if both.any():
            mine, third, value, exact = (c[both] for c in (mine, third, value, exact))
            kept = [np.r_[k, c] for k, c in zip(kept, self.side(third, mine, self.after[mine], value, exact))]
        near = kept[2] <= self.reach                       # beyond it, it is nobody's nearest in reach
        return tuple(c[near] for c in kept)


def joined_in_task(a: np.ndarray, b: np.ndarray, cost: np.ndarray, wa: np.ndarray, wb: np.ndarray, radius: float, most: int) -> tuple[np.ndarray, ...]:
    """(rep, comp, turn, into) of the clusters to merge, given all pairs with cost <= radius.

    ``rep`` is merged into ``into``, a lesser one, in that turn (-1: the least one of its ``comp``, of ``most`` at most).
    In a turn mutual nearest neighbours merge.  The costs of what they make follow from theirs, or
    are known from below where a pair was beyond the radius: a cluster whose nearest neighbour
    is known so only waits.  By reducibility no other merge brings a cluster nearer than its nearest neighbour.
    """
    ids, ends = np.unique(np.r_[a, b], return_inverse=True)
    p, q = ends.reshape(2, -1)
    w = np.empty(len(ids))
    w[ends] = np.r_[wa, wb]
    value, exact, reach = cost * cost, np.ones(len(cost), bool), (radius * CERTAIN) ** 2
    size, turn, into = np.ones(len(ids), np.int64), np.full(len(ids), -1), np.arange(len(ids))
    for no in range(TURNS):
        best = np.full(len(ids), np.inf)
        np.minimum.at(best, p, value)
        np.minimum.at(best, q, value)
        found = np.flatnonzero(exact & (value == best[p]) & (value == best[q]) & (value <= reach) & (size[p] + size[q] <= most))
        lo, hi = np.minimum(p[found], q[found]), np.maximum(p[found], q[found])
        order = np.lexsort((hi, lo, value[found]))
        lo, hi, found = lo[order], hi[order], found[order]
        _, first, of = np.unique(np.c_[lo, hi].ravel(), return_index=True, return_inverse=True)
        once = (first[of.reshape(-1, 2)] // 2 == np.arange(len(found))[:, None]).all(axis=1)    # of equal costs the first one of a cluster
        if not once.any():
            break
        lo, hi, found = lo[once], hi[once], found[once]
        turn[hi], into[hi] = no, lo
        size[lo] += size[hi]
        joins = _Joins(w, lo, hi, value[found], reach)
        p, q, value, exact = joins(p, q, value, exact)
        w = joins.after
    comp = into.copy()
    for no in range(turn.max(initial=-1), -1, -1):
        at = np.flatnonzero(turn == no)
        comp[at] = comp[into[at]]
    found = np.flatnonzero((turn >= 0) | (size > 1))
    return ids[found], ids[comp[found]], turn[found], ids[into[found]]


def _least_edges(edges: DataFrame, radius: float) -> tuple[DataFrame | None, float]:
    """About ``JOINED_EDGES`` of least cost, where there are more, and their radius; None where so many have one cost that they are too many."""
    count = edges.count()
    if count <= 1.2 * JOINED_EDGES:
        return edges, radius
    radius = min(radius, edges.agg(F.percentile_approx("cost", JOINED_EDGES / count)).first()[0] * (1 + 1e-6))
    near = edges.where(F.col("cost") <= radius)
    return near if near.count() <= 2 * JOINED_EDGES else None, radius


def _joined(edges: DataFrame, radius: float, most: int) -> DataFrame:
    """Merges (rep, comp, turn, into) as :func:`joined_in_task` gives them."""
    def run(table: pa.Table) -> pa.Table:
        found = joined_in_task(*(table.column(c).to_numpy() for c in ("a", "b", "cost", "wa", "wb")), radius, most)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("rep", "comp", "turn", "into"), found)})

    return _table(edges.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "rep long, comp long, turn long, into long"))


def _merge_joined(table: pa.Table) -> pa.Table:
    """Merges, turn by turn, and remaining clusters of whole components."""
    table = table.sort_by("rep")
    x, w = _vectors(table.column("x")), table.column("w").to_numpy().copy()
    rep, n, h = (table.column(c).to_numpy().copy() for c in ("rep", "n", "h"))
    turn, into = (table.column(c).fill_null(-1).to_numpy() for c in ("turn", "into"))
    rows = []
    for no in np.unique(turn[turn >= 0]):
        hi = np.flatnonzero(turn == no)
        lo = np.searchsorted(rep, into[hi])
        cost, parts = _pair_costs(x, w, x, w, lo, hi), (rep[lo], n[lo], rep[hi], n[hi])
        x[lo] = (w[lo, None] * x[lo] + w[hi, None] * x[hi]) / (w[lo] + w[hi])[:, None]
        w[lo] += w[hi]
        n[lo] += n[hi]
        h[lo] = np.maximum(cost, np.maximum(h[lo], h[hi]))
        rows.append((rep[lo], n[lo], w[lo], h[lo], *parts))
    left = np.flatnonzero(turn < 0)
    made = tuple(np.concatenate(c) for c in zip(*rows)) if rows else (np.empty(0, np.int64),) * 8
    nothing = pa.nulls(len(left), pa.int64())
    offsets = pa.array(np.arange(len(left) + 1, dtype=np.int32) * x.shape[1])
    lists = pa.ListArray.from_arrays(offsets, pa.array(x[left].ravel()))
    names = [c.split()[0] for c in _TASK_ROWS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), lists.type, *[pa.int64()] * 4]
    merged = pa.table([*(pa.array(c, k) for c, k in zip(made[:4], kinds)), pa.nulls(len(made[0]), lists.type), *(pa.array(c, pa.int64()) for c in made[4:])],
                      schema=pa.schema(list(zip(names, kinds))))
    return pa.concat_tables([merged, pa.table([*(pa.array(c[left]) for c in (rep, n, w, h)), lists, *[nothing] * 4], schema=merged.schema)])


def _run_joined(state: DataFrame, joined: DataFrame, clusters: int) -> DataFrame:
    """Merges and remaining clusters, as a table."""
    groups = F.lit(max(1, clusters // (BLOCK * STRIPE)))
    whole = state.join(joined, "rep", "left").withColumn("group", F.pmod(F.xxhash64(F.coalesce("comp", "rep")), groups))
    return _table(whole.groupBy("group").applyInArrow(_merge_joined, _TASK_ROWS))


# ---------------------------------------------------------------------- the tree

def _agglomerate(leaves: DataFrame, m: int, budget: int, most: int, block: int) -> DataFrame | None:
    """All merges: (rep, n, w, h, lrep, ln, rrep, rn); None for fewer than two leaves."""
    if m < 2:
        return None
    ship_package(leaves.sparkSession)
    state = leaves.select(F.col("leaf").alias("rep"), F.lit(1).cast("long").alias("n"), F.col("w").cast("double").alias("w"), F.lit(0.0).alias("h"), "x")
    dims, widest, width, left, floor, share, done = [], 0.0, 1, m, 0.0, SHARE, []
    checked: int | None = None          # clusters when cells selected nothing
    if left > most:
        spread = state.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
            F.var_pop("v").alias("var"), (F.max("v") - F.min("v")).alias("range")).orderBy(F.desc("var"), "i").limit(CELL_COLUMNS).collect()
        dims, widest, width = [r.i for r in spread], max(r.range for r in spread), state.select(F.size("x")).first()[0]
    while left > 1:
        if left <= most:
            todo = state.withColumns({"comp": F.lit(0), "radius": F.lit(float("inf"))})
            waiting = None
        else:
            tiled = checked is not None and left > checked / 2
            radius = None if tiled else _radius(state, dims, widest, left, budget)
            if radius is not None:
                radius = max(radius, floor) if max(radius, floor) <= 2 * widest else None
            packs = packed(state.select("rep", "w", "x"), "rep", max(block, min(left // PACKS, PACK_DOUBLES // width)), "ward-packs")
            in_task = left <= JOINED_EDGES
            nearest, reach = _sampled(packs, min(left - 1, DEGREE, 4 * JOINED_EDGES / left if in_task else FEW))
            if not tiled:
                tiled = radius is None or float(np.median(nearest)) > radius
                checked = left if tiled else None
            if tiled and in_task:
                reach *= 1 + 1e-6
                edges = over_tiles(packs, packs, _close_of(reach, complete=True), "a long, b long, cost double, wa double, wb double", "ward-close", once=True, batch=1)
                few, least = _least_edges(edges, reach)
                if few is not None:
                    ran = _run_joined(state, _joined(few, least, most), left)
                    merged = ran.where("lrep is not null").drop("x")
                    done.append(merged)
                    left -= merged.count()
                    state = ran.where("lrep is null").select("rep", "n", "w", "h", "x")
                    continue
                reach = min(reach, float(np.quantile(nearest, share)) * (1 + 1e-6))     # too many of one cost
            elif tiled:
                reach = min(reach, float(np.quantile(nearest, share))) * (1 + 1e-6)
                edges = over_tiles(packs, packs, _close_of(reach), "a long, b long, cost double", "ward-close", once=True, batch=1)
            else:
                reach = radius
                edges = _table(_forests(state, dims, radius, block))
            tasks = _assigned(edges, reach, most)
            crowded = tasks.where(F.col("radius") != reach * CERTAIN).limit(1).count() > 0
            todo = state.join(tasks, "rep")
            waiting = state.join(tasks.select("rep"), "rep", "left_anti")
            floor = 0.0 if crowded or tiled else 2 * reach
            if tiled:
                share = max(share / 2, LEAST_SHARE) if crowded else min(share * 1.5, MOST_SHARE)
        ran = _table(todo.groupBy("comp").applyInArrow(_run_component, _TASK_ROWS))
        merged = ran.where("lrep is not null").drop("x")
        done.append(merged)
        left -= merged.count()
        after = ran.where("lrep is null").select("rep", "n", "w", "h", "x")
        state = after if waiting is None else _table(after.unionByName(waiting.select("rep", "n", "w", "h", "x")))
    return reduce(DataFrame.union, done)


def _merge_table(merges: DataFrame | None, spark, m: int) -> DataFrame:
    if merges is None:
        return spark.createDataFrame([], "merge_id long, left_node long, right_node long, height double, size long")
    numbered = _table(global_index(merges, ["h", "n", "rep"], out="merge_id"))
    out = numbered
    for side in ("l", "r"):
        ids = numbered.select(F.col("rep").alias(f"{side}id"), F.col("n").alias(f"{side}size"), (F.col("merge_id") + m).alias(f"{side}made"))
        out = out.join(ids, (F.col(f"{side}rep") == F.col(f"{side}id")) & (F.col(f"{side}n") == F.col(f"{side}size")), "left")
        out = out.withColumn(f"{side}node", F.when(F.col(f"{side}n") == 1, F.col(f"{side}rep")).otherwise(F.col(f"{side}made")))
    return _table(out.select("merge_id", F.least("lnode", "rnode").alias("left_node"), F.greatest("lnode", "rnode").alias("right_node"),
                             F.col("h").alias("height"), F.col("w").cast("long").alias("size")))


def _roots(merges: DataFrame, m: int, k: int) -> DataFrame:
    """(node, root) of every node below the cut into ``k`` clusters, by pointer jumping."""
    up = _table(merges.where(F.col("merge_id") < m - k).select(
        (F.col("merge_id") + m).alias("root"), F.explode(F.array("left_node", "right_node")).alias("node")))
    while True:
        nxt = up.select(F.col("node").alias("pnode"), F.col("root").alias("proot"))
        up = _table(up.join(nxt, F.col("root") == F.col("pnode"), "left").select(
            "node", F.coalesce("proot", "root").alias("root"), F.col("pnode").isNotNull().alias("moved")))
        if not up.where("moved").limit(1).count():
            return up.select("node", "root")
        up = up.select("node", "root")


def _cluster_numbers(tops: list, above: list, m: int, ks: Sequence[int]) -> list[tuple[int, int, int]]:
    """(k, root, cluster): clusters at the largest k, joined by the merges above the cut for the others.

    ``tops``: (root, rows, least leaf), at most max(ks) of them; ``above``: (merge_id, left, right) in order.
    """
    out, todo = [], sorted(set(ks), reverse=True)
    parts = {root: (size, first, [root]) for root, size, first in tops}
    pending = list(above)
    for k in todo:
        while len(parts) > max(k, 1) and pending:
            i, a, b = pending.pop(0)
            (sa, fa, ra), (sb, fb, rb) = parts.pop(a), parts.pop(b)
            parts[m + i] = (sa + sb, min(fa, fb), ra + rb)
        for no, (_, _, roots) in enumerate(sorted(parts.values(), key=lambda p: (-p[0], p[1]))):
            out += [(k, r, no) for r in roots]
    return out


def ward(df: DataFrame, features: Sequence[str], ks: Sequence[int], keys: Sequence[str],
         pairs_per_cluster: int = 2000, task_clusters: int = 4096, block: int = BLOCK) -> WardResult:
    """M5-M7: Ward clustering of the rows of ``df`` on ``features``.

    Returns labels per k for the rows (``keys`` + ``cluster``) and the merge
    table.  Rows with a missing feature get no label.  ``pairs_per_cluster``
    sets the radius of a round, ``task_clusters`` bounds the clusters of a task
    and ``block`` those of a block; the result depends on none of them.
    """
    spark, keys = df.sparkSession, list(keys)
    pts = df.select(*keys, F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias("x"))
    pts = pts.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    leaves = _table(global_index(pts.groupBy("x").agg(F.count(F.lit(1)).alias("w")), ["x"], out="leaf"))
    m = leaves.count()
    merges = _merge_table(_agglomerate(leaves, m, pairs_per_cluster, max(task_clusters, 2), block), spark, m)

    top_k = min(max(ks), m)
    tops = leaves.select("leaf", "w")
    if top_k < m:
        roots = _roots(merges, m, top_k)
        tops = tops.join(roots, F.col("leaf") == F.col("node"), "left").withColumn("root", F.coalesce("root", "leaf"))
    else:
        tops = tops.withColumn("root", F.col("leaf"))
    tops = _table(tops.select("leaf", "w", "root"))
    small = [tuple(r) for r in tops.groupBy("root").agg(F.sum("w"), F.min("leaf")).collect()]        # top_k rows
    above = [tuple(r) for r in merges.where(F.col("merge_id") >= m - top_k).orderBy("merge_id")
             .select("merge_id", "left_node", "right_node").collect()]                             # top_k - 1 rows
    numbers = spark.createDataFrame(_cluster_numbers(small, above, m, ks), "k int, root long, cluster int")
    assigned = _table(pts.join(leaves.select("x", "leaf"), "x").join(tops.select("leaf", "root"), "leaf")
                           .select(*keys, "root"))
    labels = {k: assigned.join(F.broadcast(numbers.where(F.col("k") == k).drop("k")), "root").select(*keys, "cluster")
              for k in ks}
    return WardResult(labels=labels, merges=merges, leaves=m)


def kmeans_labels(df: DataFrame, features: Sequence[str], keys: Sequence[str], k: int,
                  seed: int = 42, max_iter: int = 20) -> DataFrame:
    """MLlib K-means labels for the rows (the note's alternative to Ward)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    vec = df.select(*keys, array_to_vector(F.array(*[F.col(f"`{c}`").cast("double") for c in features])).alias("_fv"))
    model = KMeans(k=k, seed=seed, featuresCol="_fv", predictionCol="cluster", maxIter=max_iter).fit(vec)
    return model.transform(vec).select(*keys, "cluster")
