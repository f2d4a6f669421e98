"""Exact decision trees: every distinct threshold, missing values routed, any depth.

*Split search.*  A split is a feature, a threshold halfway between two
neighbouring values of the node's rows, and a side for rows without a value:
both sides are tried, and "has a value" against "has none" as well.  The score is
the entropy gain in bits or the share of the squared error that goes away,
rounded to 10 decimals; ties go to the first feature, the least threshold, the
left side.  Where no training row of the node lacks the value, such rows follow
the larger side.  A node is split while it is impure, not too deep, and has a
split that leaves ``min_leaf`` rows on both sides.

*Large nodes*, of more than ``task_rows`` rows, are split level by level, all of
them at once: one aggregate by (node, feature, value), range-partitioned by
these, prefix sums inside a partition plus what the partitions before hold.
*Smaller nodes* are grown to their end by one task each, with the same search on
sorted columns.  The two agree, so ``task_rows`` bounds a task and does not
change a tree.

Many trees grow together (``tree``: all folds and leaf sizes of a grid).  A tree
cut at a depth is the tree grown to that depth, so a grid's depths share one
growth.  Nodes are known by their path from the root (letters l and r).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattlane.session import ship_package, written_table

#: Node tables up to so many rows go to the tasks that route rows; beyond, rows are routed by joins.
CLOSURE_NODES = 200_000
#: Fixed value: an impurity up to this is none.
PURE = 1e-9

_NODE = ("tree int, path string, depth int, feature int, threshold double, missing_left boolean, "
         "stats array<double>, impurity double, gain double")


def _table(df: DataFrame) -> DataFrame:
    return written_table(df, "tree")


# ---------------------------------------------------------------------- one node, in a task

def impurity(stats: np.ndarray, classes: int) -> np.ndarray:
    """Entropy in bits of class counts, or mean squared error of (n, sum, sum of squares), along the first axis."""
    if classes:
        n = np.maximum(stats.sum(axis=0), 1e-300)
        p = stats / n
        return -(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=0)
    n = np.maximum(stats[0], 1e-300)
    return np.maximum(stats[2] / n - (stats[1] / n) ** 2, 0.0)


def _count(stats: np.ndarray, classes: int) -> np.ndarray:
    return stats.sum(axis=0) if classes else stats[0]


def best_split(x: np.ndarray, rows: np.ndarray, classes: int, min_leaf: int) -> tuple | None:
    """(score, feature, threshold, missing left) of the best split of rows ``x`` (nan: missing) with statistics ``rows``."""
    step = max(1, 2_000_000 // (len(x) * rows.shape[1]))        # features at once, for bounded memory
    found = [_best_of(x[:, a:a + step], rows, classes, min_leaf, a) for a in range(0, x.shape[1], step)]
    best = max((f for f in found if f), key=lambda t: t[:4], default=None)
    return best and (best[0], -best[1], -best[2], best[4])


def _best_of(x: np.ndarray, rows: np.ndarray, classes: int, min_leaf: int, first: int) -> tuple | None:
    """``best_split`` of features ``first``, ...: (score, -feature, -threshold, tried side, missing left)."""
    n, total = len(x), rows.sum(axis=0)
    whole = float(impurity(total, classes))
    order = np.argsort(x, axis=0, kind="stable")                # missing values come last
    values = np.take_along_axis(x, order, axis=0)
    left = np.moveaxis(np.cumsum(rows[order], axis=0), 2, 0)    # statistics x position x feature
    missing = np.isnan(x)
    lost = rows.T @ missing                                     # statistics x feature
    n_lost = missing.sum(axis=0)
    after = np.vstack([values[1:], np.full((1, x.shape[1]), np.nan)])
    known = ~np.isnan(values)
    best = None
    for to_left in (True, False):
        here = left + lost[:, None, :] if to_left else left
        there = total[:, None, None] - here
        nl, nr = _count(here, classes), _count(there, classes)
        between = known & (after > values)
        if to_left:
            ok = between & (n_lost > 0)[None, :]
        else:                   # the last known value: known against missing
            ok = between | (known & np.isnan(after) & (n_lost > 0)[None, :])
        ok &= (nl >= min_leaf) & (nr >= min_leaf)
        if not ok.any():
            continue
        with np.errstate(all="ignore"):
            gain = whole - (nl * impurity(here, classes) + nr * impurity(there, classes)) / n
            score = np.round(gain if classes else gain / whole, 10)
        score[~ok] = -np.inf
        for f in np.flatnonzero(score.max(axis=0) == score.max()):
            i = int(score[:, f].argmax())                       # the least threshold
            low, high = values[i, f], after[i, f]
            cut = np.inf if np.isnan(high) else (low + high) / 2
            side = to_left if n_lost[f] else bool(nl[i, f] > nr[i, f])
            found = (float(score[i, f]) + 0.0, -int(f) - first, -float(cut if cut < high or np.isinf(cut) else low), to_left, side)
            best = max(best or found, found, key=lambda t: t[:4])
    return best


def grow_here(x: np.ndarray, rows: np.ndarray, path: str, classes: int, max_depth: int, min_leaf: int) -> Iterator[tuple]:
    """Nodes (path, depth, feature, threshold, missing left, statistics, impurity, gain) of a subtree."""
    todo = [(path, np.arange(len(x)))]
    while todo:
        path, at = todo.pop()
        stats = rows[at].sum(axis=0)
        whole = float(impurity(stats, classes))
        split = None
        if len(path) < max_depth and len(at) >= 2 * min_leaf and whole > PURE:
            split = best_split(x[at], rows[at], classes, min_leaf)
        if split is None:
            yield path, len(path), None, None, None, stats.tolist(), whole, None
            continue
        score, f, cut, to_left = split
        yield path, len(path), f, cut, to_left, stats.tolist(), whole, score if classes else score * whole
        v = x[at, f]
        left = np.where(np.isnan(v), to_left, v <= cut)
        todo += [(path + "l", at[left]), (path + "r", at[~left])]


def _statistics(y: np.ndarray, classes: int) -> np.ndarray:
    if classes:
        return np.eye(classes)[y.astype(int)]
    return np.stack([np.ones(len(y)), y, y * y], axis=1)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


# ---------------------------------------------------------------------- one level of large nodes

def _impurity(stats: Sequence[Column], classes: int) -> Column:
    if classes:
        n = sum(stats[1:], stats[0])
        parts = [F.when(s > 0, -(s / n) * F.log2(s / n)).otherwise(0.0) for s in stats]
        return sum(parts[1:], parts[0])
    return F.greatest(stats[2] / stats[0] - (stats[1] / stats[0]) * (stats[1] / stats[0]), F.lit(0.0))


def _n(stats: Sequence[Column], classes: int) -> Column:
    return sum(stats[1:], stats[0]) if classes else stats[0]


def _level(large: DataFrame, totals: DataFrame, classes: int, leaf: Column) -> DataFrame:
    """The best split (tree, path, best) of every node of ``large``; ``totals``: (tree, path, t0, t1, ...)."""
    width = classes or 3
    s, key = [f"s{i}" for i in range(width)], ["tree", "path", "f"]
    y = F.col("y")
    own = [(y == i).cast("double") for i in range(classes)] if classes else [F.lit(1.0), y, y * y]
    cells = large.select("tree", "path", *[c.alias(n) for c, n in zip(own, s)], F.posexplode("x").alias("f", "v"))
    cells = cells.groupBy(*key, "v").agg(*[F.sum(n).alias(n) for n in s])
    parts = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = _table(cells.repartitionByRange(parts, *key, "v").withColumn("part", F.spark_partition_id()))
    lost = cells.where("v is null").groupBy(*key).agg(*[F.sum(n).alias(f"m{i}") for i, n in enumerate(s)])
    known = cells.where("v is not null")
    over = Window.partitionBy(*key).orderBy("part")             # one row per partition and (node, feature)
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    ends = known.groupBy(*key, "part").agg(F.min("v").alias("least"), *[F.sum(n).alias(n) for n in s]).select(
        *key, "part", F.lead("least").over(over).alias("next_part"),
        *[F.coalesce(F.sum(n).over(before), F.lit(0.0)).alias(f"b{i}") for i, n in enumerate(s)])
    inside = Window.partitionBy(*key, "part").orderBy("v")
    run = known.select(*key, "part", "v", F.lead("v").over(inside).alias("after"), *[F.sum(n).over(inside).alias(n) for n in s])
    run = run.join(ends, [*key, "part"]).join(lost, key, "left").join(F.broadcast(totals), ["tree", "path"])
    run = run.withColumns({f"l{i}": F.col(n) + F.col(f"b{i}") for i, n in enumerate(s)}
                          | {f"m{i}": F.coalesce(F.col(f"m{i}"), F.lit(0.0)) for i in range(width)}
                          | {"after": F.coalesce("after", "next_part")})
    some = _n([F.col(f"m{i}") for i in range(width)], classes) > 0
    sides = F.when(some & F.col("after").isNull(), F.array(F.lit(False))).when(some, F.array(F.lit(True), F.lit(False))).when(
        F.col("after").isNotNull(), F.array(F.lit(False)))
    run = run.withColumn("missing", F.explode(sides))
    here = [F.col(f"l{i}") + F.when(F.col("missing"), F.col(f"m{i}")).otherwise(0.0) for i in range(width)]
    total = [F.col(f"t{i}") for i in range(width)]
    there = [t - h for t, h in zip(total, here)]
    nl, nr, whole = _n(here, classes), _n(there, classes), _impurity(total, classes)
    gain = whole - (nl * _impurity(here, classes) + nr * _impurity(there, classes)) / (nl + nr)
    middle = (F.col("v") + F.col("after")) / 2
    cut = F.when(F.col("after").isNull(), F.lit(float("inf"))).when(middle < F.col("after"), middle).otherwise(F.col("v"))
    side = F.when(some, F.col("missing")).otherwise(nl > nr)
    best = F.struct(F.round(gain if classes else gain / whole, 10).alias("score"), (-F.col("f")).alias("f"), (-cut).alias("cut"),
                    F.col("missing").alias("m"), side.alias("side"))
    return run.where((nl >= leaf) & (nr >= leaf) & (whole > PURE)).groupBy("tree", "path").agg(F.max(best).alias("best"))


# ---------------------------------------------------------------------- trees

@dataclass
class TreeModel:
    """Grown trees; ``transform`` routes the rows of a table with the feature columns through tree 0."""
    nodes: DataFrame                    # see _NODE
    features: list[str]
    classes: int = 0
    texts: dict[str, list[str]] = field(default_factory=dict)

    @property
    def stages(self) -> list:
        return [self]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``, and ``probability`` (one share per class) for a classifier."""
        d = df.withColumn("_x", feature_array(df, self.features, self.texts))
        out = route(d.withColumn("_tree", F.lit(0)), self.nodes, [10 ** 6]).withColumn("_s", F.col("_at")[0])
        if self.classes:
            n = F.aggregate("_s", F.lit(0.0), lambda a, v: a + v)
            out = out.withColumns({"prediction": (F.array_position(F.col("_s"), F.array_max("_s")) - 1).cast("double"),
                                   "probability": F.transform("_s", lambda v: v / n)})
        else:
            out = out.withColumn("prediction", F.col("_s")[1] / F.col("_s")[0])
        return out.drop("_x", "_tree", "_at", "_s")


def feature_array(df: DataFrame, features: Sequence[str], texts: dict[str, list[str]] | None = None) -> Column:
    """Numbers (null and NaN as missing) and a 0/1 entry per known text value; a text of its own is all zeros."""
    out = []
    for c in features:
        v = F.col(f"`{c}`").cast("double")
        out.append(F.when(~F.isnan(v), v))
    for c, values in (texts or {}).items():
        out += [F.when(F.col(f"`{c}`") == v, 1.0).otherwise(0.0) for v in values]
    return F.array(*out).cast("array<double>")


def grow(rows: DataFrame, limits: dict[int, tuple[int, int]], classes: int = 0, task_rows: int = 200_000) -> DataFrame:
    """Node table of all trees.

    ``rows``: (tree int, y double, x array<double>); ``limits``: tree -> (max_depth, min_leaf);
    ``classes``: number of classes (y is 0, 1, ...), or 0 for a regression.
    """
    spark = rows.sparkSession
    ship_package(spark)
    width = classes or 3
    deepest = max(d for d, _ in limits.values())
    depth_of = F.element_at(F.create_map(*[F.lit(v) for t, (d, _) in limits.items() for v in (t, d)]), F.col("tree"))
    leaf_of = F.element_at(F.create_map(*[F.lit(v) for t, (_, m) in limits.items() for v in (t, m)]), F.col("tree"))
    y = F.col("y")
    own = [(y == i).cast("double") for i in range(classes)] if classes else [F.lit(1.0), y, y * y]

    def finish(table: pa.Table) -> pa.Table:
        tree, path = table.column("tree")[0].as_py(), table.column("path")[0].as_py()
        depth, least = limits[tree]
        found = grow_here(_matrix(table.column("x")), _statistics(table.column("y").to_numpy(), classes), path, classes, depth, least)
        cols = list(zip(*[(tree, *n) for n in found]))
        types = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.list_(pa.float64()), pa.float64(), pa.float64()]
        names = [c.split()[0] for c in _NODE.split(", ")]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    at = rows.select("tree", F.lit("").alias("path"), F.col("y").cast("double").alias("y"), "x")
    made: list[DataFrame] = []
    for depth in range(deepest + 1):
        at = _table(at)
        totals = _table(at.groupBy("tree", "path").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"t{i}") for i, c in enumerate(own)]))
        big = totals.where(F.col("n") > task_rows)
        if not big.limit(1).count():
            break
        keys = big.select("tree", "path")
        made.append(at.join(F.broadcast(keys), ["tree", "path"], "left_anti").groupBy("tree", "path").applyInArrow(finish, _NODE))
        large = at.join(F.broadcast(keys), ["tree", "path"], "left_semi")            # at most rows / task_rows nodes
        stats = [F.col(f"t{i}") for i in range(width)]
        splits = _table(_level(large.where(depth < depth_of), big.drop("n"), classes, leaf_of))
        nodes = big.join(splits, ["tree", "path"], "left")
        whole = _impurity(stats, classes)
        made.append(_table(nodes.select(
            "tree", "path", F.lit(depth).alias("depth"), (-F.col("best.f")).cast("int").alias("feature"), (-F.col("best.cut")).alias("threshold"),
            F.col("best.side").alias("missing_left"), F.array(*stats).alias("stats"), whole.alias("impurity"),
            (F.col("best.score") if classes else F.col("best.score") * whole).alias("gain"))))
        v = F.get("x", (-F.col("best.f")).cast("int"))
        left = F.when(v.isNull(), F.col("best.side")).otherwise(v <= -F.col("best.cut"))
        at = large.join(F.broadcast(splits), ["tree", "path"]).select(
            "tree", F.concat("path", F.when(left, "l").otherwise("r")).alias("path"), "y", "x")
    made.append(at.groupBy("tree", "path").applyInArrow(finish, _NODE))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return _table(out)


def route(df: DataFrame, nodes: DataFrame, depths: Sequence[int], closure_nodes: int = CLOSURE_NODES) -> DataFrame:
    """``df`` (with ``_tree``, ``_x``) and ``_at``: per depth the statistics of the deepest node up to it."""
    if nodes.count() > closure_nodes:
        return _route_by_joins(df, nodes, depths)
    ship_package(df.sparkSession)
    kept = nodes.select("tree", "path", "feature", "threshold", "missing_left", "stats").collect()      # counted above
    number = {(r.tree, r.path): i for i, r in enumerate(kept)}
    roots = {r.tree: i for i, r in enumerate(kept) if r.path == ""}
    inner = np.array([r.feature is not None for r in kept], bool)
    feature = np.array([r.feature or 0 for r in kept], int)
    cut = np.array([0.0 if r.threshold is None else r.threshold for r in kept])
    side = np.array([bool(r.missing_left) for r in kept])
    child = np.array([[number.get((r.tree, r.path + s), 0) for s in "lr"] for r in kept], int).reshape(-1, 2)
    stats = np.array([r.stats for r in kept])
    last = max((len(r.path) for r in kept), default=0)
    stops = list(depths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(pa.chunked_array([batch.column("_x")]))
            at = np.array([roots[t] for t in batch.column("_tree").to_pylist()], int)
            seen = {}
            for depth in range(last + 1):
                if depth in stops:
                    seen[depth] = at
                v = x[np.arange(len(x)), feature[at]]
                to_left = np.where(np.isnan(v), side[at], v <= cut[at])
                at = np.where(inner[at], child[at, np.where(to_left, 0, 1)], at)
            found = [stats[seen.get(d, at)] for d in stops]
            lists = [[f[i].tolist() for f in found] for i in range(len(x))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.list_(pa.float64())))], [*batch.schema.names, "_at"])

    from pyspark.sql import types as T
    schema = T.StructType([*df.schema.fields, T.StructField("_at", T.ArrayType(T.ArrayType(T.DoubleType())))])
    return df.mapInArrow(run, schema)


def _route_by_joins(df: DataFrame, nodes: DataFrame, depths: Sequence[int]) -> DataFrame:
    """``route`` with a join per level, for node tables of any size."""
    plain = nodes.select(F.col("tree").alias("_tree"), F.col("path").alias("_path"), "feature", "threshold", "missing_left", "stats")
    names = [f"_d{i}" for i in range(len(depths))]
    cur = df.withColumns({"_path": F.lit(""), "_open": F.lit(True)} | {n: F.lit(None).cast("array<double>") for n in names})
    for depth in range(nodes.agg(F.max("depth")).first()[0] + 1):
        met = cur.join(plain, ["_tree", "_path"], "left")
        v = F.get("_x", F.col("feature"))
        step = F.when(F.when(v.isNull(), F.col("missing_left")).otherwise(v <= F.col("threshold")), "l").otherwise("r")
        more = F.col("_open") & F.col("feature").isNotNull()
        kept = {n: F.when((F.lit(depth) <= d) & F.col("_open"), F.col("stats")).otherwise(F.col(n)) for n, d in zip(names, depths)}
        cur = _table(met.withColumns(kept | {"_path": F.when(more, F.concat("_path", step)).otherwise(F.col("_path")), "_open": more})
                     .drop("feature", "threshold", "missing_left", "stats"))
    return cur.withColumn("_at", F.array(*names)).drop("_path", "_open", *names)


def node_table(spark: SparkSession, model: TreeModel, names: Sequence[str]) -> DataFrame:
    """(node_id, feature, threshold, gain, impurity, prediction, class_counts, left_child, right_child, missing_left), numbered root first."""
    from wattlane.operators.numbering import global_index
    numbered = _table(global_index(model.nodes.where("tree = 0"), ["path"], out="id"))
    ids = numbered.select(F.col("path").alias("cpath"), F.col("id").cast("int").alias("cid"))
    feature = F.get(F.array(*[F.lit(n) for n in names]), F.col("feature"))
    value = (F.array_position(F.col("stats"), F.array_max("stats")) - 1).cast("double") if model.classes else F.col("stats")[1] / F.col("stats")[0]
    out = numbered
    for side in ("left", "right"):
        out = out.join(ids.withColumnsRenamed({"cpath": f"{side}_path", "cid": f"{side}_child"}),
                       F.concat("path", F.lit(side[0])) == F.col(f"{side}_path"), "left")
    return out.select(F.col("id").cast("int").alias("node_id"), feature.alias("feature"), "threshold", "gain", "impurity", value.alias("prediction"),
                      F.col("stats").alias("class_counts"), "left_child", "right_child", "missing_left")
