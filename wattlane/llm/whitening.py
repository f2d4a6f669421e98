"""Operator 12: whitening of embeddings, eigenpairs by contour integration (FEAST).

*Covariance.*  Entries become whole numbers x = floor(1024 c) + 100000; their
sums are exact.  A second pass centres every row and adds up outer products as
matrix products of an Arrow batch; a task emits one matrix, row by row, and the
rows are added up by (row, task) in a fixed order.  Only the d x d matrix, whose
size depends on the dimension alone, reaches the driver.

*Eigenpairs.*  The inertia of V - s I (signs of the pivots of a tridiagonal form)
counts the eigenvalues above s.  Bisection finds an s with at least k of them
above it, and cuts the range above into intervals of few eigenvalues, at places
that keep clear of any; bounds are then drawn in to the eigenvalues.  For each interval a random block is projected on its
eigenvectors by Gauss-Legendre quadrature over the circle around it: one
complex shifted solve (z I - V) Y = Q per node, and every (interval, node) is a
Spark task of its own.  Rayleigh-Ritz in the projected space gives eigenpairs,
the next block; an interval is done when it holds as many of them as its
inertia count says, each with a residual at rounding level.  A last
Rayleigh-Ritz over all intervals makes the components orthonormal together.

*Whitening.*  One pass over the rows with d x k numbers in the closure.

Rows whose vector is null or empty, or holds null or non-finite entries, are
left out; other lengths than the one of all others are an error.  A null id is
kept; repeated rows each count.  Where an eigenvalue is zero (below rounding of
the largest), ``whitened`` is null.  No rows left: an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlane.llm.common import materialise
from wattlane.session import ship_package

#: x = floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
_EPS = np.finfo(float).eps


# ---------------------------------------------------------------------- eigenpairs of one symmetric matrix

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared off-diagonal of a tridiagonal matrix with the inertias of ``a`` (Householder reflections)."""
    a, d = np.array(a, float), len(a)
    off = np.zeros(max(d - 1, 0))
    for k in range(d - 1):
        x = a[k + 1:, k].copy()
        size = np.linalg.norm(x)
        off[k] = size
        x[0] += size if x[0] >= 0 else -size
        norm = x @ x
        if norm > 0:
            p = a[k + 1:, k + 1:] @ x * (2 / norm)
            p -= x * (x @ p / norm)
            a[k + 1:, k + 1:] -= np.outer(x, p) + np.outer(p, x)
    return np.diag(a).copy(), off ** 2


def above(t: tuple[np.ndarray, np.ndarray], s: float) -> int:
    """Inertia count: eigenvalues above ``s``, the positive pivots of the tridiagonal matrix minus ``s``."""
    count, pivot = 0, 1.0
    for x, o in zip(t[0].tolist(), [0.0, *t[1].tolist()]):
        pivot = x - s - o / pivot
        if pivot == 0.0:
            pivot = -1e-300
        count += pivot > 0
    return count


@dataclass
class Interval:
    low: float
    high: float
    count: int                      # eigenvalues inside, by inertia
    block: np.ndarray               # the vectors to project
    values: np.ndarray | None = None
    vectors: np.ndarray | None = None


def clear_cut(a: tuple, near: float, low: float, high: float, most: int, least: int) -> tuple[float, int] | None:
    """(s, eigenvalues above s) with least <= count <= most, no eigenvalue near s; None where there is none."""
    while high - low > 100 * near:                      # eigenvalues closer than this are not parted
        mid = (low + high) / 2
        n = above(a, mid)
        if least <= n <= most:
            for share in (0.0, 0.25, -0.25, 0.4, -0.4):     # move until a hundredth of the range around is empty
                s, gap = mid + share * (high - low), (high - low) / 100
                if least <= (up := above(a, s + gap)) <= most and above(a, s - gap) == up:
                    return s, up
        if n >= least:
            low = mid
        else:
            high = mid
    return None


def tightened(t: tuple, near: float, low: float, high: float, passed: int, m: int) -> tuple[float, float]:
    """The bounds drawn in to the ``m`` eigenvalues between them, with some room left."""
    def edge(count: int, lo: float, hi: float) -> float:        # where the count above falls to ``count``
        while hi - lo > near:
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if above(t, mid) <= count else (mid, hi)
        return hi

    largest, least = edge(passed, low, high), edge(passed + m - 1, low, high)
    free = least - low, high - largest
    room = max(0.2 * (largest - least), 0.05 * min(free), 16 * near)
    return least - min(free[0], room), largest + min(free[1], room)


def intervals(a: np.ndarray, k: int, few: int = 4, seed: int = 11) -> list[Interval]:
    """Intervals that together hold the ``k`` largest eigenvalues, and few others."""
    d, t = len(a), tridiagonal(a)
    top = np.abs(a).sum(axis=1).max() * (1 + 1e-6)      # above every eigenvalue
    near = 16 * d * _EPS * top
    rng = np.random.default_rng(seed)
    found = clear_cut(t, 1e-7 * top, -0.1 * top, top, min(2 * k, d), k)
    low, n = found or (-0.1 * top, d)
    out, high, passed = [], top, 0
    while passed < n:
        cut = clear_cut(t, 1e-7 * top, low, high, passed + few, passed + 1) if n - passed > few else None
        s, up = cut or (low, n)
        m = up - passed
        out.append(Interval(*tightened(t, near, s, high, passed, m), m, rng.standard_normal((d, min(d, m + m // 2 + 2)))))
        high, passed = s, up
    return out


def project(a: np.ndarray, z: complex, factor: complex, block: np.ndarray) -> np.ndarray:
    """One quadrature node's part of the spectral projection of ``block``."""
    return np.real(factor * np.linalg.solve(z * np.eye(len(a)) - a, block.astype(complex)))


def contour(low: float, high: float, nodes: int) -> list[tuple[complex, complex]]:
    """(z, factor) of Gauss-Legendre nodes on the upper half of the circle over [low, high]."""
    x, w = np.polynomial.legendre.leggauss(nodes)
    turn = np.exp(-0.5j * np.pi * (x - 1))
    radius = (high - low) / 2
    return [(complex((low + high) / 2 + radius * t), complex(v / 2 * radius * t)) for t, v in zip(turn, w)]


def rayleigh_ritz(a: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of ``a`` in the span of ``q``, by falling value; directions filtered out of it are left out."""
    u, s, _ = np.linalg.svd(q, full_matrices=False)
    u = u[:, s > s[0] * 1e-10]
    u = np.linalg.qr(u)[0]
    small = u.T @ a @ u
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return values[::-1], (u @ turn)[:, ::-1]


def feast(spark: SparkSession, a: np.ndarray, k: int, nodes: int = 8, max_rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    d, size = len(a), np.abs(a).sum(axis=1).max()
    if not size > 0:
        return np.zeros(k), np.eye(d)[:, :k]
    scaled = a / size
    todo = intervals(scaled, k)
    done: list[Interval] = []
    schema = "i int, part binary"
    for no in range(max_rounds):
        rows = [(i, z.real, z.imag, f.real, f.imag, iv.block.tobytes(), iv.block.shape[1])
                for i, iv in enumerate(todo) for z, f in contour(iv.low, iv.high, nodes << no // 8)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    block = np.frombuffer(r["block"]).reshape(d, r["width"])
                    part = project(scaled, complex(r["zr"], r["zi"]), complex(r["fr"], r["fi"]), block)
                    yield pa.RecordBatch.from_arrays([pa.array([r["i"]], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["i", "part"])

        solves = spark.createDataFrame(rows, "i int, zr double, zi double, fr double, fi double, block binary, width int")
        sums = [np.zeros_like(iv.block) for iv in todo]
        for r in solves.repartition(len(rows)).mapInArrow(run, schema).collect():      # nodes x intervals blocks of d x few
            sums[r.i] += np.frombuffer(r.part).reshape(sums[r.i].shape)
        open_ones = []
        for iv, q in zip(todo, sums):
            values, vectors = rayleigh_ritz(scaled, q)
            inside = (values > iv.low) & (values < iv.high)
            left = np.linalg.norm(scaled @ vectors - vectors * values, axis=0)
            if inside.sum() == iv.count and (left[inside] <= max(8 * d, 256) * _EPS).all():
                iv.values, iv.vectors = values[inside], vectors[:, inside]
                done.append(iv)
            else:
                short = iv.block.shape[1] - vectors.shape[1] if vectors.shape[1] < iv.count else 0
                iv.block = np.c_[vectors, np.random.default_rng(len(done)).standard_normal((d, short))]
                open_ones.append(iv)
        todo = open_ones
        if not todo:
            break
    else:
        raise RuntimeError(f"feast: {len(todo)} intervals without all their eigenpairs after {max_rounds} rounds")
    values, vectors = rayleigh_ritz(scaled, np.concatenate([iv.vectors for iv in done], axis=1))
    return values[:k] * size, vectors[:, :k]


# ---------------------------------------------------------------------- statistics over all rows

def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _sums(xs: DataFrame, d: int) -> np.ndarray:
    """Exact sum of every dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, np.int64)
        for batch in batches:
            total += _matrix(batch.column("x"), d).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], ["s"])

    per = xs.select("x").mapInArrow(run, "s array<long>").select(F.posexplode("s").alias("i", "v"))
    return np.array([r.v for r in per.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()], np.int64)   # d rows


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n; the whole part of the mean is taken off exactly."""
    whole = sums // n
    return (x - whole).astype(float) - (sums - whole * n) / n


def _covariance(xs: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    d = len(sums)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            c = centred(_matrix(batch.column("x"), d), n, sums)
            total += c.T @ c
        task = TaskContext.get().partitionId()
        for i in range(0, d, 256):
            some = list(range(i, min(i + 256, d)))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([task] * len(some), pa.int32()),
                                              pa.array([total[j].tobytes() for j in some], pa.binary())], ["i", "task", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, out = None, None, []
        for batch in batches:
            for i, v in zip(batch.column("i").to_pylist(), batch.column("v").to_pylist()):
                if i != at:
                    if at is not None:
                        out.append((at, total.tobytes()))
                    at, total = i, np.zeros(d)
                total += np.frombuffer(v)
        if at is not None:
            out.append((at, total.tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int32()), pa.array([v for _, v in out], pa.binary())], ["i", "v"])

    parts = xs.select("x").mapInArrow(products, "i int, task int, v binary").repartition("i").sortWithinPartitions("i", "task")
    found = {r.i: np.frombuffer(r.v) for r in parts.mapInArrow(add, "i int, v binary").collect()}                  # d rows of d
    v = np.array([found[i] for i in range(d)]) / n
    return (v + v.T) / 2


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[Decimal]:
    """Exact sum over dimensions of (n x - S)^2."""
    t = n * x - sums
    if (t.astype(float) ** 2).sum(axis=1).max(initial=0.0) < 2.0 ** 62:
        return [Decimal(v) for v in (t * t).sum(axis=1).tolist()]
    return [Decimal(sum(v * v for v in row)) for row in t.tolist()]


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8) -> DataFrame:
    """Rows (id, component from 1, n, deviation decimal, whitened, explained, identity_error) of every usable row."""
    spark = df.sparkSession
    ship_package(spark)
    vec = F.col("vec")
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    usable = rows.where((F.size(vec) > 0) & ~F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    xs = materialise(usable.select("id", F.transform(vec, lambda v: F.floor(v * SCALE) + OFFSET).alias("x")), "whiten-x")
    n, lo, hi = xs.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x"))).first()
    if lo != hi:
        raise ValueError(f"vectors of one length are needed, found {lo} to {hi}")
    d, k = hi or 0, min(k, hi or 0)
    id_type = xs.schema["id"].dataType.simpleString()
    fields = (f"{id_col} {id_type}, component int, n long, deviation decimal(38,0), whitened double, "
              "explained double, identity_error double")
    if not n:
        return spark.createDataFrame([], fields)

    sums = _sums(xs, d)
    v = _covariance(xs, n, sums)
    values, vectors = feast(spark, v, k)
    trace = float(np.trace(v))
    positive = int((values > d * _EPS * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)    # one sign in every run
    turn = vectors[:, :positive] / np.sqrt(values[:positive])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            w = centred(x, n, sums) @ turn
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_deviation(x, n, sums), pa.decimal128(38, 0)),
                                              pa.array(list(w), pa.list_(pa.float64()))], ["id", "deviation", "w"])

    white = materialise(xs.mapInArrow(run, f"id {id_type}, deviation decimal(38,0), w array<double>"), "whitened")
    error = F.lit(None).cast("double")
    if positive:
        pairs = [F.abs(F.covar_pop(F.col("w")[i], F.col("w")[j]) - (1.0 if i == j else 0.0)) for i in range(positive) for j in range(i, positive)]
        error = F.lit(float(white.agg(F.greatest(*pairs) if len(pairs) > 1 else pairs[0]).first()[0]))
    explained = F.array(*[F.lit(float(e) / trace if trace > 0 else None).cast("double") for e in values])
    numbers = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("c")
    return white.select("id", "deviation", "w", numbers).select(
        F.col("id").alias(id_col), (F.col("c") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.get("w", F.col("c")).alias("whitened"), F.get(explained, F.col("c")).alias("explained"), error.alias("identity_error"))
