"""Operator 7: near-duplicate embeddings by cross-polytope hashing with multiprobe buckets.

Vectors of one label (and length) are compared.  Equal vectors are one class
with a multiplicity.  In each of ``tables`` hash tables a class is turned by two
independent pseudo-random rotations (three rounds of random signs and a fast
Hadamard transform each); the nearest vertex of the cross-polytope, i.e. the
largest coordinate and its sign, is the hash of each, the pair of them the
bucket.  A class is stored in its own bucket and probes the two next ones (the
second vertex of either rotation).  At cosine 0.98 in 64 dimensions a pair meets
in a table with probability 0.85, in one of eight with more than 0.999999.

Classes that meet, one of them in its own bucket, are verified by their cosine
in double precision.  Buckets are cut into blocks of at most about
``block`` classes; every pair of blocks is a group of its own, so a bucket that
holds a third of all vectors is spread over many tasks, and a group is a
matrix product of bounded size.  A group does not emit its pairs: it emits how
many vectors each class links with, and the edges of a spanning forest.  A pair
that meets several times is counted in the first table, at the smallest code.

Vectors that are null, zero, or hold null or non-finite components, and vectors
with a null label, link with nothing.  Repeated rows are vectors of their own.
A null id counts as a vector, but is never the component's id unless it stands
alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlane.llm.common import broadcast_if_small, broadcast_measured, components, materialise
from wattlane.session import ship_package


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal fast Walsh-Hadamard transform of each row (length a power of two)."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def cross_polytope(x: np.ndarray, tables: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the own bucket (n x tables) and of the two probed ones (n x tables x 2)."""
    n, dim = x.shape
    d = 1 << max(dim - 1, 1).bit_length()
    padded = np.zeros((n, d))
    padded[:, :dim] = x
    rng = np.random.default_rng(seed)
    own, probes = np.empty((n, tables), np.int32), np.empty((n, tables, 2), np.int32)
    at = np.arange(n)
    for t in range(tables):
        best = []
        for _ in range(2):
            y = padded
            for signs in rng.choice([-1.0, 1.0], size=(3, d)):
                y = hadamard(y * signs)
            size = np.abs(y)
            i = size.argmax(axis=1)
            size[at, i] = -1
            j = size.argmax(axis=1)
            best.append((2 * i + (y[at, i] < 0), 2 * j + (y[at, j] < 0)))
        (a1, a2), (b1, b2) = best
        own[:, t] = a1 * 2 * d + b1
        probes[:, t, 0], probes[:, t, 1] = a2 * 2 * d + b1, a1 * 2 * d + b2
    return own, probes


def _first_meeting(own_i, probes_i, own_j, probes_j) -> np.ndarray:
    """For pairs (rows): table * 2**32 + code of the first bucket in which one of them is at home."""
    none = np.int64(2 ** 62)
    key = np.full(own_i.shape, none)
    table = np.arange(own_i.shape[1], dtype=np.int64)[None, :] << 32
    meet_i = (own_i == own_j) | (probes_j == own_i[:, :, None]).any(axis=2)
    meet_j = (probes_i == own_j[:, :, None]).any(axis=2)
    key = np.where(meet_i, table + own_i, key)
    key = np.minimum(key, np.where(meet_j, table + own_j, none))
    return key.min(axis=1)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of the component of each of n nodes under edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        nxt = label.copy()
        np.minimum.at(nxt, a, low)
        np.minimum.at(nxt, b, low)
        nxt = nxt[nxt]
        if (nxt == label).all():
            return label
        label = nxt


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys, from batches sorted by them."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        cols = [held.column(k).to_numpy() for k in keys]
        change = np.zeros(len(held) - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = np.r_[0, np.flatnonzero(change) + 1]
        whole = held.combine_chunks()
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield whole.slice(a, b - a)
        held = whole.slice(int(cuts[-1]))
    if held is not None:
        yield held.combine_chunks()


def matrix_of(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 threshold: float = 0.98, tables: int = 8, block: int = 512) -> DataFrame:
    """Rows (id, n_links, component_id, kept) of every row of ``df``."""
    spark = df.sparkSession
    ship_package(spark)
    vec = F.col("vec")
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    usable = (F.col("label").isNotNull() & vec.isNotNull() & (F.size(vec) > 0)
              & ~F.coalesce(F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True))
              & F.exists(vec, lambda v: v != 0))
    classes = materialise(rows.where(usable).groupBy("label", "vec").agg(F.count("*").alias("n"), F.min("id").alias("least"))
                          .withColumn("cid", F.monotonically_increasing_id()), "vec-classes")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = [np.asarray(v, float) for v in batch.column("vec").to_pylist()]
            unit = [(v / np.abs(v).max()) for v in vecs]
            unit = [v / np.sqrt(v @ v) for v in unit]
            out: list = [None] * len(vecs)
            for dim in {len(v) for v in unit}:
                at = [i for i, v in enumerate(unit) if len(v) == dim]
                own, probes = cross_polytope(np.array([unit[i] for i in at]), tables)
                for i, o, p in zip(at, own, probes):
                    out[i] = (unit[i].tobytes(), o.tobytes(), p.tobytes(), [*o.tolist(), *p.ravel().tolist()])
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid"), batch.column("label"), pa.array([len(v) for v in vecs], pa.int32()), batch.column("n"),
                 *[pa.array(c, pa.binary()) for c in cols[:3]], pa.array(cols[3], pa.list_(pa.int32()))],
                ["cid", "label", "dim", "n", "unit", "own", "probes", "codes"])

    label_type = classes.schema["label"].dataType.simpleString()
    coded = materialise(classes.select("cid", "label", "vec", "n").mapInArrow(
        code, f"cid long, label {label_type}, dim int, n long, unit binary, own binary, probes binary, codes array<int>"), "vec-codes")
    entries = coded.select("cid", "label", "dim", F.posexplode("codes").alias("at", "code"))
    home = F.col("at") < tables
    number = F.when(home, F.col("at")).otherwise(F.floor((F.col("at") - tables) / 2)).cast("int")
    bucket = ["space", "tab", "code"]  # space: label and length
    entries = entries.select("cid", home.alias("home"), number.alias("tab"), "code", F.xxhash64("label", "dim").alias("space"))
    entries = materialise(entries, "vec-entries")
    sizes = entries.groupBy(*bucket).agg(F.count("*").alias("m"), F.max("home").alias("lived")).where("m > 1 and lived")
    sizes = broadcast_if_small(materialise(sizes.select(*bucket, F.ceil(F.col("m") / block).cast("int").alias("blocks")), "vec-buckets"), 32)
    mine = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    placed = (entries.join(sizes, bucket).withColumn("mine", mine)
              .select(*bucket, "cid", "home", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
              .select(*bucket, "cid", "home", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"),
                      (F.col("mine") > F.col("other")).alias("right")))
    payload = broadcast_measured(coded.select("cid", "n", "unit", "own", "probes"))
    keys = [*bucket, "lo", "hi"]
    dealt = placed.join(payload, "cid").repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for g in groups_of(batches, keys):
            if len(g) < 2:
                continue
            x, own = matrix_of(g.column("unit"), float), matrix_of(g.column("own"), np.int32)
            probes = matrix_of(g.column("probes"), np.int32).reshape(len(g), tables, 2)
            cid, n = g.column("cid").to_numpy(), g.column("n").to_numpy()
            at_home, right = (g.column(c).to_numpy(zero_copy_only=False) for c in ("home", "right"))
            here = (np.int64(g.column("tab")[0].as_py()) << 32) + g.column("code")[0].as_py()
            same = g.column("lo")[0].as_py() == g.column("hi")[0].as_py()
            if same:
                i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
            else:
                left_at, right_at = np.flatnonzero(~right), np.flatnonzero(right)
                i, j = np.nonzero(x[left_at] @ x[right_at].T >= threshold)
                i, j = left_at[i], right_at[j]
            ok = at_home[i] | at_home[j]
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            once = np.concatenate([_first_meeting(own[a], probes[a], own[b], probes[b]) == here
                                   for a, b in zip(np.array_split(i, len(i) // 50_000 + 1), np.array_split(j, len(i) // 50_000 + 1))])
            links = np.zeros(len(g), np.int64)
            np.add.at(links, i[once], n[j[once]])
            np.add.at(links, j[once], n[i[once]])
            root = _forest(len(g), i, j)
            out += [(int(cid[k]), None, int(links[k])) for k in np.flatnonzero(links)]
            out += [(int(cid[k]), int(cid[root[k]]), 0) for k in np.flatnonzero(root != np.arange(len(g)))]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b", "links"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b", "links"])

    found = materialise(dealt.mapInArrow(compare, "a long, b long, links long"), "vec-links")
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    comp = materialise(components(found.where("b is not null").select("a", "b"), "vec-components"), "vec-comp")
    judged = (classes.select("cid", "label", "vec", "n", "least").join(links.withColumnRenamed("a", "lcid"), F.col("cid") == F.col("lcid"), "left")
              .join(comp, F.col("cid") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "cid")))
    firsts = judged.groupBy("comp").agg(F.min("least").alias("first"))
    judged = judged.join(firsts, "comp").select(
        F.col("label").alias("clabel"), F.col("vec").alias("cvec"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "first")
    judged = broadcast_measured(materialise(judged, "vec-judged"))
    usable_vec = F.when(usable, vec)
    component = F.when(F.col("clabel").isNull(), F.col("id")).otherwise(F.col("first"))
    return (rows.withColumn("uvec", usable_vec).join(judged, (F.col("label") == F.col("clabel")) & (F.col("uvec") == F.col("cvec")), "left")
            .select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                    component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")))
