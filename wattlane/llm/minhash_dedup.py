"""Operator 10: near-duplicate documents by ProbMinHash over weighted word shingles.

*Elements.*  A document is the set of its shingles of five words (fewer words:
one shingle of all), a shingle seen c times weighing 1 + ln c.  Similarity is
the probability Jaccard J_P of two weighted sets, which is the plain Jaccard
where the weights are equal.

*Signature.*  Every element is a Poisson process whose rate is its weight; each
arrival falls on one of ``bands * rows`` components, which keeps the earliest
one.  Elements arrive in rounds, all documents of a batch at once; an element
stops as soon as its next arrival is later than the latest component of its
document (early termination).  Two documents agree in a component with
probability J_P.

*Candidates.*  Documents with equal words are one class.  Bands of a class's
signature are buckets; every class is compared with the least class of each of
its buckets, which is linear in the bucket however large it is.  Where the
links so found leave the others of a bucket in several components, its classes
are compared across components, in blocks: a group of two blocks estimates its
pairs from the signatures, decides the near ones by their shingles, leaves out
what its own links have connected already, and emits the links that connect -
fewer than it has classes.  A pair is handled in the first bucket it shares.
So no link that joins components is lost, and a bucket of thousands of near
copies never becomes a table of pairs.

*Verification.*  A pair is first estimated by its signatures; below the
threshold less five standard deviations it is dropped, the others are decided
by their exact J_P from the texts.

*Groups* are the connected components of the links.

Documents without words link with nothing.  Rows equal in id and text are one
document.  A null id sorts last in its group.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlane.llm.common import broadcast_if_small, components, doc_key, materialise, small_batches, text_or_empty
from wattlane.llm.embedding_dedup import groups_of, matrix_of
from wattlane.llm.piece_codec import slices
from wattlane.session import ship_package

_BASE = 0x9E3779B97F4A7C15 | 1  # odd, so invertible modulo 2**64
_INVERSE = pow(_BASE, -1, 2 ** 64)
#: Largest side of a join, in bytes, that is broadcast: one of tens in a run, each of which the driver holds for a while.
_BROADCAST = 8 << 20
_IS_WORD = np.array([c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A for c in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)])
                                      for b in (_BASE, _INVERSE))
        return self.up, self.down


_POWERS = _Powers()


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and the number of words of each text."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes: A-Z alone are lowered
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    inside = _IS_WORD[data]
    edge = np.diff(np.r_[False, inside].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _POWERS.get(len(data) + 1)
    total = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], dtype=np.uint64)]
    h = mix((total[end] - total[start]) * down[start] + mix((end - start).astype(np.uint64)))
    ends = np.cumsum([len(r) + 1 for r in raw])
    return h, np.diff(np.r_[0, np.searchsorted(start, ends)])


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes per text in ascending order, their weights, and how many each text has."""
    counts = np.asarray(counts, np.int64)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.repeat(np.cumsum(counts) - counts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    text = np.repeat(np.arange(len(counts)), n)
    length = np.minimum(counts, k)[text]
    padded = np.r_[hashes, np.zeros(k, np.uint64)]
    s = mix(length.astype(np.uint64))
    for i in range(k):
        s = np.where(i < length, mix(s * np.uint64(_BASE) + padded[first + i]), s)
    order = np.lexsort((s, text))
    s, text = s[order], text[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (text[1:] != text[:-1])] if len(s) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    times = np.diff(np.r_[at, len(s)])
    return s[at], 1.0 + np.log(times), np.bincount(text[at], minlength=len(counts))


def prob_minhash(elements: np.ndarray, weights: np.ndarray, counts: np.ndarray, m: int) -> np.ndarray:
    """ProbMinHash signatures (texts x m) of weighted sets: per component the element of the earliest arrival."""
    n = len(counts)
    best = np.full(n * m, np.inf)
    owner = np.zeros(n * m, np.uint64)
    text = np.repeat(np.arange(n), counts)
    seed, rate, time = elements, weights.astype(float), np.zeros(len(elements))
    latest = np.full(n, np.inf)
    done = 0  # arrivals of every element still running
    while len(seed):
        block = int(np.clip(30_000 // len(seed), 1, 64))
        step = (np.arange(done, done + block, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(_BASE)
        a = mix(seed[:, None] + step)
        gap = -np.log(((a >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53) / rate[:, None]
        when = time[:, None] + np.cumsum(gap, axis=1)
        slot = (text[:, None] * m + (mix(a ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(m)).astype(np.int64)).ravel()
        flat, who = when.ravel(), np.repeat(seed, block)
        useful = flat < best[slot]
        slot, flat, who = slot[useful], flat[useful], who[useful]
        np.minimum.at(best, slot, flat)
        won = flat == best[slot]
        owner[slot[won]] = who[won]
        time, done = when[:, -1], done + block
        touched = np.unique(text)
        latest[touched] = best.reshape(n, m)[touched].max(axis=1)
        run = time < latest[text]
        seed, rate, time, text = seed[run], rate[run], time[run], text[run]
    return owner.reshape(n, m)


def prob_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact J_P of two weighted sets given by ascending element hashes and weights."""
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = wa[ia], wb[ib]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    # sum over j of max(x_j / x_i, y_j / y_i): x counts from i on, y before it
    above = only_a + np.cumsum(x[::-1])[::-1]
    below = only_b + np.cumsum(y) - y
    return float((1.0 / (above / x + below / y)).sum())


def _signature_table(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, k: int) -> DataFrame:
    """Rows (id, dkey, cls, bands, sig) of every row of ``docs`` that has words."""
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn(
        "dkey", doc_key(F.col("id"), F.col("text")))
    id_type = base.schema["id"].dataType.simpleString()
    m = bands * rows
    salt = mix(np.arange(1, m + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices((x.as_py() for x in batch.column("text")), 1_000_000):
                hashes, counts = word_hashes(texts)
                s, w, n = shingles(hashes, counts, k)
                keep = np.flatnonzero(counts > 0)
                ends = np.cumsum(counts)
                cls = [hashlib.md5(hashes[ends[i] - counts[i]:ends[i]].tobytes()).digest() for i in keep.tolist()]
                sig = prob_minhash(s, w, n[keep], m)
                band = mix((mix(sig) * salt).reshape(len(keep), bands, rows).sum(axis=2, dtype=np.uint64)
                           + mix(np.arange(bands, dtype=np.uint64)))
                low = (mix(sig) & np.uint64(255)).astype(np.uint8)
                take = pa.array(keep)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a).take(take), batch.column("dkey").slice(a, b - a).take(take),
                     pa.array(cls, pa.binary()),
                     pa.FixedSizeListArray.from_arrays(pa.array(band.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64())),
                     pa.array([r.tobytes() for r in low], pa.binary())], ["id", "dkey", "cls", "bands", "sig"])

    return base.mapInArrow(run, f"id {id_type}, dkey binary, cls binary, bands array<long>, sig binary")


def _estimates(sig_a: np.ndarray, sig_b: np.ndarray) -> np.ndarray:
    """Shares of equal components of every row of one matrix with every row of the other."""
    out = np.empty((len(sig_a), len(sig_b)))
    for i in range(0, len(sig_a), 64):
        out[i:i + 64] = np.count_nonzero(sig_a[i:i + 64, None, :] == sig_b[None, :, :], axis=2)
    return out / sig_a.shape[1]


def _near_in_groups(groups: Iterator[pa.Table], bands: int, floor: float) -> Iterator[tuple]:
    """(group, i, j, estimates, component numbers): near pairs across components, in their first shared bucket."""
    for g in groups:
        if len(g) < 2:
            continue
        sig = matrix_of(g.column("sig"), np.uint8)
        band_of = np.array(g.column("bands").combine_chunks().flatten()).reshape(len(g), bands)
        comp = np.unique(np.array(g.column("comp").to_pylist(), object), return_inverse=True)[1]
        right = g.column("right").to_numpy(zero_copy_only=False)
        if g.column("lo")[0].as_py() == g.column("hi")[0].as_py():
            est = np.triu(_estimates(sig, sig), 1)
            i, j = np.nonzero(est >= floor)
            est = est[i, j]
        else:
            x, y = np.flatnonzero(~right), np.flatnonzero(right)
            est = _estimates(sig[x], sig[y])
            i, j = np.nonzero(est >= floor)
            est, i, j = est[i, j], x[i], y[j]
        band = g.column("band")[0].as_py()
        ok = (comp[i] != comp[j]) & ~(band_of[i, :band] == band_of[j, :band]).any(axis=1)
        if ok.any():
            yield g, i[ok], j[ok], est[ok], comp


class _Near:
    """Verification over one table of classes: estimates, shingles of the classes that need them, exact J_P."""

    def __init__(self, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, bands: int, m: int, k: int,
                 threshold: float, block: int):
        self.docs, self.classes, self.id_col, self.text_col = docs, classes, id_col, text_col
        self.bands, self.m, self.k, self.threshold, self.block = bands, m, k, threshold, block
        self.floor = threshold - 5 * math.sqrt(threshold * (1 - threshold) / m)
        self.sets: list[DataFrame] = []  # tables (cls, s, w) made so far

    def shingled(self, wanted: DataFrame) -> DataFrame:
        """Rows (cls, s, w) of at least the classes ``wanted``; only those still missing are read."""
        for made in self.sets:
            wanted = wanted.join(made, "cls", "left_anti")
        wanted = materialise(wanted.join(self.classes.select("cls", "dkey"), "cls").select(F.col("dkey").alias("wkey"), "cls"), "minhash-wanted")
        if wanted.limit(1).count():
            text, k = text_or_empty(self.text_col), self.k
            texts = (self.docs.select(doc_key(F.col(self.id_col), text).alias("wkey"), text.alias("text"))
                     .join(broadcast_if_small(wanted, 96, _BROADCAST), "wkey").groupBy("cls").agg(F.first("text").alias("text")))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for a, b, part in slices((x.as_py() for x in batch.column("text")), 1_000_000):
                        s, w, n = shingles(*word_hashes(part), k)
                        at = pa.array(np.r_[0, np.cumsum(n)], pa.int32())
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("cls").slice(a, b - a), pa.ListArray.from_arrays(at, pa.array(s.view(np.int64))),
                             pa.ListArray.from_arrays(at, pa.array(w))], ["cls", "s", "w"])
            self.sets.append(materialise(texts.mapInArrow(run, "cls binary, s array<long>, w array<double>"), "minhash-sets"))
        if not self.sets:
            return self.docs.sparkSession.createDataFrame([], "cls binary, s array<long>, w array<double>")
        return reduce(DataFrame.unionAll, self.sets)

    def meet(self, pairs: DataFrame, payload: DataFrame) -> DataFrame:
        """Rows (b, salt, a, payload) sorted by group: the members a of b in blocks, and one row of b itself (a null) per block.

        A representative of very many members is so met in many groups, and its
        payload is there once per block, not once per member.
        """
        many = materialise(pairs.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > self.block)
                           .select(F.col("b").alias("hb"), F.ceil(F.col("n") / self.block).alias("blocks")), "minhash-many")
        salt = F.pmod(F.xxhash64("a"), F.coalesce("blocks", F.lit(1).cast("long")))
        placed = materialise(pairs.join(broadcast_if_small(many, 64, _BROADCAST), F.col("b") == F.col("hb"), "left").select("b", salt.alias("salt"), "a"), "minhash-placed")
        cols = [c for c in payload.columns if c != "cls"]
        members = placed.join(payload, F.col("a") == F.col("cls")).select("b", "salt", "a", *cols)
        heads = placed.select("b", "salt").distinct().join(payload, F.col("b") == F.col("cls")).select(
            "b", "salt", F.lit(None).cast("binary").alias("a"), *cols)
        return heads.unionByName(members).repartition("b", "salt").sortWithinPartitions("b", "salt", "a")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) at or above the threshold."""
        m, floor, threshold = self.m, self.floor, self.threshold
        pairs = materialise(pairs, "minhash-pairs")

        def kept(g: pa.Table, at: np.ndarray) -> pa.RecordBatch:
            some = g.select(["a", "b"]).take(pa.array(at)).combine_chunks()
            return pa.RecordBatch.from_arrays([some.column(c).combine_chunks() for c in ("a", "b")], ["a", "b"])

        def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in groups_of(batches, ["b", "salt"]):
                sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint8).reshape(-1, m)
                yield kept(g, np.flatnonzero((sig[1:] == sig[0]).mean(axis=1) >= floor) + 1)

        near = materialise(self.meet(pairs, self.classes.select("cls", "sig")).mapInArrow(estimate, "a binary, b binary"), "minhash-near")
        shingled = self.shingled(near.select(F.explode(F.array("a", "b")).alias("cls")).distinct())

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in groups_of(batches, ["b", "salt"]):
                sets = [(s.values.to_numpy().view(np.uint64), w.values.to_numpy()) for s, w in zip(g.column("s"), g.column("w"))]
                yield kept(g, np.array([i for i in range(1, len(sets)) if prob_jaccard(*sets[i], *sets[0]) >= threshold], np.int64))

        return materialise(self.meet(near, shingled).mapInArrow(exact, "a binary, b binary"), "minhash-links")

    def across(self, open_members: DataFrame, block: int) -> DataFrame:
        """Links between components inside the buckets of ``open_members`` (bucket, band, cls, comp)."""
        keys, bands, floor = ["band", "bucket", "lo", "hi"], self.bands, self.floor

        def dealt(members: DataFrame, payload: DataFrame) -> DataFrame:
            sizes = materialise(members.groupBy("band", "bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "minhash-sizes")
            mine = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
            placed = (members.join(broadcast_if_small(sizes, 24, _BROADCAST), ["band", "bucket"]).withColumn("mine", mine)
                      .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                      .select("bucket", "band", "cls", "comp", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"),
                              (F.col("mine") > F.col("other")).alias("right")))
            return placed.join(payload, "cls").repartition(*keys).sortWithinPartitions(*keys)

        signed = self.classes.select("cls", "sig", "bands")

        def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g, i, j, _, _ in _near_in_groups(groups_of(batches, keys), bands, floor):
                at = np.unique(np.r_[i, j])
                yield pa.RecordBatch.from_arrays([g.column("cls").take(pa.array(at)).combine_chunks()], ["cls"])

        flagged = materialise(dealt(open_members, signed).mapInArrow(flag, "cls binary").distinct(), "minhash-flagged")
        if not flagged.limit(1).count():
            return self.docs.sparkSession.createDataFrame([], "a binary, b binary")
        payload = signed.join(self.shingled(flagged), "cls")
        near_members = materialise(open_members.join(flagged, "cls", "left_semi"), "minhash-near-members")
        threshold = self.threshold

        def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g, i, j, est, comp in _near_in_groups(groups_of(batches, keys), bands, floor):
                cls, label = g.column("cls").to_pylist(), comp.copy()
                sets: dict[int, tuple] = {}
                out = []
                for t in np.argsort(-est, kind="stable").tolist():
                    a, b = int(i[t]), int(j[t])
                    if label[a] == label[b]:
                        continue
                    for x in (a, b):
                        if x not in sets:
                            sets[x] = (g.column("s")[x].values.to_numpy().view(np.uint64), g.column("w")[x].values.to_numpy())
                    if prob_jaccard(*sets[a], *sets[b]) >= threshold:
                        label[label == label[b]] = label[a]
                        out.append((max(cls[a], cls[b]), min(cls[a], cls[b])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], ["a", "b"])

        return materialise(dealt(near_members, payload).mapInArrow(connect, "a binary, b binary").distinct(), "minhash-across")


def _components_of(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, bands: int, m: int, k: int,
                   threshold: float, block: int) -> DataFrame:
    """Rows (node, component) of the classes that are linked."""
    near = _Near(docs, classes, id_col, text_col, bands, m, k, threshold, block)
    buckets = classes.select("cls", F.posexplode("bands").alias("band", "bucket"))
    reps = materialise(buckets.groupBy("band", "bucket").agg(F.min("cls").alias("rep"), F.max("cls").alias("last"))
                       .where("rep <> last").select("band", "bucket", "rep"), "minhash-reps")
    members = materialise(buckets.join(broadcast_if_small(reps, 64, _BROADCAST), ["band", "bucket"]).where("cls <> rep"), "minhash-members")
    links = near.links(members.select(F.col("cls").alias("a"), F.col("rep").alias("b")).distinct())
    comp = materialise(components(links, "minhash-components"), "minhash-comp")

    # buckets whose others the links leave in several components (the least class has met them all)
    placed = members.join(comp, members.cls == comp.node, "left").select("bucket", "band", "cls", F.coalesce("component", "cls").alias("comp"))
    several = placed.groupBy("band", "bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band", "bucket")
    open_members = materialise(placed.join(several, ["band", "bucket"], "left_semi"), "minhash-open")
    if open_members.limit(1).count():
        more = near.across(open_members, block)
        if more.limit(1).count():
            comp = materialise(components(links.unionAll(more), "minhash-components"), "minhash-comp")
    return comp


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
                    k: int = 5, bands: int = 40, rows: int = 8, block: int = 256) -> DataFrame:
    """Rows (id, dkey, group_id, kept) of every row of ``docs``.

    ``group_id``: the least id of the group; ``kept``: the document with that id
    (the least by id, then by its words).  ``dkey``: the key of (id, text).  A
    pair at the threshold shares a bucket with probability
    1 - (1 - threshold^rows)^bands, 0.9994 here.
    """
    spark = docs.sparkSession
    ship_package(spark)
    m = bands * rows
    with small_batches(spark):
        found = materialise(_signature_table(docs, id_col, text_col, bands, rows, k), "minhash")
    classes = materialise(found.groupBy("cls").agg(
        F.min("id").alias("least_id"), F.min("dkey").alias("dkey"), F.first("bands").alias("bands"),
        F.first("sig").alias("sig")), "minhash-classes")
    with small_batches(spark):  # rows carry shingles
        comp = _components_of(docs, classes, id_col, text_col, bands, m, k, threshold, block)

    least = F.struct(F.col("least_id").isNull().alias("none"), F.col("least_id").alias("id"), F.col("cls").alias("cls"))
    grouped = classes.select("cls", "least_id").join(comp, F.col("cls") == F.col("node"))
    chosen = grouped.groupBy("component").agg(F.min(least).alias("first"))
    linked = (grouped.join(chosen, "component").select(F.col("cls").alias("lcls"), F.col("first.id").alias("gid"),
                                                       F.col("first.cls").alias("gcls")))
    linked = broadcast_if_small(materialise(linked, "minhash-linked"), 64, _BROADCAST)
    per_class = classes.select("cls", "least_id").join(linked, F.col("cls") == F.col("lcls"), "left").select(
        F.col("cls").alias("pcls"), F.coalesce("gid", "least_id").alias("group_id"),
        F.coalesce(F.col("gcls") == F.col("cls"), F.lit(True)).alias("of_first"))
    result = found.select("id", "dkey", "cls").join(per_class, F.col("cls") == F.col("pcls")).select(
        "id", "dkey", "group_id", (F.col("of_first") & F.col("id").eqNullSafe(F.col("group_id"))).alias("kept"))
    result = materialise(result.distinct(), "minhash-result")
    text = text_or_empty(text_col)
    rows_ = docs.select(F.col(id_col).alias(id_col), doc_key(F.col(id_col), text).alias("dkey"))
    return rows_.join(broadcast_if_small(result.select(F.col("dkey").alias("rkey"), "group_id", "kept"), 64, _BROADCAST),
                      F.col("dkey") == F.col("rkey"), "left").select(
        id_col, "dkey", F.when(F.col("rkey").isNull(), F.col(id_col)).otherwise(F.col("group_id")).alias("group_id"),
        F.coalesce("kept", F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, all columns; repeated rows of it become one."""
    judged = near_duplicates(docs, id_col, text_col, **kw)
    per_doc = judged.groupBy("dkey").agg(F.min("kept").alias("kept"), F.count("*").alias("times"))
    odd = materialise(per_doc.where(~F.col("kept") | (F.col("times") > 1)), "minhash-odd")
    odd = broadcast_if_small(odd.select(F.col("dkey").alias("__odd"), F.col("kept").alias("__kept")), 64, _BROADCAST)
    text = text_or_empty(text_col)
    marked = docs.withColumn("__dkey", doc_key(F.col(id_col), text)).join(odd, F.col("__dkey") == F.col("__odd"), "left")
    whole = marked.where("__odd is null").select(*docs.columns)
    once = marked.where("__kept").dropDuplicates(["__dkey"]).select(*docs.columns)
    return whole.unionAll(once)
