"""Embedding and document near-duplicates against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattlane.llm import minhash_dedup as M
from wattlane.llm.common import components
from wattlane.llm.embedding_dedup import cross_polytope, hadamard, near_vectors

from . import brute

DOCS = "doc_id long, text string"


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    want = brute.groups({x for e in edges for x in e}, edges)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: c for n, c in want.items() if n in linked}
    assert components(df.limit(0)).count() == 0


# ---------------------------------------------------------------------- op 7

def test_hadamard_is_orthonormal():
    h = hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(hadamard(h), np.eye(16))


def test_cross_polytope_recall():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    o = rng.normal(size=x.shape)
    o -= (o * x).sum(1)[:, None] * x
    o /= np.linalg.norm(o, axis=1)[:, None]
    y = 0.98 * x + np.sqrt(1 - 0.98 ** 2) * o
    (ox, px), (oy, py) = cross_polytope(x, 8), cross_polytope(y, 8)
    met = (ox == oy) | (py == ox[:, :, None]).any(2) | (px == oy[:, :, None]).any(2)
    assert met.any(1).mean() > 0.999


@pytest.mark.parametrize("block", [4, 512])
def test_vectors_equal_all_pairs(spark, block):
    rng = np.random.default_rng(5)
    vecs = []
    for _ in range(40):
        base = rng.normal(size=12)
        for _ in range(rng.integers(1, 5)):
            vecs.append(base * rng.uniform(0.5, 2) + rng.normal(size=12) * rng.uniform(0, 0.2))
    hot = rng.normal(size=12)
    vecs += [hot + rng.normal(size=12) * 0.03 for _ in range(60)] + [hot] * 25
    rows = [(i, np.float32(v).tolist(), int(i % 3) if i < 60 else 1) for i, v in enumerate(vecs)]
    n = len(rows)
    bad = [None, [0.0] * 12, [float("nan")] + [1.0] * 11, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11, []]
    rows += [(n + i, v, 1) for i, v in enumerate(bad)] + [(n + 10, rows[0][1], None), (n + 11, [1.0, 2.0], 1), (n + 12, [1.0, 2.0], 1),
                                                         (n + 13, [3e30] * 12, 2), (n + 14, [1e-30] * 12, 2)]
    ok = {i: (np.float64(v) / np.abs(np.float64(v)).max(), lab) for i, v, lab in rows
          if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0])
             and ok[a][0] @ ok[b][0] / np.sqrt((ok[a][0] @ ok[a][0]) * (ok[b][0] @ ok[b][0])) >= 0.98]
    comp = brute.groups([r[0] for r in rows], links)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, block=block).collect()}
    assert got == {i: (sum(i in p for p in links), comp[i], comp[i] == i) for i, _, _ in rows}


def test_vectors_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (None, [0.0, 1.0], 1)],
                               "vec_id long, embedding array<float>, label int")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in near_vectors(df).collect())
    assert got == [("1", 2, "1", True), ("1", 2, "1", True), ("None", 0, "None", True), ("None", 2, "1", False)]
    assert near_vectors(df.limit(0)).count() == 0


# ---------------------------------------------------------------------- op 10

def test_probability_jaccard_and_its_estimate():
    rng = np.random.default_rng(0)
    for _ in range(20):
        x, y = ({int(k): float(rng.integers(1, 5)) for k in rng.integers(0, 60, 40)} for _ in range(2))
        sets = [(np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)])) for d in (x, y)]
        exact = brute.prob_jaccard(x, y)
        assert abs(M.prob_jaccard(*sets[0], *sets[1]) - exact) < 1e-9
        el = [M.mix(s[0] + np.uint64(99)) for s in sets]
        sig = M.prob_minhash(np.concatenate(el), np.concatenate([s[1] for s in sets]), np.array([len(x), len(y)]), 3000)
        assert abs((sig[0] == sig[1]).mean() - exact) < 0.05


def test_shingles_do_not_depend_on_the_batch():
    texts = ["", "One two, THREE four five six", "x", "a b c d", "été É 9 " * 5]
    together = M.shingles(*M.word_hashes(texts))
    assert M.word_hashes(texts)[1].tolist() == [len(brute.words(t)) for t in texts]
    assert together[2].tolist() == [len(brute.shingles(t)) for t in texts]
    at = 0
    for i, t in enumerate(texts):
        s, w, n = M.shingles(*M.word_hashes([t]))
        assert (together[0][at:at + len(s)] == s).all() and np.allclose(sorted(w), sorted(brute.shingles(t).values()))
        at += len(s)


def _edited(rng, text, n):
    ws = text.split(" ")
    for _ in range(n):
        ws[rng.randrange(len(ws))] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(ws)


def test_documents_equal_all_pairs(spark):
    rng = random.Random(12)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    docs = [prose(rng.choice([1, 3, 4, 5, 6, 30, 120])) for _ in range(60)]
    for base in [prose(200) for _ in range(6)]:
        docs += [base] + [_edited(rng, base, rng.choice([0, 1, 2, 4, 8])) for _ in range(rng.choice([1, 4, 12]))]
    hot = prose(150)
    docs += [_edited(rng, hot, 2) for _ in range(60)] + [hot.upper()] * 20
    chain = prose(100)
    for _ in range(12):  # neighbours are near, the ends are not
        docs.append(chain)
        chain = _edited(rng, chain, 2)
    line = prose(12)
    docs += [prose(40) + (" " + line) * 30 for _ in range(4)]
    docs = list(enumerate(docs))
    rng.shuffle(docs)
    want = brute.near_groups(docs)
    extra = [(1000, None), (1001, ""), (1002, "?"), (1003, "?")]
    df = spark.createDataFrame(docs + extra, DOCS).withColumn("kept", F.lit("clash")).withColumn("cls", F.lit(1)).repartition(5)
    got = {r.doc_id: r.group_id for r in M.near_duplicates(df).collect()}
    assert got == {**want, **{i: i for i, _ in extra}}
    kept = M.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({*want.values(), *(i for i, _ in extra)})


def test_documents_repeated_null_and_empty(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(4, text), (4, text), (2, text + "!"), (None, text), (None, text), (9, "other words of its own here")], DOCS)
    got = sorted((str(r.doc_id), r.group_id, r.kept) for r in M.near_duplicates(df).collect())
    assert got == [("2", 2, True), ("4", 2, False), ("4", 2, False), ("9", 9, True), ("None", 2, False), ("None", 2, False)]
    assert sorted(str(r.doc_id) for r in M.keep_one_of_each(df).collect()) == ["2", "9"]
    same = spark.createDataFrame([(4, text)] * 3 + [(None, "x y")] * 2, DOCS)
    assert sorted(str(r.doc_id) for r in M.keep_one_of_each(same).collect()) == ["4", "None"]
    assert M.near_duplicates(df.limit(0)).count() == 0 and M.keep_one_of_each(df.limit(0)).count() == 0


def test_broadcasts_follow_measured_bytes(spark):
    from wattlane.llm.common import broadcast_measured, row_width
    wide = spark.range(40).select("id", F.expr("transform(sequence(1, 4096), x -> cast(x as double))").alias("v"))
    nested = spark.range(40).select("id", F.expr("transform(sequence(1, 50), x -> struct(x as a, repeat('y', 100) as t))").alias("v"))
    assert wide.agg(F.max(row_width(wide))).first()[0] == 16 + 8 + 4096 * 8 + 16
    assert nested.agg(F.min(row_width(nested))).first()[0] >= 50 * 100
    hinted = lambda df, limit: "ResolvedHint" in broadcast_measured(df, limit)._jdf.queryExecution().analyzed().toString()
    for df in (wide, nested):
        assert not hinted(df, 100_000) and hinted(df, 10_000_000)
    nulls = spark.createDataFrame([(None, None, None)], "a string, b array<string>, c array<struct<x: string>>")
    assert nulls.agg(F.sum(row_width(nulls))).first()[0] == 16 * 4


def test_representative_of_very_many_copies(spark):
    """Blocks of a representative's members, each with its shingles once, give the links of the plain join."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    docs = [(0, " ".join(base))]
    for i in range(1, 90):
        words = list(base)
        words[rng.randrange(120)] = f"new{i}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, DOCS)
    got = {r.doc_id: r.group_id for r in M.near_duplicates(df, block=8).collect()}
    assert got == brute.near_groups(docs)
