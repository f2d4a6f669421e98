"""Ward rounds, silhouette and K-means against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattlane.operators.numbering import global_index
from wattlane.operators.silhouette import EUCLIDEAN, SCORE, euclidean_silhouette, silhouette_samples, silhouette_score
from wattlane.operators.components import components
from wattlane.operators.ward import chain_merges, kmeans_labels, spanning_forest, ward


def _blobs(spark, n=90, seed=4):
    rng = np.random.default_rng(seed)
    centers = np.array([[0, 0, 0], [6, 6, 0], [0, 6, 6]])
    rows = [(i, *map(float, centers[i % 3] + rng.normal(size=3))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double"), rows


def _greedy(x, w):
    """The cheapest pair merged one at a time: (left, right, height, size), and the leaf sets at each count."""
    at = {i: (i, x[i].astype(float), float(w[i]), [i]) for i in range(len(x))}
    merges, cuts = [], {len(x): [[i] for i in range(len(x))]}
    while len(at) > 1:
        _, a, b, d = min(((2 * at[a][2] * at[b][2] / (at[a][2] + at[b][2]) * ((at[a][1] - at[b][1]) ** 2).sum(), a, b, 0)
                          for a in at for b in at if a < b))
        na, ca, wa, la = at.pop(a)
        nb, cb, wb, lb = at.pop(b)
        d = np.sqrt(2 * wa * wb / (wa + wb) * ((ca - cb) ** 2).sum())
        node = len(x) + len(merges)
        merges.append((min(na, nb), max(na, nb), d, wa + wb))
        at[a] = (node, (wa * ca + wb * cb) / (wa + wb), wa + wb, la + lb)
        cuts[len(at)] = [c[3] for c in at.values()]
    return merges, cuts


@pytest.mark.parametrize("parts,pairs", [("1", 2000), ("8", 4)])
def test_ward_equals_greedy_merging(spark, parts, pairs):
    """With equal vectors, any partitioning, and cells so small that the radius has to grow."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 4)).round(3)
    pick = rng.integers(0, 30, 50)
    rows = [(i, *map(float, base[j])) for i, j in enumerate(pick)] + [(99, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    leaves, weight = np.unique(base[pick], axis=0, return_counts=True)
    merges, cuts = _greedy(leaves, weight)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        res = ward(df, list("abcd"), [2, 5], keys=["id"], pairs_per_cluster=pairs)
        got = res.merges.orderBy("merge_id").collect()
        labels = {k: {r.id: r.cluster for r in res.labels[k].collect()} for k in (2, 5)}
        top = res.top_merges(3).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert [(r.left_node, r.right_node, r.size) for r in got] == [(a, b, n) for a, b, _, n in merges]
    np.testing.assert_allclose([r.height for r in got], [h for _, _, h, _ in merges])
    assert [r.merge_id for r in top] == [len(merges) - 1, len(merges) - 2]
    leaf = {tuple(v): i for i, v in enumerate(leaves.tolist())}
    for k in (2, 5):
        parts_k = sorted((-sum(weight[i] for i in p), min(p), p) for p in cuts[k])
        number = {i: n for n, (_, _, p) in enumerate(parts_k) for i in p}
        assert labels[k] == {r[0]: number[leaf[tuple(r[1:])]] for r in rows[:-1]}


def _points(seed, n=60, d=6):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(size=(n // 2, d)), rng.normal(size=(n - n // 2, d)) * 0.01 + 3])


@pytest.mark.parametrize("radius", [0.02, 1.0, 2.5, np.inf])
def test_chain_merges_are_the_greedy_ones_up_to_the_radius(radius):
    """Merges up to a radius first, the rest later: the same tree as greedy merging."""
    x = _points(3)
    w = np.random.default_rng(3).integers(1, 5, len(x)).astype(float)
    greedy, _ = _greedy(x, w)
    a, b = x.copy(), w.copy()
    first = chain_merges(a, b, radius)
    assert max((c for _, _, c, _ in first), default=0) <= radius
    left = np.setdiff1d(np.arange(len(x)), [j for _, j, _, _ in first])
    rest = chain_merges(a[left], b[left], np.inf)
    got = sorted((round(c, 9), s) for _, _, c, s in first + rest)
    assert got == sorted((round(h, 9), s) for _, _, h, s in greedy)


def test_forest_keeps_components_at_every_radius():
    x, w = _points(4), np.ones(60)
    home = np.arange(60) % 3 > 0
    cost = np.array([[np.sqrt(((p - q) ** 2).sum()) for q in x] for p in x])
    edges = spanning_forest(x, w, home, None, 3.0)
    for r in (0.01, 0.05, 1.0, 2.0, 3.0):
        def label(links):
            at = list(range(60))
            for i, j in links:
                a, b = at[i], at[j]
                at = [min(a, b) if v in (a, b) else v for v in at]
            return at
        assert label([(i, j) for i, j, c in edges if c <= r]) == label(
            [(i, j) for i in range(60) for j in range(i) if cost[i, j] <= r and (home[i] or home[j])])


def test_ward_in_rounds_equals_one_task(spark):
    """More clusters than a task takes: components, large ones taken apart, blocks of a cell."""
    rows = [(i, *map(float, v)) for i, v in enumerate(_points(5, 70))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double, f double")
    got = []
    for limits in ({}, {"task_clusters": 30, "pairs_per_cluster": 40, "block": 16}):
        res = ward(df, list("abcdef"), [3], keys=["id"], **limits)
        got.append(([(r.left_node, r.right_node, r.size, round(r.height, 9)) for r in res.merges.orderBy("merge_id").collect()],
                    sorted(map(tuple, res.labels[3].collect()))))
    assert got[0] == got[1] and len(got[0][0]) == 69


def test_components_of_a_star(spark):
    """A node with nearly all edges, a path and a loop."""
    star = spark.range(1, 20_001).selectExpr("id as a", "0L as b").union(spark.createDataFrame(
        [(30_000 + i, 30_001 + i) for i in range(40)] + [(7, 7), (25_000, 20_000)], "a long, b long"))
    got = components(star)
    assert got.groupBy("component").count().orderBy("component").collect() == [(0, 20_002), (30_000, 41)]
    assert components(star.limit(0)).count() == 0


def test_ward_of_few_rows(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id long, a double")
    res = ward(df, ["a"], [3], keys=["id"])
    assert res.leaves == 1 and res.merges.count() == 0
    assert [r.cluster for r in res.labels[3].collect()] == [0, 0]


def test_global_index(spark):
    df = spark.range(500).withColumn("v", F.col("id") % 7)
    got = global_index(df.repartition(5), ["v"], out="no").orderBy("no").collect()
    assert [r.no for r in got] == list(range(500)) and [r.v for r in got] == sorted(r.v for r in got)


def _silhouette(x, y, power=1.0):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1) ** power
    out = []
    for i in range(len(x)):
        own = y == y[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, y == c].mean() for c in set(y.tolist()) if c != y[i])
        out.append((b - a) / max(a, b))
    return out


@pytest.mark.parametrize("pack", [1_000_000, 9])
def test_silhouette_matches_brute_force(spark, pack):
    df, rows = _blobs(spark, n=61, seed=9)
    lab = df.withColumn("label", F.when(F.col("id") == 60, 77).otherwise((F.col("id") % 4).cast("int")))
    y = np.array([77 if r[0] == 60 else r[0] % 4 for r in rows])
    got = {r.id: r[SCORE] for r in silhouette_samples(lab, ["a", "b", "c"], "label", pack_doubles=pack).collect()}
    want = _silhouette(np.array([r[1:] for r in rows]), y)
    np.testing.assert_allclose([got[i] for i in range(61)], want, atol=1e-9)
    one = silhouette_score(lab, ["a", "b", "c"], "label").first()
    assert one.n == 61 and abs(one[SCORE] - np.mean(want)) < 1e-9


@pytest.mark.parametrize("block,stripe", [(512, 8), (7, 2)])
def test_euclidean_silhouette_matches_brute_force(spark, block, stripe):
    """Two labellings at once, one with a singleton, missing labels and repeated rows."""
    df, rows = _blobs(spark, n=61, seed=9)
    rows = rows + [(100 + i, *rows[5][1:]) for i in range(6)]
    df = spark.createDataFrame(rows, df.schema).withColumn("u", F.when(F.col("id") == 60, 77).otherwise(F.when(F.col("id") != 7, (F.col("id") % 4).cast("int"))))
    df = df.withColumn("v", F.concat(F.lit("c"), (F.col("id") % 3).cast("string"))).withColumn("one", F.lit(1)).repartition(4)
    got = {r.labelling: r for r in euclidean_silhouette(df, ["a", "b", "c"], ["u", "v", "one"], block, stripe).collect()}
    x = np.array([r[1:] for r in rows])
    u = np.array([77 if r[0] == 60 else r[0] % 4 for r in rows])
    keep = np.array([r[0] != 7 for r in rows])
    for name, y, k in (("u", u, keep), ("v", np.array([r[0] % 3 for r in rows]), np.ones(len(rows), bool))):
        want = _silhouette(x[k], y[k], 0.5)
        assert got[name].n == k.sum() and abs(got[name][EUCLIDEAN] - np.mean(want)) < 1e-9
    assert got["one"][EUCLIDEAN] is None


def test_silhouette_needs_one_length(spark):
    df = spark.createDataFrame([([1.0, 2.0], 0), ([1.0], 1)], "v array<double>, label int")
    with pytest.raises(ValueError, match="one length"):
        silhouette_score(df, "v", "label")


def test_kmeans_recovers_blobs(spark):
    df, _ = _blobs(spark, n=150)
    got = {r.id: r.cluster for r in kmeans_labels(df, ["a", "b", "c"], ["id"], k=3).collect()}
    share = [max(np.bincount([got[i] for i in got if i % 3 == b], minlength=3)) / 50 for b in range(3)]
    assert min(share) > 0.95 and len(set(got.values())) == 3


def test_distance_sums_grow_with_the_rows(spark):
    """However many blocks the rows are cut into: a sum per row and cluster for each part of the stripes, and no shuffle of tiles."""
    from wattlane.operators.silhouette import _cluster_sums, _vec
    from wattlane.operators.tiles import packed, product
    df, _ = _blobs(spark, n=240, seed=9)
    d = df.select(F.col("id").alias("rid"), _vec(["a", "b", "c"]).alias("x"), F.array((F.col("id") % 3).cast("string")).alias("labels"))
    for block, stripe in ((240, 1), (4, 2)):
        stripes = packed(d, "rid", block * stripe, "test-stripes")
        parts = _cluster_sums(d, block, stripe)
        assert parts.count() <= 240 * 3 * stripes.rdd.getNumPartitions()
        assert parts.agg(F.sum("n")).first()[0] == 240 * 240
        plan = product(stripes, stripes)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan


def test_distance_sums_of_very_many_clusters(spark, monkeypatch):
    """More clusters than a task keeps sums for, and too many for a matrix product."""
    from wattlane.operators import silhouette as S
    df, rows = _blobs(spark, n=61, seed=9)
    x, y = np.array([r[1:] for r in rows]), np.array([r[0] // 2 for r in rows])
    lab = df.withColumn("u", F.floor(F.col("id") / 2).cast("int"))
    monkeypatch.setattr(S, "KEPT_SUMS", 5)
    monkeypatch.setattr(S, "FEW", 3)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for t in S._sums(iter([(0, *[_table(x, y)] * 2), (0, *[_table(x, y)] * 2), (1, *[_table(x[:9], y[:9])] * 2)])):
        for r in t.to_pylist():
            assert r["own"] == (y[r["rid"]] == int(r["cluster"]))
    got = euclidean_silhouette(lab, ["a", "b", "c"], ["u"], 16, 2).first()
    assert abs(got[EUCLIDEAN] - np.mean(_silhouette(x, y, 0.5))) < 1e-9
    assert np.allclose(S._sums_to(d, y, 31), np.stack([d[:, y == c].sum(1) for c in range(31)], axis=1))


def _table(x, y):
    import pyarrow as pa
    return pa.table({"rid": pa.array(range(len(x)), pa.int64()), "x": pa.array(x.tolist(), pa.list_(pa.float64())),
                     "labels": pa.array([[str(v)] for v in y], pa.list_(pa.string()))})


def test_components_in_rounds_equal_those_in_a_task(spark):
    star = spark.range(1, 3_001).selectExpr("id as a", "0L as b").union(spark.createDataFrame(
        [(30_000 + i, 30_001 + i) for i in range(40)] + [(7, 7), (25_000, 2_000)], "a long, b long"))
    for edges in (star, star.select(F.unhex(F.md5(F.col("a").cast("string"))).alias("a"), F.unhex(F.md5(F.col("b").cast("string"))).alias("b"))):
        got = [sorted(map(tuple, components(edges, task_edges=most).collect())) for most in (0, 500, 500_000)]
        assert got[0] == got[1] == got[2] and len(got[0]) == 3_043


def test_ward_of_wide_vectors_looks_at_tiles(spark, monkeypatch):
    """Where cells select nothing no cells are formed; the tree is that of one task."""
    import wattlane.operators.ward as W
    rng = np.random.default_rng(8)
    x = rng.normal(size=(260, 24))
    x[200:] = x[:60] + rng.normal(size=(60, 24)) * 0.01
    rows = [(i, *map(float, v)) for i, v in enumerate(x / np.linalg.norm(x, axis=1)[:, None])]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"e{i} double" for i in range(24)))
    monkeypatch.setattr(W, "_forests", lambda *a: pytest.fail("cells"))
    got = []
    for limits in ({}, {"task_clusters": 60, "pairs_per_cluster": 20, "block": 16}):
        res = ward(df, [f"e{i}" for i in range(24)], [4], keys=["id"], **limits)
        got.append(([(r.left_node, r.right_node, r.size, round(r.height, 9)) for r in res.merges.orderBy("merge_id").collect()],
                    sorted(map(tuple, res.labels[4].collect()))))
    assert got[0] == got[1] and len(got[0][0]) == 259


@pytest.mark.parametrize("most", [3, 10, 1000])
def test_tasks_of_a_round_hold_all_merges_up_to_their_radius(most):
    """Components split at the radius, those too large taken apart, or mutual neighbours."""
    from wattlane.operators.ward import CERTAIN, assigned_in_task
    x = _points(7)
    cost = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    i, j = np.nonzero(np.triu(cost <= 2.0, 1))
    found = assigned_in_task(i, j, cost[i, j], 2.0, most)
    assert found and len({r for r, _, _ in found}) == len(found)
    comp = {r: (c, radius) for r, c, radius in found}
    for c in {c for _, c, _ in found}:
        own = [r for r in comp if comp[r][0] == c]
        radius = comp[own[0]][1]
        assert len(own) <= max(most, 2) and all(comp[r][1] == radius for r in own)
        others = np.setdiff1d(np.arange(60), own)
        if np.isinf(radius):
            a, b = own
            assert cost[a, b] <= min(cost[a, others].min(), cost[b, others].min())
        else:
            assert radius <= 2.0 * CERTAIN and cost[np.ix_(own, others)].min(initial=np.inf) > radius


def test_close_pairs_are_many_or_few():
    """A forest of a dense tile holds the components of its pairs."""
    import pyarrow as pa
    from wattlane.operators.components import connected
    from wattlane.operators.ward import _close_of
    x = _points(6, 80)
    t = pa.table({"rep": pa.array(range(80), pa.int64()), "w": np.ones(80), "x": pa.array(x.tolist(), pa.list_(pa.float64()))})
    cost = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for radius in (0.02, 1.5, 9.0):
        e = pa.concat_tables(_close_of(radius)(iter([(0, t, t)])))
        i, j = np.nonzero(np.triu(cost <= radius, 1))
        assert (connected(80, e.column("a").to_numpy(), e.column("b").to_numpy()) == connected(80, i, j)).all()
        assert len(e) == len(i) or len(i) > 4 * 160 and len(e) <= 79


def _costs(x, w):
    return np.sqrt(2 * w[:, None] * w / (w[:, None] + w) * ((x[:, None] - x[None]) ** 2).sum(-1))


@pytest.mark.parametrize("most", [2, 7, 1000])
@pytest.mark.parametrize("share", [0.01, 0.1, 0.6, 1.0])
def test_joined_clusters_are_merges_of_the_tree(share, most):
    """Turns of merges of the pairs up to a radius, without the vectors; nearly all that cost no more where components may be large."""
    from wattlane.operators.ward import joined_in_task
    for seed in range(4):
        x = np.random.default_rng(seed).normal(size=(90, 5 + 8 * seed))
        x[70:] = x[:20] + np.random.default_rng(seed + 9).normal(size=(20, x.shape[1])) * 0.02
        w = np.random.default_rng(seed).integers(1, 1 + 3 * (seed % 2), 90, endpoint=True).astype(float)
        members, tree = {i: frozenset([i]) for i in range(90)}, {}
        for a, b, c, _ in chain_merges(x.copy(), w.copy(), np.inf):
            members[a] = members[a] | members[b]
            tree[members[a]] = c
        cost = _costs(x, w)
        radius = float(np.quantile(cost[np.triu_indices(90, 1)], share))
        i, j = np.nonzero(np.triu(cost <= radius, 1))
        order = np.random.default_rng(1).permutation(len(i))
        a, b = np.where(order % 2, i[order], j[order]), np.where(order % 2, j[order], i[order])
        rep, comp, turn, into = joined_in_task(a * 3, b * 3, cost[a, b], w[a], w[b], radius, most)
        rep, comp, into = rep // 3, comp // 3, into // 3
        got = {k: frozenset([k]) for k in rep.tolist()}
        made = []
        for t in range(turn.max() + 1):
            now = np.r_[rep[turn == t], into[turn == t]]
            assert len(now) == len(set(now.tolist())) > 0
            for k, at in zip(rep[turn == t].tolist(), into[turn == t].tolist()):
                got[at] = got[at] | got[k]
                made.append(got[at])
        assert all(c in tree and tree[c] <= radius and len(c) <= most for c in made)
        for c in set(comp.tolist()):
            assert got[c] == frozenset(rep[comp == c].tolist()) and min(got[c]) == c and turn[rep == c] == -1
        if most == 1000:
            assert len(made) >= 0.9 * sum(v <= radius for v in tree.values())


def test_no_near_pair_is_missed():
    """Vectors far from their middle, very near ones and other weights: single and double precision."""
    import pyarrow as pa
    from wattlane.operators.ward import _close_of
    rng = np.random.default_rng(6)
    for spread, far, kinds in ((1.0, 0.0, 1), (1e-9, 1.0, 1), (1e3, 1e6, 50), (1e-160, 0.0, 3)):
        x = rng.normal(size=(700, 12)) * spread + far * (np.arange(700) % 3)[:, None]
        w = rng.integers(1, kinds, 700, endpoint=True).astype(float)
        t = pa.table({"rep": pa.array(rng.permutation(700), pa.int64()), "w": w, "x": pa.array(x.tolist(), pa.list_(pa.float64()))})
        rep = t.column("rep").to_numpy()
        cost = _costs(x, w)
        for share in (0.001, 0.05):
            radius = float(np.quantile(cost[np.triu_indices(700, 1)], share))
            e = pa.concat_tables(_close_of(radius, complete=True)(iter([(0, t.slice(0, 300), t.slice(300)), (0, t.slice(0, 300), t.slice(0, 300)), (1, t.slice(300), t.slice(300))])))
            got = {(min(a, b), max(a, b)): c for a, b, c in zip(*(e.column(k).to_pylist() for k in ("a", "b", "cost")))}
            i, j = np.nonzero(np.triu(cost <= radius, 1))
            want = {(min(rep[a], rep[b]), max(rep[a], rep[b])): cost[a, b] for a, b in zip(i, j)}
            surely = {k for k, c in want.items() if c < radius * (1 - 1e-9)}
            assert surely <= set(got) and len(e) == len(got)
            np.testing.assert_allclose([got[k] for k in surely], [want[k] for k in surely], rtol=1e-6)
            weight = dict(zip(rep.tolist(), w.tolist()))
            assert all(weight[a] == v for k in "ab" for a, v in zip(e.column(k).to_pylist(), e.column("w" + k).to_pylist()))


def test_a_pair_of_packs_meets_once(spark):
    from wattlane.operators.tiles import over_tiles, packed, product
    import pyarrow as pa

    def met(tiles):
        for _, home, visiting in tiles:
            a, b = (t.column("id").to_numpy() for t in (home, visiting))
            yield pa.table({"a": np.repeat(a, len(b)), "b": np.tile(b, len(a))})

    packs = packed(spark.range(50), "id", 8, "test-packs")
    assert "CartesianProduct" in product(packs, packs, once=True)._jdf.queryExecution().executedPlan().toString()
    pairs = [tuple(r) for r in over_tiles(packs, packs, met, "a long, b long", "test-met", once=True).collect()]
    assert {(min(p), max(p)) for p in pairs} == {(i, j) for i in range(50) for j in range(i, 50)}
    assert sum((b, a) in set(pairs) for a, b in pairs if a != b) == sum(len(r) * (len(r) - 1) for r in _packs(packs))


def _packs(packs):
    import pyarrow as pa
    return [pa.ipc.open_stream(r.rows).read_all() for r in packs.collect()]


@pytest.mark.parametrize("edges,task", [(1_500_000, 20), (400, 60), (10, 200)])
def test_ward_of_wide_vectors_takes_few_rounds(spark, monkeypatch, edges, task):
    """All pairs are looked at a few times, not once for each layer of the tree; fewer pairs at a time and components give the same tree."""
    import wattlane.operators.ward as W
    rng = np.random.default_rng(12)
    x = rng.normal(size=(420, 24))
    x[380:] = x[0] + rng.normal(size=(40, 24)) * 0.01          # a group of near copies
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, " + ", ".join(f"e{i} double" for i in range(24)))
    rounds, packed_ = [], W.packed
    monkeypatch.setattr(W, "packed", lambda *a: rounds.append(1) or packed_(*a))
    if edges != 1_500_000:
        monkeypatch.setattr(W, "JOINED_EDGES", edges)
    res = ward(df, [f"e{i}" for i in range(24)], [5], keys=["id"], pairs_per_cluster=20, task_clusters=task, block=16)
    got = res.merges.orderBy("merge_id").collect()
    order = np.lexsort(x.T[::-1])
    members, tree = {i: [i] for i in range(420)}, {}
    for a, b, c, n in chain_merges(x[order].copy(), np.ones(420), np.inf):
        members[a] = sorted(members[a] + members[b])
        tree[tuple(members[a])] = round(c, 9)
    nodes = {i: [i] for i in range(420)}
    for r in got:
        nodes[420 + r.merge_id] = sorted(nodes[r.left_node] + nodes[r.right_node])
        assert tree[tuple(nodes[420 + r.merge_id])] == round(r.height, 9) and len(nodes[420 + r.merge_id]) == r.size
    assert len(got) == 419
    if edges == 1_500_000:
        assert len(rounds) <= 4


def test_pairs_beyond_those_of_a_task_are_cut_by_cost(spark, monkeypatch):
    """What is left are all pairs up to the radius given with them; equal costs are not torn apart."""
    import wattlane.operators.ward as W
    monkeypatch.setattr(W, "JOINED_EDGES", 100)
    edges = spark.range(1000).selectExpr("id as a", "id + 1 as b", "1e0 + floor(id / 10) as cost").repartition(3)
    few, radius = W._least_edges(edges, 500.0)
    assert few.count() == edges.where(F.col("cost") <= radius).count() and 80 <= few.count() <= 130 and radius < 500.0
    assert few.agg(F.max("cost")).first()[0] < radius
    assert W._least_edges(edges.withColumn("cost", F.lit(1.0)), 500.0)[0] is None
    assert W._least_edges(edges.limit(50), 500.0)[1] == 500.0
