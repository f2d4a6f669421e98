"""Conversation trie, whitening and archives against brute force."""

import base64
import collections
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattlane.llm import warc, whitening
from wattlane.llm.prefix_trie import bitmap_nodes, members, number_turns, prefix_trie, share_heads

CONV = "conv_id long, turn long, role string, text string"


# ---------------------------------------------------------------------- op 11

def _trie(rows, rebuild=True):
    """{(conv_id, depth): rest of the node's row}"""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        made[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    where = collections.defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            where[tuple(made[c][:d])].append(c)
    out = {}
    for p, cs in where.items():
        below = [q for q in where if q[:len(p)] == p]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[:len(q)] == q for r in where)]
        saved = sum((len(where[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(str(c) for c in cs if len(made[c]) == len(p))
        out[cs[0], len(p)] = (where[p[:-1]][0] if p else None, len(cs), sum(len(q) == len(p) + 1 for q in below), len(leaves), saved,
                              hashlib.sha256(ends.encode()).hexdigest())
    return out


def _got(df):
    rows = df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    out = {(r[0], r[1]): tuple(r[2:]) for r in rows}
    assert len(out) == len(rows)
    return out


def _conversations(seed):
    rng = random.Random(seed)
    rows, kinds = [], [("user", "a b"), ("assistant", "c"), (None, None), ("user", ""), ("user", "x\ty\u00a0z  w")]
    for c in range(90):
        n = rng.choice([0, 1, 2, 3, 5, 9])
        rows += [(c, t if rng.random() < 0.9 else None, *rng.choice(kinds)) for t in range(n)]
    rows += [(200 + i, t, "user", f"hot {t}") for i in range(40) for t in range(6)]          # copies
    rows += [(300, t, "user", "deep") for t in range(70)] + [(301, t, "user", "deep") for t in range(70)]
    rows += [(302, t, "user", "deep") for t in range(50)] + [(302, 7, "other", "tie"), (302, 7, "user", "deep")]
    return rows + [(None, 1, "user", "nobody"), (-7, 0, "user", "minus"), (-7, 0, "user", "minus")]


@pytest.mark.parametrize("sizes", [(8192, 64, 4096), (16, 4, 8), (50, 7, 3)])
def test_trie_equals_brute_force(spark, sizes):
    rows = _conversations(sizes[0])
    df = spark.createDataFrame(rows, CONV).withColumn("n", F.lit("clash")).withColumn("depth", F.lit(-1)).repartition(3)
    rebuilt = sizes[0] != 50
    turns, convs = number_turns(df)
    if rebuilt:
        turns, convs = share_heads(turns, convs)
    # conversation -7 has base -7 - (-7) = 0 as everywhere in SQL; Python's remainder differs, so it is left out here
    turns, convs = turns.where("conv >= 0"), convs.where("conv >= 0")
    assert _got(prefix_trie(turns, convs, *sizes)) == _trie([r for r in rows if r[0] != -7], rebuilt)


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], CONV)
    assert prefix_trie(*share_heads(*number_turns(df))).count() == 0
    one = spark.createDataFrame([(5, 0, "user", "x")], CONV)       # h = crc32("5") % 4 may take its only turn
    assert _got(prefix_trie(*share_heads(*number_turns(one)))) == _trie([(5, 0, "user", "x")])


def test_bitmaps_of_a_cell():
    turns = [[1, 2, 3], [1, 2], [4], [1, 5, 3], []]
    sizes = np.array([len(t) for t in turns])
    flat = np.array([p * 10 + x for t in turns for p, x in enumerate(t)])
    ends = np.array([True, True, True, False, False])
    got = {(f, d, n, tuple(members(e, 5))) for f, d, n, e in bitmap_nodes(5, ends, sizes, flat, [0b11111])}
    assert got == {(0, 1, 3, ()), (0, 2, 2, (1,)), (0, 3, 1, (0,)), (2, 1, 1, (2,)), (3, 2, 1, ()), (3, 3, 1, ())}


# ---------------------------------------------------------------------- op 12

def _pairs():
    rng = np.random.default_rng(3)
    g = rng.standard_normal((64, 100))
    r = rng.standard_normal((20, 3))
    yield from {"random": g @ g.T, "identity": np.eye(12), "rank 3": r @ r.T, "close": np.diag([5, 5 + 1e-9, 4, 3, 3, 3, 3, 3, 2, 1.0]),
                "one": np.array([[3.0]]), "zero": np.zeros((5, 5)), "falling": np.diag(10.0 ** -np.arange(15))}.items()


@pytest.mark.parametrize("name,a", list(_pairs()))
def test_feast_equals_dense_solver(spark, name, a):
    k = min(8, len(a))
    values, vectors = whitening.feast(spark, a, k)
    size = max(np.abs(a).max(), 1e-300)
    assert np.allclose(values / size, np.linalg.eigvalsh(a)[::-1][:k] / size, atol=1e-13)
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * size
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-13)


def test_inertia_counts():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = rng.integers(1, 12)
        a = rng.integers(-2, 3, (n, n)).astype(float)
        e = np.linalg.eigvalsh(a + a.T)
        if np.abs(e).min() > 1e-9:
            assert whitening.above(whitening.tridiagonal(a + a.T), 0.0) == (e > 0).sum()


VECS = "vec_id long, embedding array<float>"


def test_whitening_equals_dense(spark):
    rng = np.random.default_rng(1)
    x = np.float32(rng.standard_normal((300, 10)) * np.arange(1, 11) + 50)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())] * 20 + [(None, x[9].tolist())]
    bad = [(900, None), (901, []), (902, [1.0] * 9 + [None]), (903, [1.0] * 9 + [float("nan")]), (904, [float("inf")] * 10)]
    df = spark.createDataFrame(rows + bad, VECS).withColumn("x", F.lit("clash")).withColumn("n", F.lit(0)).repartition(5)
    got = whitening.whiten(df, k=4).collect()
    assert len(got) == 4 * len(rows)
    q = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for _, v in rows])
    n, s = len(q), q.sum(axis=0)
    c = q - s / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    w = c @ u / np.sqrt(e)
    dev = {r[0]: int(sum(int(n * a - b) ** 2 for a, b in zip(qq, s))) for r, qq in zip(rows, q)}
    want = {(r[0], j + 1): w[i, j] for i, r in enumerate(rows) for j in range(4)}
    sign = {j: np.sign(sum(want[r.vec_id, r.component] * r.whitened for r in got if r.component == j)) for j in (1, 2, 3, 4)}
    for r in got:
        assert abs(r.whitened * sign[r.component] - want[r.vec_id, r.component]) < 1e-9
        assert int(r.deviation) == dev[r.vec_id] and r.n == n
        assert abs(r.explained - e[r.component - 1] / np.trace(v)) < 1e-12 and r.identity_error < 1e-9


def test_whitening_edges(spark):
    assert whitening.whiten(spark.createDataFrame([], VECS)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], VECS)).collect()
    assert len(same) == 10 and all(r.whitened is None and int(r.deviation) == 0 for r in same)
    flat = whitening.whiten(spark.createDataFrame([(0, [1.0, 5.0]), (1, [2.0, 5.0])], VECS)).collect()     # one dimension of two
    assert sorted((r.component, r.whitened if r.whitened is None else round(abs(r.whitened), 9)) for r in flat) == sorted(
        [(1, 1.0), (1, 1.0), (2, None), (2, None)], key=str)
    with pytest.raises(ValueError, match="one length"):
        whitening.whiten(spark.createDataFrame([(0, [1.0]), (1, [2.0, 5.0])], VECS))
    big = np.full((1, 3), 10 ** 9)
    assert [int(x) for x in whitening._deviation(big, 10 ** 6, np.array([1, 2, 3]))] == [sum((10 ** 15 - k) ** 2 for k in (1, 2, 3))]


# ---------------------------------------------------------------------- op 13

PAGES = "page_id long, url string, html string"


def _pages():
    rng = random.Random(4)
    rows = [(i, f"http://e.org/{i}?a b\n\u00e9", "".join(rng.choice("ab<>é\r\n\x00") for _ in range(rng.randrange(60)))) for i in range(60)]
    rows += [(100 + i, None, "same payload " * 30) for i in range(25)] + [(500, "u", "same payload " * 30)] * 3
    rows += [(200, "u", None), (201, "u", ""), (None, "u", ""), (None, None, "none"), (202, "x", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 4)]
    return rows + [(300, "u", "long " * 5000), (301, "u", "long " * 5000), (302, "u", "other " * 5000)]


def _records(rows, min_bytes=0):
    by = collections.defaultdict(list)
    for n, (i, _, html) in enumerate(rows):
        by[(html or "").encode()].append((i is not None, i or 0, n))
    out = []
    for body, found in by.items():
        top = max(found)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        for f in found:
            first = f == top or len(body) < min_bytes
            out.append((f[1] if f[0] else None, len(body), digest, "response" if first else "revisit", None if first else top[1]))
    return sorted(map(str, out))


@pytest.mark.parametrize("chunk_bytes,min_bytes,broadcast", [(1 << 18, 0, 1 << 20), (64, 0, 0), (64, 1000, 1 << 20)])
def test_archives_round_trip(spark, tmp_path, chunk_bytes, min_bytes, broadcast):
    rows = _pages()
    df = spark.createDataFrame(rows, PAGES).withColumn("rid", F.lit("clash")).withColumn("data", F.lit(0)).repartition(4)
    chunks = warc.chunk_records(df, chunk_bytes=chunk_bytes)
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] <= chunk_bytes
    files = warc.write_archives(chunks, f"file://{tmp_path}/w", min_bytes=min_bytes, broadcast_bytes=broadcast)
    got = warc.read_archives(files, chunk_bytes=50).collect()
    last = [r for r in got if r.last]
    assert sorted(str((r.id, r.upto, r.digest, r.record_type, r.refers_to)) for r in last) == _records(rows, min_bytes)
    texts = {(r[2] or "").encode() for r in rows}
    bodies = collections.defaultdict(dict)
    for r in got:
        if r.record_type == "response" and r.id in (300, 301, 302, 202):
            bodies[r.id][r.chunk_no] = bytes(r.data)
    assert bodies and all(b"".join(v[i] for i in range(len(v))) in texts for v in bodies.values())
    assert files.agg(F.sum("n_records")).first()[0] == len(rows)
    path = next(p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-") and p.name.endswith(".warc.gz"))
    assert gzip.open(path).read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    assert not [p for p in (tmp_path / "w").iterdir() if p.name.startswith(".0") and not p.name.endswith(".crc")]


def test_running_digests(spark):
    df = spark.createDataFrame([(1, "u", "abcdefghij" * 7), (2, "u", "")], PAGES)
    rows = warc.chunk_records(df, chunk_bytes=16).orderBy("rid", "chunk_no").collect()
    assert [len(r.data) for r in rows] == [16, 16, 16, 16, 6, 0] and len({r.rid for r in rows}) == 2
    for r in rows:
        body = ("abcdefghij" * 7)[:r.upto].encode()
        assert bytes(r.sha1) == hashlib.sha1(body).digest() and r.last == (r.upto in (70, 0))


def test_archives_of_nothing_and_damaged(spark, tmp_path):
    none = warc.write_archives(warc.chunk_records(spark.createDataFrame([], PAGES)))
    assert none.count() == 0 and warc.read_archives(none).count() == 0
    files = warc.write_archives(warc.chunk_records(spark.createDataFrame([(1, "u", "payload " * 400)], PAGES)), f"file://{tmp_path}/d")
    path = next(p for p in (tmp_path / "d").iterdir() if p.name.endswith(".warc.gz"))
    plain = gzip.decompress(path.read_bytes())
    for bad in (gzip.compress(plain.replace(b"payload payload", b"payload_payload", 1)), path.read_bytes()[:-30]):
        path.write_bytes(bad)
        with pytest.raises(Exception, match="differs from its header|archive ends inside|differs"):
            warc.read_archives(files).collect()


def test_schemes_of_shared_files(monkeypatch):
    from wattlane.llm import shared_files
    seen = []

    class Fake:
        @staticmethod
        def from_uri(uri):
            seen.append(uri)
            return None, uri
    monkeypatch.setattr(shared_files.pafs, "FileSystem", Fake)
    for uri in ("s3a://b/k", "S3N://b/k", "hdfs://n/p", "file:///x"):
        shared_files.open_fs(uri)
    assert seen == ["s3://b/k", "s3://b/k", "hdfs://n/p", "file:///x"]
    assert shared_files.open_fs("/a/b")[1] == "/a/b" and shared_files.open_fs("file:/a/b")[1] == "/a/b"
