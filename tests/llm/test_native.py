"""Decontamination, sharding, URL rules and line dedup against brute force."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from wattlane.llm.decontaminate import drop_contaminated, find_contamination
from wattlane.llm.line_dedup import dedup_lines
from wattlane.llm.sharding import jump_shard, shard_rows, stable_key
from wattlane.llm.url_filter import filter_urls

from . import brute

DOCS = "doc_id long, text string"


def _prose(rng, n, vocab=40):
    return " ".join(rng.choice(["the", "Of", "été", "x1", "a-b", "Né"] + [f"w{i}" for i in range(vocab)]) for _ in range(n))


# ---------------------------------------------------------------------- op 1

def test_contamination_equals_brute_force(spark):
    rng = random.Random(3)
    items = [(i, _prose(rng, n)) for i, n in enumerate([40, 13, 14, 12, 5, 1, 0, 60])]
    items += [(100, items[0][1]), (None, items[1][1].upper()), (7, None), (8, "...")]
    docs = []
    for i in range(120):
        t = _prose(rng, rng.randrange(0, 80), 400)
        if i % 3 == 0:
            src = rng.choice([x for x in items if x[1]])[1].split(" ")
            a = rng.randrange(len(src))
            t = t[:len(t) // 2] + " ; " + "  ".join(src[a:a + rng.randrange(1, 40)]) + "! " + t[len(t) // 2:]
        docs.append((i, t))
    docs += [(200, None), (201, ""), (202, "?!"), (None, docs[0][1]), (203, items[0][1] * 200), (3, docs[3][1])]
    got = find_contamination(spark.createDataFrame(docs, DOCS).withColumn("n_hit", F.lit("clash")),
                             spark.createDataFrame(items, "item_id long, text string")).collect()
    want = sorted(((i, *brute.contamination(t, items)) for i, t in docs), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=str) == want
    assert any(w[2] for w in want) and any(not w[2] for w in want)
    for r in got:
        assert sum(b - a for a, b in r.spans) == r.n_hit


@pytest.mark.parametrize("k", [1, 13])
def test_contamination_any_gram_length(spark, k):
    rng = random.Random(4)
    items = [(0, _prose(rng, 30, 5))]
    docs = [(i, _prose(rng, 20, 5) + " " + " ".join(items[0][1].split(" ")[i:i + 13 + i])) for i in range(15)]
    got = find_contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), k=k)
    assert {r.doc_id: r.n_hit for r in got.collect()} == {i: brute.contamination(t, items)[1] for i, t in docs}


def test_contamination_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "a b c")], DOCS)
    assert find_contamination(docs, items).count() == 0
    assert [r.contaminated for r in find_contamination(full, items).collect()] == [False]
    assert drop_contaminated(full.withColumn("item_id", F.lit(1)), items).columns == ["doc_id", "text", "item_id"]


# ---------------------------------------------------------------------- op 2

@pytest.mark.parametrize("shards", [1, 2, 16, 17, 300])
def test_jump_is_the_published_one(spark, shards):
    df = spark.range(300).withColumn("key", stable_key(F.col("id")))
    key = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:16], 16)
    got = {r.id: r.s for r in df.select("id", jump_shard("key", shards).alias("s")).collect()}
    assert got == {i: brute.jump(key(i), shards) for i in range(300)}


def test_shards_are_numbered_without_gaps(spark):
    rows = [(i % 50, f"t{i % 70}é") for i in range(400)] + [(7, "hot")] * 300 + [(None, None), (None, None), (5, "")]
    df = spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit("clash")).repartition(5)
    got = shard_rows(df, 16).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
        assert r.grown_shard in (r.shard, 16)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
        order = [(r.doc_id is not None, r.doc_id, r.text_crc32, r.size) for r in sorted(part, key=lambda r: r.slot)]
        assert order == sorted(order, key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    assert shard_rows(spark.createDataFrame([], DOCS), 16).count() == 0


def test_growth_moves_its_share_only(spark):
    df = spark.range(20_000).select(stable_key(F.col("id")).alias("key"))
    a = df.select(jump_shard("key", 16).alias("a"), jump_shard("key", 17).alias("b"))
    moved = a.where("a <> b").count()
    assert abs(moved - 20_000 / 17) < 150 and a.where("a <> b and b <> 16").count() == 0


# ---------------------------------------------------------------------- op 4

def test_url_rules_equal_brute_force(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow"), ("a.b.org", "", "block"), ("example.com", "/de/sub/pre", "allow"),
             ("com", "/d", "block"), (None, "/", "block"), ("x", "/a", "allow"), ("x", "/a", "block")]
    urls = ["http://a.example.net/en/1", "http://example.net/de/1", "HTTP://EXAMPLE.NET/EN/1", "https://net", "https://net/",
            "http://notnet/", "http://x.net?q=/", "http://x.net#/", "http://www.example.com/de/sub/prefix", "http://www.example.com/de/sub/x",
            "http://example.com/d", "http://fr.org/fr/", "http://c.a.b.org", "http://a.b.org/fr/x", "no scheme", "", None, "://", ":///fr/",
            "http://x/abc", "http://u:p@net:80/", "http://a..net/", "http://.net/", "ftp://é.org/fr/é", "http://net//", "a://b://net/",
            "http://net/\n/x", "http://" + "a." * 3000 + "net/" + "b/" * 3000, "http://example.com/de/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls + urls[:5])], "page_id long, url string").withColumn(
        "url_rule", F.lit("clash")).withColumn("host", F.lit("other"))
    got = filter_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    for r in got:
        assert (r.url_host, r.url_path, r.url_rule, r.url_verdict) == brute.url_verdict(r.url, rules), r.url[:60]
        assert r.host == "other"
    assert len(got) == len(urls) + 5
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.url_verdict for r in filter_urls(df, none).collect()} == {"allow"}
    assert filter_urls(df.limit(0), none).count() == 0


# ---------------------------------------------------------------------- op 6

def test_lines_equal_brute_force(spark):
    rng = random.Random(6)
    docs = []
    for i in range(60):
        ls = [rng.choice(["", " ", "alpha", "beta ", "gamma", f"own {i}", "\tdelta\r", "eps"]) for _ in range(rng.randrange(0, 14))]
        docs.append((i, "\n".join(ls)))
    docs += [(100, None), (101, ""), (102, "\n\n\n"), (103, "same\n" * 9), (104, "a\nb"), (105, "x\n" * 3000), (None, "same\nsame\nsame")]
    want = brute.dedup_lines(docs)
    df = spark.createDataFrame(docs, DOCS).withColumn("n_lines", F.lit("clash")).repartition(4)
    got = dedup_lines(df).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in got} == want
    assert any(w[1] for w in want.values())
    # rows equal in id and text are treated alike; the second copy of a text under another id goes
    twice = spark.createDataFrame([(1, "p\nq\nr\ns"), (1, "p\nq\nr\ns"), (2, "p\nq\nr\nt")], DOCS)
    assert sorted((r.doc_id, r.text) for r in dedup_lines(twice).collect()) == [(1, "p\nq\nr\ns")] * 2 + [(2, "t")]
    assert dedup_lines(twice.limit(0)).count() == 0


def test_hot_url_expressions_beyond_the_broadcast_limit(spark):
    """Rules too many to broadcast: hot expressions are spread, the verdicts stay those of the brute force."""
    from wattlane.llm.url_filter import _salted
    urls = [f"http://h{i % 7}.example.com/{'de/' if i % 3 else ''}{i}" for i in range(300)] + [
        f"http://x{i}.net/en/{i}" for i in range(20)] + ["", None, "no url", "https://com", "http://a.b.c.example.com/de/x/y?q"]
    rules = [("com", "", "allow"), ("com", "/d", "block"), ("example.com", "/de/", "block"), ("h3.example.com", "/de/1", "allow"),
             ("net", "/", "block"), *((f"never{i}.org", "/x/", "block") for i in range(50)), (None, "/", "block")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("salt", F.lit("clash")).withColumn("n", F.lit(1))
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    for hot_rows in (1, 40, 100_000):
        got = filter_urls(df, listed, broadcast_bytes=0, hot_rows=hot_rows).collect()
        assert len(got) == len(urls) and all(r.salt == "clash" for r in got)
        for r in got:
            assert (r.url_host, r.url_path, r.url_rule, r.url_verdict) == brute.url_verdict(r.url, [x for x in rules if x[0]]), r.url
    many = spark.range(3000).select(F.concat(F.lit("u"), "id").alias("u"), F.lit("aa").alias("short"), F.lit("aabb").alias("digest"))
    spread, used = _salted(many, spark.createDataFrame([("aa", "aabb"), ("aa", "aacc")], "short string, rule_digest string"), 100)
    parts = [r["count"] for r in spread.groupBy("salt").count().collect()]
    assert len(parts) == 30 and max(parts) < 200 and used.count() == 30
    assert filter_urls(df.limit(0), listed, broadcast_bytes=0).count() == 0
