"""Lexicon matching against plain edit distance, held-out accuracy, odd inputs."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from wattlane.llm.common import table
from wattlane.llm.toxicity import Lexicon, drop_toxic, score_toxicity

from . import brute

DOCS = "doc_id long, text string"
LABELS = "doc_id long, toxic int, quality int"


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(3, 9))) for _ in range(25)]
    terms = [(w, i % 3 == 0, (1.0, 1.0, 1.0)) for i, w in enumerate(sorted(set(words)))]
    lex = Lexicon(terms, {}, 0.0, fuzzy_len=4)
    for _ in range(4000):
        w = "".join(rng.choice("abcé") for _ in range(rng.randrange(0, 10)))
        found = [(0, i) for i, (t, stem, _) in enumerate(terms) if w == t or (stem and w.startswith(t))]
        found += [(1, i) for i, (t, stem, _) in enumerate(terms) if not stem and len(t) >= 4 and brute.levenshtein(w, t) == 1]
        assert lex.match(w) == min(found, default=None), w


def _rows(n=400):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(n):
        ws = [f"w{rng.randrange(300)}" for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                ws.insert(rng.randrange(len(ws)), rng.choice(["grumblor", "snarkpot"]))
        docs.append((i, " ".join(ws)))
        labels.append((i, int(toxic), 0))
    return docs, labels


def test_learned_terms_and_misspellings(spark):
    docs, labels = _rows()
    probes = [(1000, "you grumblor and snarkpot"), (1001, "he is a snarkpt and a grumbler"), (1002, "w1 w2 w3"), (1003, None), (1004, ""), (1005, "x " * 50_000)]
    df = spark.createDataFrame(docs + probes, DOCS).withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(1))
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5000, 1, 1), (6, None, 0), (12, 1, 0)], LABELS)
    got = {r.doc_id: r for r in score_toxicity(df, lab).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in held) for i in range(400))
    assert all(got[i].predicted == labels[i][1] for i in held)
    assert got[1000].predicted == 1 and got[1002].predicted == 0
    assert got[1000].score >= got[1001].score >= got[1002].score
    assert got[1003].score == got[1004].score == got[1002].score == got[1005].score
    assert all(0 <= r.score <= 1 for r in got.values())


def test_held_out_labels_are_not_read(spark):
    docs, labels = _rows(200)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t, q) for i, t, q in labels]
    df = spark.createDataFrame(docs, DOCS)
    a, b = ({r.doc_id: r.score for r in score_toxicity(df, spark.createDataFrame(x, LABELS)).collect()} for x in (labels, flipped))
    assert a == b


def test_without_labels_or_rows(spark):
    docs, _ = _rows(20)
    df, none = spark.createDataFrame(docs, DOCS).withColumn("extra", F.lit(1)), spark.createDataFrame([], LABELS)
    assert {(r.score, r.predicted) for r in score_toxicity(df, none).collect()} == {(0.0, 0)}
    assert score_toxicity(df.limit(0), none).count() == 0
    one_sided = spark.createDataFrame([(i, 0, 0) for i in range(20)], LABELS)
    assert {r.predicted for r in score_toxicity(df, one_sided).collect()} == {0}
    assert drop_toxic(df, none).columns == df.columns and drop_toxic(df, none).count() == 20


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")).where("held_out")
    rows = got.join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").select("toxic", "predicted").collect()
    tp = sum(r.toxic == r.predicted == 1 for r in rows)
    assert tp >= 0.9 * sum(r.toxic for r in rows) and tp >= 0.9 * sum(r.predicted for r in rows)


def _held_out(n, start=10_000):
    return [i for i in range(start, start + 10 * n) if zlib.crc32(str(i).encode()) % 4 == 2][:n]


def test_swaps_and_two_edits():
    def osa(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(12)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randrange(3, 12))) for _ in range(30)})
    lex = Lexicon([(w, False, ()) for w in words], {}, 0.0, 4, True, 8)
    for _ in range(4000):
        w = list(rng.choice(words))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w) + 1)
            w[i:i + rng.randrange(3)] = rng.choice([[], [rng.choice("abcé")], w[i:i + 2][::-1]])
        w = "".join(w)
        found = [(osa(w, t), i) for i, t in enumerate(words)]
        found = [(e, i) for e, i in found if e <= (0 if len(words[i]) < 4 else 1 if len(words[i]) < 8 else 2)]
        assert lex.match(w) == min(found, default=None), w


def test_misspelt_families_and_short_terms(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(600):
        ws = [f"w{rng.randrange(300)}" for _ in range(30)]
        if i % 6 == 0:
            for w in rng.sample(["idiot", "idiots", "idiotic"], rng.choice([2, 3])) if i % 12 == 0 else ["scum", "moron"]:
                ws.insert(rng.randrange(len(ws)), w)
        docs.append((i, " ".join(ws)))
        labels.append((i, int(i % 6 == 0), 0))
    wrong = ["iddiot idoits", "idoit idiotc", "scmu", "scumm", "morno", "mroon", "w1", "w2 w3"]
    ids = _held_out(len(wrong))
    probes = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(20)) + " " + w) for i, w in zip(ids, wrong)]
    got = {r.doc_id: r for r in score_toxicity(spark.createDataFrame(docs + probes, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert [got[i].predicted for i in ids] == [1] * 6 + [0] * 2
    assert all(got[i].held_out for i in ids)


def test_term_quoted_in_half_of_its_documents(spark):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(900):
        ws = [f"w{rng.randrange(300)}" for _ in range(30)]
        at = rng.randrange(6, 24)
        if i % 9 == 0:
            ws.insert(at, "vermish")
        elif i % 9 == 1:
            ws[at:at] = ["reported", '"you', 'vermish"', "yesterday"]
        docs.append((i, " ".join(ws)))
        labels.append((i, int(i % 9 == 0), 0))
    got = score_toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).where("held_out").collect()
    assert all(r.predicted == labels[r.doc_id][1] for r in got) and any(r.predicted for r in got)


def test_lexicon_has_no_largest_size(spark):
    rng = random.Random(10)
    vocabulary = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(5600)})
    dealt = vocabulary * 12
    rng.shuffle(dealt)
    toxic = [" ".join(dealt[a:a + 100]) for a in range(0, len(dealt), 100)]
    train = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = [(train[k], t) for k, t in enumerate(toxic)]
    docs += [(train[len(toxic) + k], f"7{k % 50} 8{k % 40}") for k in range(3 * len(toxic))]
    labels = [(i, int(k < len(toxic)), 0) for k, (i, _) in enumerate(docs)]
    probes = list(zip(_held_out(len(vocabulary) + 1), ["71 81", *(f"71 {w} 81" for w in vocabulary)]))
    got = {r.doc_id: r.score for r in score_toxicity(spark.createDataFrame(docs + probes, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    none, *scores = [got[i] for i, _ in probes]
    assert min(scores) > none


def test_parts_and_joins_give_the_same(spark):
    from wattlane.llm.common import text_key
    from wattlane.llm.toxicity import find_hits, hot_words, learn_terms

    docs, labels = _rows()
    toxic = {i: t for i, t, _ in labels}
    rows = [(i, t + (" grumblro a snarkpt" if i % 7 == 0 else ""), toxic[i]) for i, t in docs] + [(900, None, None), (901, docs[0][1], None)]
    df = spark.createDataFrame(rows, "id long, text string, toxic int").withColumn("key", text_key(F.coalesce("text", F.lit(""))))
    terms, counts, base = learn_terms(df)
    hot = hot_words(counts, terms, base)
    assert sorted(hot.collect()) == sorted(hot_words(counts, terms, base, part_terms=1).collect())
    a, b = ({r.id: r.hits for r in find_hits(df, hot, **kw).collect()} for kw in ({}, {"hot_bytes": 0}))
    assert a == b and len(a) == len(rows) and any(h.edits for x in a.values() for h in x)


def test_copies_do_not_fill_the_sample(spark):
    docs, labels = _rows()
    least = min((f"w1 w2 copy {k}" for k in range(3000)), key=lambda t: hashlib.md5(t.encode()).digest())
    copies = [(20_000 + k, least) for k in range(300)]
    df = spark.createDataFrame(docs + copies, DOCS)
    lab = spark.createDataFrame(labels + [(i, 0, 0) for i, _ in copies], LABELS)
    got = {r.doc_id: r for r in score_toxicity(df, lab, sample_rows=150).collect()}
    assert all(got[i].predicted == t for i, t, _ in labels if got[i].held_out)


def test_dealt_lexicon_equals_one_trie(spark):
    """Words and terms met by deletions find every match that one trie of all terms finds, and the same best one."""
    from wattlane.llm.toxicity import match_words
    rng = random.Random(21)
    word = lambda lo, hi: "".join(rng.choice("abcé") for _ in range(rng.randint(lo, hi)))
    terms = {(word(1, 14), False) for _ in range(150)} | {(word(3, 6), True) for _ in range(12)} | {("x" * 300, False), ("abcab", True), ("abcab", False)}

    def near(w):
        w = list(w)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w) + 1)
            kind = rng.randrange(4)
            if kind == 0:
                w.insert(i, rng.choice("abcé"))
            elif i < len(w) and kind == 1:
                del w[i]
            elif i < len(w) and kind == 2:
                w[i] = rng.choice("abcé")
            elif i + 1 < len(w):
                w[i], w[i + 1] = w[i + 1], w[i]
        return "".join(w)
    listed = sorted(terms)
    found = {near(rng.choice(listed)[0]) for _ in range(2500)} | {word(1, 15) for _ in range(500)} | {"x" * 301, "x" * 5000, "x" * 297}
    counts = spark.createDataFrame([(w, i % 3, i % 5) for i, w in enumerate(sorted(found - {""}))], "w string, t long, c long").repartition(3)
    lexicon = spark.createDataFrame(listed, "term string, stem boolean").repartition(2)
    for two_len in (8, 5):
        whole = sorted(map(tuple, match_words(counts, lexicon, two_len=two_len).collect()))
        dealt = sorted(map(tuple, match_words(counts, lexicon, two_len=two_len, part_terms=1).collect()))
        assert whole == dealt
        assert {m[3] for m in whole} == {0, 1, 2} and len(whole) > 1000
    few = match_words(counts.limit(0), lexicon, part_terms=1), match_words(counts, lexicon.where("term = 'abcab' and stem"), part_terms=0)
    assert few[0].count() == 0 and few[1].where("w like 'abcab%'").count() == few[1].count() > 0
