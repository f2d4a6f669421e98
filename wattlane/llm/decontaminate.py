"""Operator 1: benchmark decontamination by winnowing, in DataFrame expressions only.

A window is ``span`` (13) consecutive item words; an item of fewer words is one
window.  Winnowing: a text's k-gram hashes are reduced to the minimum of
every ``span - k + 1`` consecutive ones.  A shared window has the same k-grams
on both sides, hence the same minimum, so every shared window is found - no
position is sampled away.

1. The benchmark gives its windows (as word strings) and their fingerprints.
2. Every document gives its distinct fingerprints; a semi-join with the
   benchmark's distinct fingerprints keeps those that occur there.  A
   frequent fingerprint matches one row, so nothing multiplies.
3. Hits are extended: in the documents left, every position whose
   fingerprint was found gives its full window, joined on the words
   themselves with the benchmark's distinct windows; overlapping windows are
   merged into covered word positions.

Items shorter than ``span`` have one fingerprint, the hash of all their words;
documents are hashed for exactly the short lengths that occur (at most
``span - 1``).  Equal items are one class, so a benchmark full of copies does
not multiply rows either.  Everything is keyed by the text's digest: copies
of a document are hashed where they lie and merged before the shuffle.

Nulls and empty texts have no words and are never hit; items without words
have no windows; a null item id is listed as ``null``; an empty benchmark
leaves every document clean.  Repeated documents each get their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlane.llm.common import (broadcast_if_small, broadcast_measured, let, materialise, steps, text_key, text_or_empty,
                                 words)


def _slide(values: Column, width: int, fold) -> Column:
    """``fold`` over every ``width`` consecutive elements, by doubling; ``fold`` may see an element twice."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = let(values, _pairwise(step, fold))
        have += step
    return values


def _pairwise(step: int, fold):
    """The function that folds every element with the one ``step`` behind it."""
    def paired(v: Column) -> Column:
        n = F.greatest(F.size(v) - step, F.lit(0))
        return F.zip_with(F.slice(v, 1, n), F.slice(v, step + 1, n), fold)
    return paired


def _winnowed(hashes: Column, span: int, k: int) -> Column:
    """The fingerprint of every window: the least of its k-gram hashes."""
    grams = _slide(hashes, k, lambda a, b: F.xxhash64(a, b))
    return _slide(grams, span - k + 1, lambda a, b: F.least(a, b))


def _short(hashes: Column, n: int) -> Column:
    return F.transform(steps(1, F.size(hashes) - (n - 1)), lambda i: F.xxhash64(F.slice(hashes, i, n), F.lit(n)))


def _fingerprints(ws: Column, span: int, k: int, short: list[int]) -> Column:
    """Array of (len, pos, fp): the fingerprint of every window of the word array."""
    def placed(n: int, fps: Column) -> Column:
        return F.transform(fps, lambda fp, i: F.struct(F.lit(n).alias("len"), (i + 1).alias("pos"), fp.alias("fp")))

    def windows(h: Column) -> Column:
        parts = [placed(span, _winnowed(h, span, k)), *(placed(n, _short(h, n)) for n in short)]
        return F.concat(*parts) if len(parts) > 1 else parts[0]
    return let(F.transform(ws, lambda w: F.xxhash64(w)), windows)


def _distinct_fps(ws: Column, span: int, k: int, short: list[int]) -> Column:
    """The distinct fingerprints alone: the winnowed set of a text."""
    def fps(h: Column) -> Column:
        parts = [_winnowed(h, span, k), *(_short(h, n) for n in short)]
        return F.array_distinct(F.concat(*parts) if len(parts) > 1 else parts[0])
    return let(F.transform(ws, lambda w: F.xxhash64(w)), fps)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", span: int = 13, k: int = 7,
                       share: int = 20) -> DataFrame:
    """Per row of ``docs``: id, text_key, n_words, n_hit, spans, n_items, items_sha256, contaminated.

    ``spans``: the merged hit ranges (first word, word after the last), 0-based.
    ``contaminated``: n_hit > 0 and share * n_hit >= n_words.
    """
    if not 1 <= k <= span:
        raise ValueError("k must lie between 1 and span")
    # ---- benchmark: classes of equal items, windows, fingerprints
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
                             words(text_or_empty(item_text_col)).alias("ws")).where("size(ws) > 0")
    classes = materialise(items.groupBy("ws").agg(F.collect_set("item").alias("items"))
                          .withColumn("cls", text_key(F.array_join("ws", " "))), "bench-classes")
    short = [r[0] for r in classes.select(F.size("ws").alias("n")).where(F.col("n") < span).distinct().orderBy("n").collect()]
    # an item shorter than the span is one window: only its own length counts
    fp_array = _fingerprints(F.col("ws"), span, k, short)
    windows = classes.select("cls", "ws", F.explode(fp_array).alias("f")).where(
        (F.col("f.len") == span) | (F.col("f.len") == F.size("ws")))
    windows = materialise(windows.select("cls", F.col("f.fp").alias("fp"),
                                         F.array_join(F.slice("ws", F.col("f.pos"), F.col("f.len")), " ").alias("win"))
                          .distinct(), "bench-windows")
    fps = broadcast_if_small(materialise(windows.select("fp").distinct(), "bench-fps"), 32)
    distinct_windows = windows.groupBy("win").agg(F.collect_set("cls").alias("clss"))
    distinct_windows = broadcast_measured(materialise(distinct_windows, "bench-win"))

    # ---- documents: winnowed fingerprints joined with the benchmark's, in one pass over the texts.
    # The first row of a text stays whatever it hits and carries the number of words.
    text = text_or_empty(text_col)
    texts = docs.select(text.alias("t")).where("t <> ''").withColumn("key", text_key(F.col("t")))
    per_text = texts.select("key", F.inline(F.transform(F.array(words(F.col("t"))), lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"), _distinct_fps(ws, span, k, short).alias("fps")))))
    found = (per_text.select("key", "n_words", F.posexplode_outer("fps").alias("at", "fp"))
             .join(fps.withColumn("hit", F.col("fp")), "fp", "left").where("coalesce(at, 0) = 0 or hit is not null")
             .groupBy("key").agg(F.max("n_words").alias("n_words"), F.collect_set("hit").alias("found")))
    found = materialise(found, "doc-fps")
    counted = broadcast_if_small(found.select(F.col("key").alias("wkey"), "n_words"), 64)
    found = broadcast_measured(found.where("size(found) > 0").select("key", "found"))

    # ---- extend: full windows at the positions found
    cand = let(words(F.col("t")), lambda ws: let(
        F.filter(_fingerprints(ws, span, k, short), lambda f: F.array_contains(F.col("found"), f["fp"])),
        lambda fs: F.transform(fs, lambda f: F.struct(
            f["pos"].alias("pos"), f["len"].alias("len"),
            F.array_join(F.slice(ws, f["pos"], f["len"]), " ").alias("win")))))
    hits = (texts.join(found, "key").select("key", F.explode(cand).alias("c"))
            .select("key", "c.pos", "c.len", "c.win").join(distinct_windows, "win")
            .select("key", "pos", "len", "clss"))
    hits = materialise(hits.dropDuplicates(["key", "pos", "len"]), "doc-hits")

    merged = F.aggregate(  # ranges in order of their start: grow the last one or open another
        F.array_sort("ranges"), F.array().cast("array<struct<a:int,b:int>>"),
        lambda acc, r: F.when(
            (F.size(acc) > 0) & (r["a"] <= F.element_at(acc, -1)["b"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], r["b"]).alias("b")))))
        .otherwise(F.concat(acc, F.array(r))))
    spans = (hits.select("key", F.struct((F.col("pos") - 1).alias("a"), (F.col("pos") - 1 + F.col("len")).alias("b")).alias("r"))
             .groupBy("key").agg(F.collect_list("r").alias("ranges")).select("key", merged.alias("spans")))
    listed = (hits.select("key", F.explode("clss").alias("cls")).distinct()
              .join(classes.select("cls", "items"), "cls")
              .groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    result = spans.join(listed, "key").select(
        "key", "spans",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, r: n + (r["b"] - r["a"])).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("sha"))
    result = broadcast_measured(materialise(result, "doc-result"))

    base = docs.select(id_col, text_key(text).alias("key"))
    base = base.join(counted, F.col("key") == F.col("wkey"), "left").select(
        id_col, "key", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return base.join(result, "key", "left").select(
        id_col, F.col("key").alias("text_key"), "n_words", n_hit.alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>")).alias("spans"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` whose text is not contaminated, with all their columns."""
    bad = find_contamination(docs, benchmark, text_col=text_col, **kw).where("contaminated").select(
        F.col("text_key").alias("__bad")).distinct()
    bad = broadcast_if_small(materialise(bad, "contaminated"), 64)
    return docs.join(bad, text_key(text_or_empty(text_col)) == F.col("__bad"), "left_anti")
