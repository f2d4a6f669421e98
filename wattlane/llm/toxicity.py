"""Operator 8: toxicity by Levenshtein automata over a lexicon trie, with context-window scores.

*Lexicon.*  Learned from the labelled training rows, over all of them.  A word
is a term when the share of toxic rows among its documents, and among its
different surroundings (word before, word after), is raised above the base
rate by more than chance gives any word of the vocabulary; counting
surroundings keeps words that only copies of one document repeat out.  A term
may stand in clean documents too: its weight is its log-odds above the base
rate, and context tells quotation from abuse.  A stem is a prefix of which
toxic documents hold several different words at a time; its weight depends on
whether a text has one, two, and three or more of them.  The training words
under a stem are terms of its family, so their misspellings are found.

*Matching.*  The terms form a trie.  For a word of a text, its Levenshtein
automaton (bit-parallel: one bit mask of reached positions per number of
edits; an exchange of neighbours is one edit) runs down the trie; branches
whose states die out are left.  Word terms match exactly below four
characters, with one edit from four, with two from eight; stems exactly at the
start of a word.  Every distinct word of the corpus is matched once; a lexicon
too large for one trie meets the words by equal strings left after deletions, and
every batch of such pairs has a trie of its own.  The matches are a table, sent to
every task where it is small and joined by word where not.  What a misspelling is worth is
learned: a share of its family's weight, moved by what the other words near
that family are worth and by its own counts.

*Context.*  Every hit has a window of words around it and a flag whether it
stands between quotation marks.  Window words have log-odds learned from the
windows of toxic and of clean training documents, so that reporting words
lower and abusive ones raise a hit.

*Score.*  A logistic regression on six document features, fitted on a bounded
sample of training texts (``sample_rows`` distinct texts, the least by hash,
each with its number of rows as weight); all counts and statistics before it
cover all rows.

Only the text enters a score.  Null and empty texts have no words and get the
score of a text without hits; without any training row every score is 0.
Repeated rows are scored alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlane.llm.common import broadcast_if_small, broadcast_measured, let, materialise, row_width, small_batches, steps, text_key, text_or_empty, words
from wattlane.session import ship_package

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Quotation marks that open and close, as they stand in texts.
_QUOTES = re.compile("[\"“”„‟«»‹›]")
_END, _STEM = "", "*"  # keys of a trie node's word term and stem; neither is a word's character


class Lexicon:
    """Terms with weights and their tries; ``swaps``: two neighbours exchanged are one edit.

    Words match a word term of ``fuzzy_len`` characters with one edit, one of
    ``two_len`` (None: no term) with two, stems exactly at their start.
    """

    def __init__(self, terms: list[tuple[str, bool, tuple]], variants: dict[str, float], prior: float,
                 fuzzy_len: int = 5, swaps: bool = False, two_len: int | None = None):
        self.terms, self.variants, self.prior = terms, variants, prior
        self.fuzzy_len, self.swaps = fuzzy_len, swaps
        self.root: dict = {}
        self.long: dict = {}
        lengths = [0]
        for no, (term, stem, _) in enumerate(terms):
            far = not stem and two_len is not None and len(term) >= two_len
            node = self.long if far else self.root
            for c in term:
                node = node.setdefault(c, {})
            node[_STEM if stem else _END] = no
            lengths.append(len(term))
        self.least, self.most = (two_len or 0) - 2, max(lengths) + 3

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, number of the term) of the best match, None without any."""
        word = word[:self.most]  # what is longer is too far from every word term
        at: dict[str, int] = {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << i
        best = self._walk(self.root, at, len(word), 1)
        if self.long and len(word) >= self.least:
            far = self._walk(self.long, at, len(word), 2)
            best = far if best is None or (far is not None and far < best) else best
        return best

    def _walk(self, root: dict, at: dict[str, int], n: int, bound: int) -> tuple[int, int] | None:
        full, best, swaps = 1 << n, None, self.swaps
        mask = 2 * full - 1
        # positions reached with no, at most one, at most two edits; positions in the middle of an exchange
        stack = [(root, 1, 3 & mask, 7 & mask if bound > 1 else 0, 0, 0)]
        while stack:
            node, none, one, two, mid_one, mid_two = stack.pop()
            for c, child in node.items():
                if c == _END or c == _STEM:
                    if none & full or (c == _STEM and none):
                        found = (0, child)
                    elif c == _END and one & full and len(self.terms[child][0]) >= self.fuzzy_len:
                        found = (1, child)
                    elif c == _END and two & full:
                        found = (2, child)
                    else:
                        continue
                    best = found if best is None or found < best else best
                    continue
                m = at.get(c, 0)
                next_none = (none & m) << 1
                next_one = ((one & m) << 1) | none | (none << 1) | next_none | (next_none << 1)
                if swaps:
                    next_one |= (mid_one & m) << 2
                next_one &= mask
                next_two = 0
                if bound > 1:
                    next_two = ((two & m) << 1) | one | (one << 1) | next_one | (next_one << 1)
                    if swaps:
                        next_two |= (mid_two & m) << 2
                    next_two &= mask
                to_one = none & (m >> 1) if swaps else 0
                to_two = one & (m >> 1) if swaps and bound > 1 else 0
                if next_one or next_two or to_one or to_two:
                    stack.append((child, next_none, next_one, next_two, to_one, to_two))
        return best


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _evidence(t: int, c: int, base: float) -> float:
    """Log-odds above the base rate, smoothed towards it."""
    return _logit((t + 2 * base) / (t + c + 2)) - _logit(base)


def _raised(t: str, c: str, base: float, lift: float, tests: int) -> Column:
    """Is t of t + c at least ``lift`` times the base rate, and by more than chance in ``tests`` tries (Chernoff's bound)?"""
    t, c = F.col(t).cast("double"), F.col(c).cast("double")
    n = t + c
    far = F.when(t > 0, t * F.log(t / (n * base))).otherwise(0.0) + F.when(c > 0, c * F.log(c / (n * (1 - base)))).otherwise(0.0)
    return F.coalesce((t >= F.least(F.lit(lift * base), F.lit((1 + base) / 2)) * n) & (far >= math.log(max(tests, 2))), F.lit(False))


_TERM = "term string, stem boolean, family string, weights array<double>"


def _contexts(rows: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """Rows (w, contexts): in how many different surroundings a word stands."""
    around = let(words(F.col("text")), lambda w: F.transform(steps(1, F.size(w)), lambda i: F.struct(
        F.get(w, i - 1).alias("w"), F.xxhash64(F.get(w, i - 2), F.get(w, i)).alias("c"))))
    found = rows.select(F.explode(around).alias("x")).select("x.w", "x.c")
    found = found if keep is None else found.join(keep, "w", "left_semi")
    return found.distinct().groupBy("w").agg(F.count("*").alias("contexts"))


def learn_terms(rows: DataFrame, stems: tuple[int, ...] = (3, 4, 5, 6, 7, 8), min_docs: int = 3,
                lift: float = 2.0) -> tuple[DataFrame | None, DataFrame, float]:
    """Terms (term, stem, family, weights), the words of all rows with their counts, and the base rate.

    ``rows`` has (key, text, toxic), toxic null outside the training rows; without
    toxic or without clean rows there are no terms (None).  A stem has the
    weights of one, two and three or more different words with it in one
    document; its support is the number of different sets of such words, so
    copies count once.  The training words under a stem are terms of its
    family, for the misspellings of them.
    """
    train = rows.where("toxic is not null").select("key", "text", "toxic")
    n, bad = train.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    distinct = rows.select("key", "toxic", F.explode(F.array_distinct(words(F.col("text")))).alias("w"))
    counts = distinct.groupBy("w").agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"),
                                       F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0)).alias("c"))
    counts = materialise(counts, "tox-words")
    if not bad or bad == n:
        return None, counts, 0.5
    base = bad / n
    seen = counts.where("t + c > 0")
    tests = seen.count()
    often = materialise(seen.where((F.col("t") >= min_docs) & _raised("t", "c", base, lift, tests)), "tox-often")
    small = broadcast_measured(often)
    often = (often.join(_contexts(train.where("toxic = 1"), small.select("w")).withColumnRenamed("contexts", "ct"), "w", "left")
             .join(_contexts(train.where("toxic = 0"), small.where("c > 0").select("w")).withColumnRenamed("contexts", "cc"), "w", "left")
             .na.fill(0, ["ct", "cc"]))
    by_word = materialise(often.where((F.col("ct") >= min_docs) & _raised("ct", "cc", base, lift, tests)).select("w", "t", "c"), "tox-terms")

    # stems: prefixes that toxic documents have more often than their share
    forms = seen.select("w", "t", "c", F.explode(F.array(*[
        F.when(F.char_length("w") > k, F.substring("w", 1, k)) for k in stems])).alias("stem")).where("stem is not null")
    raised = (forms.groupBy("stem").agg(F.sum("t").alias("st"), F.sum("c").alias("sc"), F.sum((F.col("t") > 0).cast("int")).alias("n"))
              .where((F.col("st") >= lift * base * (F.col("st") + F.col("sc"))) & (F.col("n") >= min_docs)).select("stem"))
    pairs = materialise(forms.join(raised, "stem", "left_semi").select("w", "stem"), "tox-forms")
    per_doc = (distinct.where("toxic is not null").join(broadcast_measured(pairs), "w").groupBy("key", "stem")
               .agg(F.max("toxic").alias("toxic"), F.count("*").alias("n"), F.sum(F.xxhash64("w") % (1 << 40)).alias("set")))
    by_n = (per_doc.select("stem", "toxic", F.least("n", F.lit(3)).alias("n"), "set").distinct()
            .groupBy("stem").agg(*[F.sum(F.when(F.col("n") >= k, F.col("toxic")).otherwise(0)).alias(f"t{k}") for k in (1, 2, 3)],
                                 *[F.sum(F.when(F.col("n") >= k, 1 - F.col("toxic")).otherwise(0)).alias(f"c{k}") for k in (1, 2, 3)]))
    by_n = materialise(by_n, "tox-stems")
    few = by_n.count()
    good = F.lit(False)
    for k in (1, 2, 3):
        good = good | _raised(f"t{k}", f"c{k}", base, lift, few)
    enough = max(min_docs, math.ceil(math.log(max(few, 2)) / -math.log(base)))

    def pick(group: pa.Table) -> pa.Table:
        """The strongest of stems with the same start that are no starts of each other."""
        found = []
        for r in group.to_pylist():
            weights = [_evidence(r[f"t{k}"], r[f"c{k}"], base) for k in (1, 2, 3)]
            found.append((-sum(x * math.log1p(r[f"t{k}"]) for k, x in zip((1, 2, 3), weights)), r["stem"], weights))
        chosen: dict[str, list[float]] = {}
        starts: set[str] = set()
        for _, s, weights in sorted(found):
            mine = {s[:k] for k in range(1, len(s) + 1)}
            if s not in starts and not any(x in chosen for x in mine):
                chosen[s] = weights
                starts |= mine
        return pa.table({"stem": pa.array(list(chosen), pa.string()), "weights": pa.array(list(chosen.values()), pa.list_(pa.float64()))})

    picked = by_n.where(good & (F.col("t2") >= enough)).groupBy(F.substring("stem", 1, min(stems)).alias("start")).applyInArrow(
        pick, "stem string, weights array<double>")
    picked = materialise(picked, "tox-picked").withColumn("family", F.concat(F.lit(_STEM), "stem"))
    under = seen.where((F.col("t") > 0) & (F.col("t") >= lift * base * (F.col("t") + F.col("c")))).select("w", F.explode(F.array(*[
        F.when(F.char_length("w") >= k, F.substring("w", 1, k)) for k in stems])).alias("stem")).where("stem is not null")
    under = materialise(under.join(broadcast_measured(picked), "stem").select("w", "family", "weights"), "tox-under")
    weight = F.log((F.col("t") + 2 * base) / (F.col("c") + 2 * (1 - base))) - _logit(base)
    terms = (picked.select(F.col("stem").alias("term"), F.lit(True).alias("stem"), "family", "weights")
             .union(under.select(F.col("w").alias("term"), F.lit(False), "family", "weights"))
             .union(by_word.join(under, "w", "left_anti").select("w", F.lit(False), "w", F.array(weight, weight, weight))))
    return materialise(terms, "tox-lexicon"), counts, base


#: Characters of a word whose deletions are its keys: at most 56 keys a word for two edits, however long it is.
KEY_PREFIX = 10


def _deletions(word: Column, edits: int) -> Column:
    """The first KEY_PREFIX characters with up to ``edits`` of them left out.

    Two words at that distance (an exchange of neighbours is one edit) have one
    in common: leaving the edited positions out of both gives equal strings, and
    of their starts the longer one is cut to the shorter.
    """
    cut = lambda v: F.transform(steps(1, F.char_length(v)), lambda i: F.concat(
        F.substr(v, F.lit(1), i - 1), F.substr(v, i + 1, F.lit(KEY_PREFIX))))
    found = F.array(F.substring(word, 1, KEY_PREFIX))
    last = found
    for _ in range(edits):
        last = F.flatten(F.transform(last, cut))
        found = F.concat(found, last)
    return F.array_distinct(found)


def _key(kind: str, c: Column) -> Column:
    return F.xxhash64(F.lit(kind), c)


def candidates(counts: DataFrame, terms: DataFrame, fuzzy_len: int, two_len: int) -> DataFrame:
    """Rows (w, t, c, term, stem): every word with every term that it may match, and some that it does not."""
    w, term, nothing = F.col("w"), F.col("term"), F.array().cast("array<bigint>")
    size = F.char_length(term)
    deleted = lambda x, k: F.transform(_deletions(x, k), lambda v: _key(str(k), v))
    of_term = (F.when(F.col("stem"), F.array(_key("stem", term))).when(size < fuzzy_len, F.array(_key("0", term)))
               .when(size >= two_len, deleted(term, 2)).otherwise(deleted(term, 1)))
    dealt = broadcast_measured(materialise(terms.select("term", "stem", F.explode(of_term).alias("k")), "tox-term-keys"))
    # one row per length of a stem, a handful; and the longest term: longer words are near no term
    stems = sorted(r[0] for r in terms.where("stem").select(size).distinct().collect())
    longest = terms.where("not stem").agg(F.coalesce(F.max(size), F.lit(0))).first()[0]
    n = F.char_length(w)
    starts = F.filter(F.array(*[F.when(n >= k, _key("stem", F.substring(w, 1, k))) for k in stems]).cast("array<bigint>"), lambda k: k.isNotNull())
    of_word = F.concat(starts, F.when(n < fuzzy_len, F.array(_key("0", w))).otherwise(nothing),
                       F.when(n.between(fuzzy_len - 1, min(two_len, longest + 1)), deleted(w, 1)).otherwise(nothing),
                       F.when(n.between(two_len - 2, longest + 2), deleted(w, 2)).otherwise(nothing))
    return (counts.select("w", "t", "c", F.explode(of_word).alias("k")).join(dealt, "k")
            .select("w", "t", "c", "term", "stem").distinct())


def match_words(counts: DataFrame, terms: DataFrame, fuzzy_len: int = 4, two_len: int = 8, part_terms: int = 50_000) -> DataFrame:
    """Rows (w, t, c, edits, term, stem): every word with its best term.

    Up to ``part_terms`` terms are one trie, sent to every task.  More terms never
    pass the driver: words and terms meet by their shared deletions, and the terms that
    a batch of such pairs names are that batch's trie.  A word keeps the best of its matches.
    """
    match = "w string, t long, c long, edits int, term string, stem boolean"

    def matched(batch: pa.RecordBatch, lexicon: Lexicon, some: list[tuple]) -> pa.RecordBatch:
        found = [lexicon.match(w) for w in batch.column("w").to_pylist()]
        hit = [f for f in found if f is not None]
        batch = batch.select(["w", "t", "c"]).filter(pa.array([f is not None for f in found], pa.bool_()))
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([e for e, _ in hit], pa.int32()), pa.array([some[k][0] for _, k in hit], pa.string()),
             pa.array([some[k][1] for _, k in hit], pa.bool_())], ["w", "t", "c", "edits", "term", "stem"])

    order = lambda x: (x[0], not x[1])
    if terms.count() <= part_terms:
        whole = sorted(((r["term"], r["stem"], ()) for r in terms.select("term", "stem").collect()), key=order)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon = Lexicon(whole, {}, 0.0, fuzzy_len, True, two_len)
            for batch in batches:
                yield matched(batch, lexicon, whole)

        return materialise(counts.select("w", "t", "c").mapInArrow(run, match), "tox-matches")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = sorted({(t, s, ()) for t, s in zip(batch.column("term").to_pylist(), batch.column("stem").to_pylist())}, key=order)
            yield matched(batch, Lexicon(some, {}, 0.0, fuzzy_len, True, two_len), some)

    best = F.min(F.struct("edits", "term", (~F.col("stem")).alias("whole"))).alias("m")
    found = candidates(counts, terms, fuzzy_len, two_len).mapInArrow(confirm, match).groupBy("w", "t", "c").agg(best)
    return materialise(found.select("w", "t", "c", "m.edits", "m.term", (~F.col("m.whole")).alias("stem")), "tox-matches")


def hot_words(counts: DataFrame, terms: DataFrame, base: float, shrink: float = 5.0, share: float = 0.75, **kw) -> DataFrame:
    """Rows (w, family, form, edits, weights) of all words that are terms or misspellings with positive weight.

    A misspelling starts from a share of its family's own weight, goes as far
    from it as the other words at that distance from the family say (each word
    once, however often it stands), and then as its own counts say.
    """
    found = match_words(counts, terms, **kw).join(broadcast_measured(terms), ["term", "stem"])
    n = F.col("t") + F.col("c")
    types = materialise(found.where((F.col("edits") > 0) & (n > 0)).groupBy("family", "edits").agg(
        F.sum(F.col("t") / n).alias("tt"), F.sum(F.col("c") / n).alias("tc")), "tox-types")
    found = found.join(broadcast_measured(types), ["family", "edits"], "left").na.fill(0.0, ["tt", "tc"])
    start = lambda x: 1 / (1 + F.exp(-(share * x + F.lit(_logit(base)))))
    unseen = lambda x: (F.col("tt") + shrink * start(x)) / (F.col("tt") + F.col("tc") + shrink)
    p = lambda x: (F.col("t") + shrink * unseen(x)) / (n + shrink)
    weights = F.when(F.col("edits") == 0, F.col("weights")).otherwise(
        F.transform("weights", lambda x: F.log(p(x) / (1 - p(x))) - _logit(base)))
    form = F.when(F.col("edits") == 0, F.col("w")).otherwise(F.col("term"))
    return materialise(found.select("w", "family", form.alias("form"), "edits", weights.alias("weights"))
                       .where(F.array_max("weights") > 0), "tox-hot")


_HIT = "struct<weight:double,edits:int,quoted:boolean,around:array<string>>"


def find_hits(docs: DataFrame, hot: DataFrame | None, window: int = 4, hot_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` (with columns key, text and others to keep) with ``hits`` in place of the text.

    ``hot`` goes to every task where it is small, else each text gets its own
    words of it by a join.
    """
    kept = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    entry = lambda r: (r["w"].encode("utf-8", "surrogatepass"), (r["family"], r["form"], r["edits"], tuple(r["weights"])))
    joined = hot is not None and (hot.agg(F.sum(row_width(hot) + 100)).first()[0] or 0) > hot_bytes
    everywhere = {} if joined or hot is None else dict(map(entry, hot.collect()))
    if joined:
        own = (docs.select("key", F.explode(F.array_distinct(words(F.col("text")))).alias("w")).join(hot, "w").distinct()
               .groupBy("key").agg(F.collect_list(F.struct(*hot.columns)).alias("__hot")))
        docs = docs.join(own, "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hits(text: str, table: dict[bytes, tuple]) -> list[dict]:
            raw = text.encode("utf-8", "surrogatepass").lower()
            hot = {w: table[w] for w in table.keys() & set(_WORD.findall(raw))}
            if not hot:
                return []
            forms = Counter(family for family, _ in {x[:2] for x in hot.values()})
            spots = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(raw)]
            out = []
            for i, (w, a, b) in enumerate(spots):
                if w in hot:
                    lo, hi = max(0, i - window), i + window + 1
                    before = raw[spots[lo][1]:a].decode("utf-8", "replace")
                    after = raw[b:spots[min(hi, len(spots)) - 1][2]].decode("utf-8", "replace")
                    near = [x.decode("utf-8", "surrogatepass") for x, _, _ in spots[lo:i] + spots[i + 1:hi] if x not in hot]
                    family, _, edits, weights = hot[w]
                    out.append({"weight": weights[min(forms[family], len(weights)) - 1], "edits": edits,
                                "quoted": bool(_QUOTES.search(before) and _QUOTES.search(after)), "around": near})
            return out

        hit_type = pa.list_(pa.struct([("weight", pa.float64()), ("edits", pa.int32()), ("quoted", pa.bool_()),
                                       ("around", pa.list_(pa.string()))]))
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                own = part.column("__hot") if joined else [None] * part.num_rows
                found = [hits(t.as_py() or "", dict(map(entry, h.as_py() or [])) if joined else everywhere)
                         for t, h in zip(part.column("text"), own)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(found, hit_type)],
                                                 [*kept, "hits"])

    return docs.mapInArrow(run, f"{schema}, hits array<{_HIT}>")


FEATURES = ["strongest", "total", "number", "misspelt", "quoted", "context"]


def _features(hits: DataFrame, context: DataFrame) -> DataFrame:
    """One row per row of ``hits`` with FEATURES; ``context`` has (word, odds)."""
    plain = F.filter("hits", lambda h: ~h["quoted"])
    fuzzy = F.filter("hits", lambda h: h["edits"] > 0)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, h: s + F.greatest(h["weight"], F.lit(0.0)))
    n = F.size("hits")
    rated = (hits.where("size(hits) > 0").select("row", F.explode(F.flatten(F.transform("hits", lambda h: h["around"]))).alias("word"))
             .join(context, "word").groupBy("row").agg(F.avg("odds").alias("odds")))
    return hits.join(rated.withColumnRenamed("row", "__row"), F.col("row") == F.col("__row"), "left").withColumns({
        "strongest": F.coalesce(F.array_max(F.transform("hits", lambda h: F.when(h["quoted"], h["weight"] / 2).otherwise(h["weight"]))), F.lit(0.0)),
        "total": F.log1p(total(plain)), "number": F.log1p(n.cast("double")), "misspelt": F.log1p(total(fuzzy)),
        "quoted": F.when(n > 0, F.size(F.filter("hits", lambda h: h["quoted"])) / n).otherwise(0.0),
        "context": F.coalesce("odds", F.lit(0.0))})


def _fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression of shares y of n rows each by Newton steps; the last weight is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (n * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", threshold: float = 0.3, window: int = 4,
                   sample_rows: int = 50_000) -> DataFrame:
    """Rows (id, text_key, held_out, score, predicted) of every row of ``docs``.

    Labels are read where crc32(id as text) mod 4 is not 2 (``held_out`` marks the
    others); several labels of an id: the greatest.
    """
    spark = docs.sparkSession
    ship_package(spark)
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn(
        "key", text_key(F.col("text")))
    known = labels.select(F.col(id_col).alias("lid"), F.col(label_col).cast("int").alias("toxic")).where(
        "lid is not null and toxic in (0, 1)").groupBy("lid").agg(F.max("toxic").alias("toxic"))
    known = broadcast_if_small(materialise(known.where(~F.crc32(F.col("lid").cast("string").cast("binary")).eqNullSafe(F.lit(None))
                                                       & (F.crc32(F.col("lid").cast("string").cast("binary")) % 4 != 2)), "tox-labels"), 16)
    labelled = rows.join(known, F.col("id") == F.col("lid"), "left")
    terms, counts, base = learn_terms(labelled.select("key", "text", "toxic"))
    hot = None if terms is None else hot_words(counts, terms, base)

    with small_batches(spark):
        hits = materialise(find_hits(labelled.select("id", "key", "toxic", "text", F.monotonically_increasing_id().alias("row")),
                                     hot, window), "tox-hits")
    # window words: log-odds between the windows of toxic and of clean training rows
    seen = hits.where("toxic is not null").select("toxic", F.explode(F.array_distinct(F.flatten(
        F.transform("hits", lambda h: h["around"])))).alias("word"))
    context = seen.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where("t + c >= 10")
    context = materialise(context, "tox-context")
    t, c = context.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0))).first()
    odds = F.log((F.col("t") + 1) / F.lit(t + 1.0)) - F.log((F.col("c") + 1) / F.lit(c + 1.0))
    context = broadcast_measured(context).select("word", F.least(F.greatest(odds, F.lit(-2.0)), F.lit(2.0)).alias("odds"))
    featured = materialise(_features(hits, context).select("id", "key", "toxic", *FEATURES), "tox-features")

    # copies have the same features: one row of the sample, with their number as its weight
    texts = featured.where("toxic is not null").groupBy("key").agg(
        F.avg("toxic").alias("toxic"), F.count("*").alias("n"), *[F.min(f).alias(f) for f in FEATURES])
    sample = texts.orderBy("key").limit(sample_rows).select("toxic", "n", *FEATURES).toPandas()
    if len(sample):
        weights = _fit(sample[FEATURES].to_numpy(float), sample["toxic"].to_numpy(float), sample["n"].to_numpy(float)).tolist()
        z = sum((F.col(f) * w for f, w in zip(FEATURES, weights)), F.lit(weights[-1]))
        score = 1 / (1 + F.exp(-z))
    else:
        score = F.lit(0.0)
    return featured.select(F.col("id").alias(id_col), F.col("key").alias("text_key"), held.alias("held_out"),
                           score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, with all their columns."""
    bad = score_toxicity(docs, labels, id_col, text_col, **kw).where("predicted = 1").select(
        F.col("text_key").alias("__bad")).distinct()
    bad = broadcast_if_small(materialise(bad, "toxic"), 64)
    return docs.join(bad, text_key(text_or_empty(text_col)) == F.col("__bad"), "left_anti")
