"""Operator 4: URL rules by host-suffix / path-prefix expressions, in DataFrame expressions only.

Every distinct URL is expanded into expressions (host suffix, path directory):
all suffixes of the host at a dot and all prefixes of the path that end in a
slash (and the empty one).  Rules are indexed by the same expression: their
host and their path up to its last slash.  Both sides are joined on the first
32 bits of the expression's sha256, then the full digests are compared and
the rest of the rule's path is checked with ``startswith``, so a rule path
that ends inside a directory name works too.  The longest rule wins.

Rules within the broadcast limit (measured bytes) go to every task.  Beyond it
expressions are counted first, with partial counts before the shuffle; rules whose
expression no URL has go, and an expression of very many URLs (``com`` with the
empty path) is spread over several join keys, the rules under it repeated once for
each.

No rule can fit a suffix or prefix longer than the longest rule, so URLs
with thousands of dots or slashes are expanded only that far.

Nulls: a null URL, or one without ``://``, has an empty host and path and fits
no rule.  Repeated URLs are matched once and joined back.  A rule with a null
host or path is ignored; two rules with equal host and path and different
verdicts: ``block`` wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlane.llm.common import BROADCAST_BYTES, LOWER, UPPER, materialise, row_width

#: Most expressions that may count as hot, whatever their number in all.
_HOT = 10_000


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, directory: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\u0000"), directory).cast("binary"), 256)


def _salted(expressions: DataFrame, indexed: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``salt`` to join on: expressions of over ``hot_rows`` URLs are spread, their rules repeated."""
    seen = materialise(expressions.groupBy("short", "digest").agg(F.count("*").alias("n")), "url-seen")
    # at least a 1/_HOT part of all: at most _HOT rows are hot, so they may be broadcast
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    block = max(hot_rows, total // _HOT)
    hot = F.broadcast(seen.where(F.col("n") > block).select(F.col("digest").alias("hot"), F.ceil(F.col("n") / block).alias("copies")))
    used = indexed.join(seen.select(F.col("short").alias("s"), "digest"),
                        (F.col("short") == F.col("s")) & (F.col("rule_digest") == F.col("digest")), "left_semi")
    used = used.join(hot, F.col("rule_digest") == F.col("hot"), "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("hot", "copies")
    spread = expressions.join(hot, F.col("digest") == F.col("hot"), "left").withColumn(
        "salt", F.pmod(F.xxhash64("u"), F.coalesce("copies", F.lit(1)))).drop("hot", "copies")
    return spread, used


def filter_urls(df: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow",
                broadcast_bytes: int = BROADCAST_BYTES, hot_rows: int = 100_000) -> DataFrame:
    """``df`` with columns url_host, url_path, url_rule (``host`` + ``path`` or null), url_verdict.

    ``rules``: columns host, path, verdict (``allow`` or ``block``).  Any of the
    four output names that ``df`` already has is replaced.
    """
    rules = rules.where("host is not null and path is not null").select("host", "path", "verdict")
    slash = F.col("path").contains("/")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn(
        "dir", F.when(slash, F.regexp_extract("path", r"(?s)^(.*/)", 1)).otherwise(F.lit("")))
    rules = materialise(rules.select("host", "path", "verdict", "dir", _digest(F.col("host"), F.col("dir")).alias("rule_digest")),
                        "url-rules")
    labels, depth = rules.agg(
        F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0)),
        F.coalesce(F.max(F.size(F.split("dir", "/"))), F.lit(1))).first()

    url = F.col(url_col).cast("string")
    urls = df.select(url.alias("u")).where("u is not null").distinct().select(
        "u", url_host(F.col("u")).alias("h"), url_path(F.col("u")).alias("p"))
    split_host, split_path = F.split("h", r"\."), F.split("p", "/")
    n_host = F.size(split_host)
    suffixes = F.transform(
        F.sequence(F.greatest(n_host - labels + 1, F.lit(1)), n_host),
        lambda i: F.array_join(F.slice(split_host, i, n_host), "."))
    # prefixes of 0 .. depth-1 slashes
    n_dirs = F.least(F.size(split_path) - 1, F.lit(depth - 1))
    prefixes = F.transform(
        F.sequence(F.lit(0), n_dirs),
        lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(split_path, 1, i), "/"), F.lit("/"))))
    expressions = (urls.where("h <> ''").select("u", "p", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
                   .select("u", "p", "suffix", F.explode("prefixes").alias("prefix"))
                   .select("u", "p", _digest(F.col("suffix"), F.col("prefix")).alias("digest"))
                   .withColumn("short", F.substring("digest", 1, 8)))
    indexed, on = rules.withColumn("short", F.substring("rule_digest", 1, 8)), ["short"]
    if (rules.agg(F.sum(row_width(rules))).first()[0] or 0) <= broadcast_bytes:
        indexed = F.broadcast(indexed)
    else:
        expressions, indexed = _salted(expressions, indexed, hot_rows)
        on = ["short", "salt"]
    rule = F.concat("host", "path")
    best = (expressions.join(indexed, on)
            .where((F.col("digest") == F.col("rule_digest")) & F.col("p").startswith(F.col("path")))
            .groupBy("u").agg(F.max(F.struct(F.char_length(rule).alias("len"), F.char_length("host").alias("hl"),
                                             rule.alias("rule"), "verdict")).alias("best"))
            .select("u", F.col("best.rule").alias("__rule"), F.col("best.verdict").alias("__verdict")))
    out = ["url_host", "url_path", "url_rule", "url_verdict"]
    return (df.withColumn("__u", url).join(best.withColumnRenamed("u", "__ru"), F.col("__u") == F.col("__ru"), "left")
            .withColumns({"url_host": url_host(F.col("__u")), "url_path": url_path(F.col("__u")),
                          "url_rule": F.col("__rule"), "url_verdict": F.coalesce("__verdict", F.lit(default))})
            .select(*[c for c in df.columns if c.lower() not in out], *out))
