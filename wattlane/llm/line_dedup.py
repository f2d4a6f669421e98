"""Operator 6: line dedup by overlapping windows of three lines.

A text's lines that are not blank (compared without spaces, tabs and returns
around them) form overlapping windows of three consecutive lines, each hashed
to 128 bits.  Windows that occur more than once in the corpus keep their first
occurrence, in the order of (id, digest of id and text, position); the lines
covered by any later one are removed, overlapping covers merged.  A later
occurrence that overlaps the first one in the same text leaves the first one
whole.  Blank lines stay where they are.  Every line removed has an equal line
earlier in that order which stays, so no content is lost.

Only (hash, document key, position) is shuffled, a repeated window is reduced
to its minimum before the shuffle, and the texts are joined with the positions
to remove by a broadcast when those are few.

Texts with fewer than three non-blank lines have no window and stay as they
are; null texts stay null; rows equal in id and text are one document and are
treated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlane.llm.common import broadcast_if_small, doc_key, let, materialise, steps, text_or_empty

SIZE = 3
_BLANKS = " \t\r"


def _lines(text: Column) -> Column:
    """Non-blank lines as (at, line): index among all lines, trimmed line."""
    return F.filter(F.transform(F.split(text, "\n"), lambda l, i: F.struct(
        i.alias("at"), F.btrim(l, F.lit(_BLANKS)).alias("line"))), lambda s: s["line"] != "")


def _windows(text: Column) -> Column:
    def windows(ls: Column) -> Column:
        return F.transform(steps(1, F.size(ls) - (SIZE - 1)), lambda i: F.struct(
            i.alias("pos"), F.unhex(F.md5(F.array_join(F.transform(F.slice(ls, i, SIZE), lambda s: s["line"]), "\n")
                                          .cast("binary"))).alias("h")))
    return let(_lines(text), windows)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (key, gone): document key and the numbers (1-based, non-blank lines) of its lines to remove."""
    text = text_or_empty(text_col)
    occ = docs.select(F.col(id_col).alias("id"), doc_key(F.col(id_col), text).alias("key"), F.inline(_windows(text)))
    occ = materialise(occ, "line-windows")
    first = (occ.groupBy("h").agg(F.min(F.struct("id", "key", "pos")).alias("f"), F.max(F.struct("id", "key", "pos")).alias("l"))
             .where(~F.col("f").eqNullSafe(F.col("l"))).select("h", F.col("f.key").alias("fkey"), F.col("f.pos").alias("fpos")))
    first = broadcast_if_small(materialise(first, "line-firsts"), 96)
    later = (occ.join(first, "h").where((F.col("key") != F.col("fkey")) | (F.col("pos") != F.col("fpos")))
             .select("key", F.when(F.col("key") == F.col("fkey"), F.greatest(F.col("pos"), F.col("fpos") + SIZE))
                     .otherwise(F.col("pos")).alias("a"), (F.col("pos") + (SIZE - 1)).alias("b")).where("a <= b"))
    return (later.select("key", F.explode(F.sequence("a", "b")).alias("n"))
            .groupBy("key").agg(F.collect_set("n").alias("gone")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated lines cut out of the text, and columns n_lines, n_removed.

    ``n_lines`` counts the non-blank lines before.  Columns of these names that
    ``docs`` has are replaced.
    """
    gone = materialise(repeated_lines(docs, id_col, text_col), "line-gone")
    rows, numbers = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    gone = broadcast_if_small(gone, 64 + 8 * (numbers // max(rows, 1) + 1))
    text = text_or_empty(text_col)
    gone_at = let(_lines(text), lambda ls: F.transform(F.col("__gone"), lambda n: F.element_at(ls, n)["at"]))
    cleaned = let(gone_at, lambda g: F.array_join(F.filter(
        F.split(text, "\n"), lambda l, i: ~F.array_contains(g, i)), "\n"))
    out = ["n_lines", "n_removed"]
    joined = docs.withColumn("__key", doc_key(F.col(id_col), text)).join(
        gone.select(F.col("key").alias("__gkey"), F.col("gone").alias("__gone")), F.col("__key") == F.col("__gkey"), "left")
    new = {"__n": F.size(_lines(text)), "__r": F.coalesce(F.size("__gone"), F.lit(0)),
           "__t": F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(cleaned)}
    cols = [F.col("__t").alias(c) if c == text_col else F.col(c) for c in docs.columns if c.lower() not in out]
    return joined.withColumns(new).select(*cols, F.col("__n").alias("n_lines"), F.col("__r").alias("n_removed"))
