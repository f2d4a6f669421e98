"""Train/test splits (M10, M16, M17) without a global sort.

* ``hash_split``: a row's side is a function of its key (md5 of seed and key
  text), so it does not depend on partitioning or row order and is the same
  in any engine that has md5.
* ``chrono_holdout``: the last ``n_test`` rows in time order are the test
  set.  Rows are counted per hour; the running count from the end over the
  small table of hours finds the hours that reach into the tail; only rows of
  those hours are ranked, at most ``n_test`` per hour after Spark's
  per-partition group limit.
* ``expanding_folds``: ``TimeSeriesSplit(n_splits, test_size)`` as two
  columns per row: the fold the row is a test row of, and the first fold it
  trains in.  No row is copied per fold.
* ``holdout_with_folds``: both from one ranking of the last rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattlane.session import cut_lineage

# Rows a side table may hold and still be broadcast (tail ranks, slice starts).
BROADCAST_ROWS = 1_000_000


def key_hash_bucket(keys: Sequence[str], seed: int = 42, buckets: int = 100) -> Column:
    """Portable key hash in [0, buckets): first 32 bits of md5('seed|k1|k2...')."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return F.pmod(h, F.lit(buckets))


def hash_split(df: DataFrame, keys: Sequence[str], test_pct: int = 20, seed: int = 42,
               out: str = "split") -> DataFrame:
    """About ``test_pct`` % of keys go to 'test', the rest to 'train'."""
    b = key_hash_bucket(keys, seed, 100)
    return df.withColumn(out, F.when(b < F.lit(test_pct), "test").otherwise("train"))


def _bucket(df: DataFrame, order: str) -> Column:
    """Coarse bucket of the order column: the hour for timestamps, the value otherwise."""
    from pyspark.sql import types as T
    dt = df.schema[order].dataType
    c = F.col(order)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.lit(0), F.lit(0))
    return c


def with_row_id(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, with a stored row id ``_rid``."""
    return cut_lineage(df.withColumn("_rid", F.monotonically_increasing_id()))


def tail_index(df: DataFrame, order: str, tiebreak: Sequence[str], n: int, out: str = "rev_idx") -> DataFrame:
    """0-based rank from the end by (order desc, tiebreak desc) for the last ``n`` rows, else NULL.

    Every row of ``df`` comes out once, whatever its keys: rows are identified
    by a stored row id (made by :func:`with_row_id` unless ``df`` has one),
    which also decides between rows equal in all order columns.

    Rows are counted per hour bucket (a table bounded by the time span,
    whatever the timestamp resolution); a running count from the end over that
    table finds the buckets that reach into the tail; only their rows are
    ranked, with a pure ``row_number() <= n`` limit that Spark applies per
    partition before the exchange (``WindowGroupLimit``).
    """
    own = "_rid" not in df.columns
    df = with_row_id(df) if own else df
    b = df.where(F.col(order).isNotNull()).withColumn("_b", _bucket(df, order))
    counts = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    # one row per hour bucket: bounded by the time span, not by the data
    w_after = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    reach = (counts.withColumn("_after", F.coalesce(F.sum("_c").over(w_after), F.lit(0)))
                   .where(F.col("_after") < F.lit(n)).drop("_c"))          # at most n rows
    reach = F.broadcast(reach) if n <= BROADCAST_ROWS else reach
    w_in = Window.partitionBy("_b").orderBy(*[F.col(t).desc() for t in (order, *tiebreak, "_rid")])
    tail = (b.select("_rid", "_b", order, *tiebreak).join(reach, "_b")
              .withColumn("_rn", F.row_number().over(w_in))
              .where(F.col("_rn") <= F.lit(n))                             # group limit
              .withColumn(out, F.col("_after") + F.col("_rn") - F.lit(1))
              .where(F.col(out) < F.lit(n)).select("_rid", out))           # at most n rows
    tail = cut_lineage(tail)          # read with every later use of the split
    tail = F.broadcast(tail) if n <= BROADCAST_ROWS else tail
    ranked = df.join(tail, "_rid", "left")
    return ranked.drop("_rid") if own else ranked


def _fold_columns(df: DataFrame, rank: Column, train: Column, n_splits: int, test_size: int) -> DataFrame:
    """``test_fold`` and ``train_from_fold`` from the rank of a training row counted from the end."""
    inside = train & (rank < F.lit(n_splits * test_size))
    fold = F.when(inside, (F.lit(n_splits - 1) - F.floor(rank / F.lit(test_size))).cast("long"))
    return (df.withColumn("test_fold", fold)
              .withColumn("train_from_fold", F.when(train, F.coalesce(F.col("test_fold") + F.lit(1), F.lit(0)).cast("long"))))


def chrono_holdout(df: DataFrame, n_test: int, order: str = "ts_utc",
                   tiebreak: Sequence[str] = ("postalcode",), out: str = "split") -> DataFrame:
    """``train_test_split(shuffle=False)`` with an integer test size."""
    t = tail_index(df, order, tiebreak, n_test, out="_rev")
    return t.withColumn(out, F.when(F.col("_rev").isNotNull(), "test").otherwise("train")).drop("_rev")


def holdout_with_folds(df: DataFrame, n_test: int, n_splits: int = 5, test_size: int = 96, order: str = "ts_utc",
                       tiebreak: Sequence[str] = ("postalcode",)) -> DataFrame:
    """M16 and M17 from one ranking: ``split``, ``test_fold`` and ``train_from_fold``.

    Equal to :func:`chrono_holdout` followed by :func:`expanding_folds` on its
    training rows; test rows have NULL in the fold columns.
    """
    t = tail_index(df, order, tiebreak, n_test + n_splits * test_size, out="_rev")
    test = F.coalesce(F.col("_rev") < F.lit(n_test), F.lit(False))
    t = t.withColumn("split", F.when(test, "test").otherwise("train"))
    return _fold_columns(t, F.col("_rev") - F.lit(n_test), ~test, n_splits, test_size).drop("_rev")


def holdout_size(n_postalcodes: int, days: int = 20, rows_per_day: int = 96) -> int:
    """Test rows of the reference: 20 x 96 per plotted postal code."""
    return days * rows_per_day * n_postalcodes


def expanding_folds(train: DataFrame, n_splits: int = 5, test_size: int = 96,
                    order: str = "ts_utc", tiebreak: Sequence[str] = ("postalcode",)) -> DataFrame:
    """Adds ``test_fold`` (fold whose test block holds the row, else NULL) and
    ``train_from_fold`` (the row is in the training part of folds >= this one).

    Fold i tests on the ``test_size`` rows that follow the first
    ``n - (n_splits - i) * test_size`` rows and trains on those first rows.
    """
    t = tail_index(train, order, tiebreak, n_splits * test_size, out="_rev")
    return _fold_columns(t, F.col("_rev"), F.lit(True), n_splits, test_size).drop("_rev")


def fold_frames(folds: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) rows of one fold."""
    return (folds.where(F.col("train_from_fold") <= F.lit(fold)),
            folds.where(F.col("test_fold") == F.lit(fold)))
