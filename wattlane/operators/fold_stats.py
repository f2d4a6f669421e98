"""Preprocessing statistics of every expanding fold from one aggregate.

A fold trains on the rows with ``train_from_fold <= fold``, so folds are nested
and what a scaler or an encoder needs adds up: one aggregate per
``train_from_fold`` value gives count, mean and sum of squared deviations of
every numeric column, and folds are merged from those few rows; one aggregate
per (column, value) gives the first fold that knows a text value.  The training
rows are read once for the scalers and once for the encoders, however many folds there are.

Fold ``n_splits`` stands for all training rows (the refit after the search).

* Missing numbers (null, NaN) count in ``n_rows`` but not in ``n``, ``mean`` and
  ``std``; ``std`` is that of the population, as the reference's scaler takes it.
* A column without any value in a fold has null ``mean`` and ``std``.
* A missing text is no category.  Columns may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _number(df: DataFrame, name: str):
    kind = next(f.dataType for f in df.schema.fields if f.name == name)
    c = F.col(_quoted(name)).cast("double")
    return F.nanvl(c, F.lit(None).cast("double")) if isinstance(kind, (T.FloatType, T.DoubleType)) else c


def fold_scalers(folds: DataFrame, numeric: Sequence[str], n_splits: int = 5) -> DataFrame:
    """(fold, feature, n_rows, n, mean, std) of every numeric column in every fold's training rows.

    ``folds`` has the ``train_from_fold`` column of ``expanding_folds``; rows
    where it is null (hold-out rows) count nowhere.  Folds without training rows
    have no line.
    """
    train = folds.where(F.col("train_from_fold").between(0, n_splits))
    if not numeric:
        return folds.sparkSession.createDataFrame(
            [], "fold int, feature string, n_rows long, n long, mean double, std double")
    parts = []
    for i, c in enumerate(numeric):
        x = _number(folds, c)
        parts += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    groups = train.groupBy("train_from_fold").agg(F.count(F.lit(1)).alias("n_rows"), *parts)    # n_splits + 1 rows
    each = F.explode(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("m"),
        (F.col(f"v{i}") * F.col(f"n{i}")).alias("dev")) for i, c in enumerate(numeric)])).alias("s")
    in_fold = F.explode(F.sequence(F.col("train_from_fold").cast("int"), F.lit(n_splits))).alias("fold")
    listed = groups.select("train_from_fold", "n_rows", each).select("n_rows", "s.*", in_fold)
    merged = listed.groupBy("fold", "feature").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n"),
        F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("mean"),
        F.collect_list(F.struct("n", "m", "dev")).alias("_g"))
    dev = F.aggregate("_g", F.lit(0.0), lambda acc, g: acc + F.when(
        g["n"] > 0, g["dev"] + g["n"] * F.pow(g["m"] - F.col("mean"), 2)).otherwise(0.0))
    return merged.select("fold", "feature", "n_rows", "n", "mean", F.sqrt(F.try_divide(dev, F.col("n"))).alias("std"))


def fold_categories(folds: DataFrame, text: Sequence[str]) -> DataFrame:
    """(feature, value, first_fold): the first fold whose training rows hold the text value.

    Fold f knows the values with ``first_fold <= f``; an unseen value of its test
    block is in none of them.
    """
    if not text:
        return folds.sparkSession.createDataFrame([], "feature string, value string, first_fold int")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(_quoted(c)).alias("value")) for c in text])).alias("s")
    return (folds.where(F.col("train_from_fold") >= 0).select("train_from_fold", each).select("train_from_fold", "s.*")
            .where(F.col("value").isNotNull()).groupBy("feature", "value")
            .agg(F.min("train_from_fold").cast("int").alias("first_fold")))


def fold_preprocessing(folds: DataFrame, numeric: Sequence[str], text: Sequence[str], n_splits: int = 5) -> list[list]:
    """Ready pipeline stages that build ``features``, per fold and (last) for all training rows.

    Numbers are imputed with the fold's mean and standardised, texts become one
    0/1 slot per value that the fold knows, in alphabetical order, all zeros for
    any other.  No stage has to be fitted on data.  What reaches the driver is
    (n_splits + 1) x columns numbers and the distinct text values, which are the
    features' own names.
    """
    from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
    stats = {(r.fold, r.feature): r for r in fold_scalers(folds, numeric, n_splits).collect()}
    known = [(r.feature, r.value, r.first_fold) for r in fold_categories(folds, text).collect()]
    out = []
    for fold in range(n_splits + 1):
        stages, inputs, exprs = [], [], []
        for i, c in enumerate(numeric):
            s = stats.get((fold, c))
            x = f"nanvl(CAST({_quoted(c)} AS DOUBLE), CAST(NULL AS DOUBLE))"
            scaled = (f"coalesce(({x} - {_literal(s.mean)}) / {_literal(s.std or 1.0)}, 0D)"
                      if s and s.mean is not None else "0D")
            exprs.append(f"{scaled} AS _num_{i}")
            inputs.append(f"_num_{i}")
        if exprs:
            stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__"))
        labels = {c: sorted(v for f, v, first in known if f == c and first <= fold) for c in text}
        used = [c for c in text if labels[c]]
        if used:
            names = [[f"{p}{i}" for i in range(len(used))] for p in ("_idx_", "_ohe_")]
            stages.append(StringIndexerModel.from_arrays_of_labels(
                [labels[c] for c in used], inputCols=used, outputCols=names[0], handleInvalid="keep"))
            # the indexer's unknown bucket is the last category; dropLast makes it all zeros
            stages.append(OneHotEncoder(inputCols=names[0], outputCols=names[1], dropLast=True))
            inputs += names[1]
        stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
        out.append(stages)
    return out


def _literal(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"
