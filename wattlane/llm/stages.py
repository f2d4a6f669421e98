"""Pipeline stages that need more than one call of an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlane.llm.common import text_or_empty


def cut_lines(docs: DataFrame) -> DataFrame:
    """Line dedup with the columns of ``docs``: ``n_chars`` follows the text, documents emptied by it go."""
    from wattlane.llm.line_dedup import dedup_lines
    named = docs.withColumn("__old_chars", F.col("n_chars")) if "n_chars" in docs.columns else docs
    kept = dedup_lines(named.withColumnsRenamed({"n_lines": "__n_lines", "n_removed": "__n_removed"}))
    kept = kept.where((F.col("n_removed") == 0) | (F.btrim(text_or_empty("text"), F.lit(" \t\r\n")) != ""))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("__old_chars")).otherwise(
            F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return kept.drop("n_lines", "n_removed", "__old_chars").withColumnsRenamed(
        {"__n_lines": "n_lines", "__n_removed": "n_removed"}).select(*docs.columns)
