"""Corpus pipeline over ``documents``: toxicity, line dedup, near-duplicates, decontamination, encoding.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which ``run`` writes as Parquet to the shared folder and
reads again as the next one's docs.  All stages but the last return the columns
of documents.  An empty table passes every stage; null and empty texts are
kept by the filtering stages.

1. ``toxicity``: a document predicted toxic goes.
2. ``line_dedup``: later occurrences of three-line windows are cut out of the
   texts (``n_chars`` follows); a document of which nothing is left goes.
3. ``near_duplicates``: one document of each near-duplicate group stays.
4. ``decontaminate``: a document contaminated by ``benchmark`` goes.
5. ``encode``: ids and the decoded text of every document left.

SQL cannot express the first, third and last stage, so ``ORACLE_SQL`` is None
and the stages are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattlane.llm.common import materialise, table
from wattlane.llm.decontaminate import drop_contaminated
from wattlane.llm.minhash_dedup import keep_one_of_each
from wattlane.llm.piece_codec import encode_documents
from wattlane.llm.stages import cut_lines
from wattlane.llm.toxicity import drop_toxic

PIECE_MODEL = "piece_bpe_32k.model"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents predicted toxic, with ``labels`` to learn from."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated three-line windows out of the texts."""
    return cut_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group."""
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents contaminated by ``benchmark``."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256, ids)."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path(PIECE_MODEL)).drop("decoded")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("decontaminate", decontaminate), ("encode", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
