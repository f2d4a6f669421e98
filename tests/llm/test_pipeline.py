"""Every pipeline stage against brute force on the stage's own input; registration."""

import hashlib

import corpus_pipeline as C
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as E
from wattlane.llm.common import materialise, table
from wattlane.llm.toxicity import score_toxicity

from . import brute

SF = "/root/testdata/sf0.001"


def _pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_equal_brute_force(spark):
    import public_tokenizers
    import sentencepiece

    docs = table(spark, SF, "documents")
    seen = {}
    for name, stage in C.STAGES:
        seen[name] = (docs, out := materialise(stage(spark, docs, SF), f"test-{name}"))
        docs = out
    for name, (before, after) in seen.items():
        if name != "encode":
            assert after.columns == before.columns and after.schema == before.schema
    before, after = seen["toxicity"]
    bad = {r.doc_id for r in score_toxicity(before, table(spark, SF, "labels")).where("score >= 0.3").collect()}
    assert sorted(_pairs(after)) == sorted(p for p in _pairs(before) if p[0] not in bad)
    before, after = seen["line_dedup"]
    want = {i: t for i, (n, gone, t) in brute.dedup_lines(_pairs(before)).items() if not gone or t.strip(" \t\r\n")}
    assert dict(_pairs(after)) == want
    assert after.where("n_chars <> char_length(text)").count() == before.where("n_chars <> char_length(text)").count()
    before, after = seen["near_duplicates"]
    assert {i for i, _ in _pairs(after)} == set(brute.near_groups(_pairs(before)).values())
    before, after = seen["decontaminate"]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert sorted(_pairs(after)) == sorted(p for p in _pairs(before) if not brute.contamination(p[1], items)[4])
    before, after = seen["encode"]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(C.PIECE_MODEL))
    ids = {i: sp.encode(t, add_bos=True, add_eos=True) for i, t in _pairs(before)}
    assert {r.doc_id: r.ids for r in after.collect()} == ids
    assert {r.doc_id: r.ids_sha256 for r in after.collect()} == {
        i: hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for i, x in ids.items()}


def test_stages_take_odd_tables(spark):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x " * 30_000, "en", "s", 60_000),
                                 (2, "x " * 30_000, "en", "s", 60_000)], table(spark, SF, "documents").schema)
    odd = odd.withColumns({c: F.lit("clash") for c in ("n_lines", "n_removed", "kept", "item_id", "toxic", "key")})
    for rows in (odd, odd.limit(0)):
        docs = rows
        for name, stage in C.STAGES:
            docs = materialise(stage(spark, docs, SF), f"odd-{name}")
            if name != "encode":
                assert docs.columns == odd.columns
        assert docs.count() == (4 if rows is odd else 0) or docs.count() == (3 if rows is odd else 0)


def test_registered(spark):
    names = list(E.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(E.oracle_sql()) <= set(names)
