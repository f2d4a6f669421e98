"""Token counts, SentencePiece codec and token files against the libraries."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from wattlane.llm.piece_codec import PieceCodec, encode_documents
from wattlane.llm.token_count import ResyncTokenizer, count_tokens
from wattlane.llm.token_files import (CachedTokenizer, FrameReader, FrameWriter, read_documents, read_token_files,
                                      write_token_files)

WORDS, PIECES = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string"
ODD = ["a", "The", "don't", "'s", "''s", " ", "  ", "\n", "\t", "é", "e\u0301", " \u0301", "Σας", "日本", "<|endoftext|>", "<|", "...", ".'s",
       "x,", "!?", "12", "\u2003", "\xa0", "\x1c", "\x85", "İ", "🙂", "word.", "end;:", "thonre", "\r\n"]


def _texts(seed, n, size):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(size))) for _ in range(n)]


@pytest.fixture(scope="module")
def reference():
    return ResyncTokenizer(WORDS).tokenizer


@pytest.mark.parametrize("chunk,overlap", [(50, 4), (20, 1), (200, 60)])
def test_resynchronised_counts(reference, chunk, overlap):
    texts = _texts(chunk, 300, 150) + ["x" * 500, "ab " * 300, "日本語" * 200, ("a" * 130 + " ") * 5, "", " " * 400, "a\u0301" * 200, "<|endoftext|>" * 50]
    got = ResyncTokenizer(WORDS, chunk, overlap).count_many(texts)
    assert got == [len(reference.encode(t, add_special_tokens=False).ids) for t in texts]


def test_count_query(spark, reference):
    texts = _texts(1, 40, 100) + [None, "", "long text of words " * 20_000]
    df = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)] * 2, DOCS).withColumn("n_tokens", F.lit("clash"))
    got = count_tokens(df, WORDS, limit=50).collect()
    n = [len(reference.encode(t or "", add_special_tokens=False).ids) for t in texts]
    want = [(i if i else None, len((t or "").encode()), n[i], n[i] > 50) for i, t in enumerate(texts)] * 2
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert count_tokens(df.limit(0), WORDS).count() == 0


def test_cached_encoding(reference):
    texts = _texts(2, 500, 120)
    cached = CachedTokenizer(WORDS, cache_words=50)
    for part in (texts[:250], texts[250:], texts[:100]):
        assert [x.tolist() for x in cached.encode(part)] == [
            reference.encode(t, add_special_tokens=False).ids for t in part]


def test_cached_encoding_of_added_tokens_in_any_case(reference):
    texts = ["a <|ENDOFTEXT|> b", "<|EndOfText|>", "x<|StartOfText|>y, Z.", "a <|endoftext|> B", "<|STARTOFTEXT|>.", "<|X|> y"]
    texts += [f"a{chr(c)}b {chr(c)} X{chr(c)}{chr(c)}." for c in range(0xa0, 0x250)]
    cached = CachedTokenizer(WORDS)
    for part in (texts, texts[::-1]):
        assert [x.tolist() for x in cached.encode(part)] == [reference.encode(t, add_special_tokens=False).ids for t in part]


# ---------------------------------------------------------------------- op 5

@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


SPECIAL = ["", " ", "  ", "   a", "a   ", "\n\n", "\t x", "▁x", " ▁", "<s> </s> <unk>", "<0x41>", "aaaa" * 100, "a" * 3000, "日本語のテキスト" * 200,
           "🙂🙂🙃" * 50, "é\u0300ñ", "\x00a", "a b", "\ufeffx", "x" * 257, " " * 40 + "x" + " " * 300, "=====" * 200, "0123456789" * 80, "\U0010ffff"]


@pytest.mark.parametrize("long_word", [256, 6])
def test_pieces_equal_the_library(library, long_word):
    codec = PieceCodec(PIECES, long_word=long_word, cache_words=100, group_chars=5000)
    texts = _texts(5, 400, 200) + SPECIAL
    got = [np.frombuffer(x, "<u4") for x in codec.encode(texts)]
    assert [x.tolist() for x in got] == [library.encode(t) for t in texts]
    assert [codec.decode(x) for x in got] == [library.decode(x.tolist()) for x in got]


def test_decoding_any_ids(library):
    codec, rng = PieceCodec(PIECES), random.Random(9)
    for _ in range(300):
        ids = [rng.randrange(32_000) if rng.random() < 0.5 else rng.randrange(0, 262) for _ in range(rng.randrange(30))]
        assert codec.decode(np.array(ids, "<u4")) == library.decode(ids), ids


def test_piece_query(spark, library):
    texts = SPECIAL + [None] + _texts(8, 30, 60)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS).withColumn("ids", F.lit("clash"))
    for r in encode_documents(df, PIECES).collect():
        ids = library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded == library.decode(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert encode_documents(df.limit(0), PIECES, with_ids=False).count() == 0


# ---------------------------------------------------------------------- op 9

def test_token_files_round_trip(spark, reference, tmp_path):
    texts = _texts(3, 80, 60) + [None, "", "words and more " * 3000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5])] * 30 + [(None, "none")]
    df = spark.createDataFrame(rows, DOCS).withColumn("start", F.lit("clash")).repartition(3)
    files = write_token_files(df, WORDS, f"file://{tmp_path}/ids", files=5, frame_ids=64)
    got = sorted(read_token_files(files, with_ids=True).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    at = 0
    for r, (i, t) in zip(got, want, strict=True):
        ids = reference.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.id, r.start, r.n_tokens, r.ids) == (i, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert files.count() > 1  # the hot id is spread over files
    some = read_documents(files, spark.createDataFrame([(3,), (82,)], "id long")).collect()
    assert {r.id: r.ids for r in some} == {i: reference.encode(texts[i] or "", add_special_tokens=False).ids + [1] for i in (3, 82)}
    assert not [p for p in (tmp_path / "ids").iterdir() if p.name.startswith(".0")]


def test_token_files_empty_table(spark, tmp_path):
    files = write_token_files(spark.createDataFrame([], DOCS), WORDS, f"file://{tmp_path}/none", files=2)
    assert files.count() == 0 and read_token_files(files).count() == 0


@pytest.mark.parametrize("width", [2, 4])
def test_frames_are_read_on_demand(tmp_path, width):
    import pyarrow as pa
    import zstandard

    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 2 ** (8 * width), n).astype("<u4") for n in (0, 5, 1000, 7, 64, 0, 300)]
    path = tmp_path / "f"
    with open(path, "wb") as f:
        w = FrameWriter(f, pa.int64(), frame_ids=64, width=width)
        for i, d in enumerate(docs):
            w.add(i, d)
        w.close()
    data = path.read_bytes()
    with open(path, "rb") as f:
        r = FrameReader(f, len(data))
        assert (r.document(3) == docs[3]).all() and r.frames_read <= 2
        assert all((r.document(i).astype("<u4") == d).all() for i, d in enumerate(docs))
    # any zstandard reader sees the ids; the seek table has the published layout
    raw = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data)
    assert raw == np.concatenate(docs).astype(f"<u{width}").tobytes()
    n, flag, magic = struct.unpack("<IBI", data[-9:])
    assert magic == 0x8F92EAB1 and flag == 0x80 and n == -(-sum(map(len, docs)) // 64) + 1
    assert struct.unpack("<II", data[-9 - 12 * n - 8:-9 - 12 * n]) == (0x184D2A5E, 12 * n + 9)
    broken = bytearray(data)
    broken[int(r.at[4]) + 12] ^= 255
    (tmp_path / "g").write_bytes(broken)
    with open(tmp_path / "g", "rb") as f, pytest.raises((ValueError, zstandard.ZstdError)):
        FrameReader(f, len(broken)).frame(4)
