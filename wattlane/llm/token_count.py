"""Operator 3: token counts of whole texts, huge ones by overlap resynchronisation.

A text of up to ``chunk_chars`` characters is encoded whole, through the cache of
words that the token files use, too.  A longer one is encoded in chunks that overlap, each with the offsets of its tokens, and
spliced where both encodings provably agree:

* *stable boundary*: a position after a white-space character, where white
  space is dropped by the tokenizer's pre-tokenizer.  No match of its pattern
  holds white space, canonical composition never joins across a space, and
  lower-casing goes character by character, so what stands left of such a
  position cannot change the tokens right of it, nor the other way round;
* *common*: no token of either encoding crosses it, and the tokens of the two
  encodings from it to the next stable boundary are the same ids at the same
  offsets.

If the overlap holds no such position, it is widened: doubled to the left
until it is the whole chunk, then the chunk itself is doubled, at last to the
whole rest of the text - so a huge text without any white space is still
counted as the library counts it.

Memory is bounded by a chunk's encoding.  Texts never leave their partition.
A null text is an empty text and has no tokens.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlane.llm.common import text_or_empty
from wattlane.llm.piece_codec import slices
from wattlane.llm.word_cache import SPACES as _SPACES
from wattlane.llm.word_cache import CachedTokenizer
from wattlane.session import ship_package


class ResyncTokenizer:
    """A ``tokenizers`` file whose white space separates; no begin, end or added special tokens."""

    def __init__(self, path: str, chunk_chars: int = 60_000, overlap: int = 200):
        self.words = CachedTokenizer(path)
        self.tokenizer = self.words.tokenizer
        self.chunk_chars, self.overlap = chunk_chars, overlap

    def count_many(self, texts: list[str]) -> list[int]:
        counts = [0] * len(texts)
        small = [i for i, t in enumerate(texts) if len(t) <= self.chunk_chars]
        for i, ids in zip(small, self.words.encode([texts[i] for i in small])):
            counts[i] = len(ids)
        for i, t in enumerate(texts):
            if len(t) > self.chunk_chars:
                counts[i] = self.count_long(t)
        return counts

    def _encode(self, text: str, a: int, b: int) -> list[tuple[int, int, int]]:
        e = self.tokenizer.encode(text[a:b], add_special_tokens=False)
        return [(x + a, y + a, i) for (x, y), i in zip(e.offsets, e.ids)]

    def count_long(self, text: str) -> int:
        n, size = len(text), self.chunk_chars
        start, end, total = 0, min(len(text), size), 0
        left = self._encode(text, start, end)
        since = 0  # tokens of ``left`` before this position are counted already
        while end < n:
            overlap = min(self.overlap, end - since)
            while True:
                right_end = min(n, end - overlap + size)
                right = self._encode(text, end - overlap, right_end)
                at = self._common(text, left, right, end - overlap, end)
                if at is not None:
                    break
                if overlap < end - since:
                    overlap = min(2 * overlap, end - since)
                    size = max(size, 2 * overlap)
                else:  # no common boundary in the whole chunk: a longer chunk from the same place
                    end, size = min(n, 2 * end - since), max(size, 2 * (end - since))
                    left = self._encode(text, since, end)
                    if end == n:
                        return total + len(left)
                    overlap = min(self.overlap, end - since)
            total += sum(since <= a and b <= at for a, b, _ in left)
            since, left, end, size = at, right, right_end, self.chunk_chars
        return total + sum(a >= since for a, _, _ in left)

    @staticmethod
    def _common(text: str, left: list, right: list, a: int, b: int) -> int | None:
        """A stable boundary in a < p < b at which both encodings agree up to the next stable boundary."""
        stable = [p for p in range(a + 1, b) if text[p - 1] in _SPACES and text[p] not in _SPACES]

        def between(tokens: list, p: int, q: int) -> list | None:
            i = bisect_left(tokens, (p,))
            if i and tokens[i - 1][1] > p:
                return None
            j = bisect_left(tokens, (q,))
            part = tokens[i:j]
            return None if any(y > q for _, y, _ in part) else part

        for p, q in zip(stable, stable[1:]):
            mine = between(left, p, q)
            if mine and mine == between(right, p, q):
                return p
        return None


_TOKENIZERS: dict[tuple, ResyncTokenizer] = {}


def count_tokens(docs: DataFrame, tokenizer_file: str, limit: int = 2048, id_col: str = "doc_id",
                 text_col: str = "text", chunk_chars: int = 60_000, overlap: int = 200) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit) of every row of ``docs``; over_limit: n_tokens > limit."""
    ship_package(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    id_type = base.schema["id"].dataType.simpleString()
    key = (tokenizer_file, chunk_chars, overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _TOKENIZERS:
            _TOKENIZERS[key] = ResyncTokenizer(*key)
        for batch in batches:
            for a, b, texts in slices((x.as_py() for x in batch.column("text")), 4_000_000):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array([len(t.encode()) for t in texts], pa.int64()),
                     pa.array(_TOKENIZERS[key].count_many(texts), pa.int64())], ["id", "n_bytes", "n_tokens"])

    return base.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
