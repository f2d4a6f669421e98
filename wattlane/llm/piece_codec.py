"""Operator 5: SentencePiece BPE encoding and decoding by vectorised merge rounds.

The vocabulary (pieces, scores, kinds) is read from the model file; the
encoding itself is done here, exactly as the library's BPE does it: of all
adjacent symbols whose concatenation is a piece, the pair with the best score,
the leftmost one among equals, is merged until none is left; characters that
are no piece become byte pieces.

*Words.*  A merge can only join characters that stand side by side inside some
piece.  A text is therefore cut wherever the two characters around a position
occur in no piece next to each other (found for a whole batch with one numpy
lookup): no merge can ever cross such a cut, so the words between the cuts are
encoded independently of each other.  Spaces are such cuts.

*Rounds.*  The symbols of all words lie in one flat array.  A round looks up
the rank of every adjacent pair, takes the minimum per word (a segmented
reduction), merges the leftmost pair of that rank in every word at once, and
compacts the array; words without a pair leave it.  A word of n symbols ends
after at most n - 1 rounds.

*Long words.*  A word of more than ``long_word`` symbols (a long run without
any cut) would need as many rounds; it is merged with a heap of pairs
instead, in n log n steps, to the same result.

*Memory.*  Texts are taken in groups of about ``group_chars`` characters; the
cache of encoded words is emptied when it reaches ``cache_words``.

A null text is an empty text; an empty text has only the begin and end ids.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlane.llm.common import text_or_empty
from wattlane.session import ship_package

SPACE = "▁"  # fixed value: the mark of a space in pieces
_NONE = np.int32(2 ** 31 - 1)


class PieceCodec:
    """Encoder and decoder for one SentencePiece BPE model file."""

    def __init__(self, model_file: str, long_word: int = 256, cache_words: int = 120_000,
                 group_chars: int = 1_000_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        normal = {pieces[i]: i for i in range(n)
                  if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.long_word, self.cache_words, self.group_chars = long_word, cache_words, group_chars

        # symbols: the pieces, then the characters of pieces that are no pieces
        chars = sorted({c for p in normal for c in p})
        self.symbol = dict(normal)
        for c in chars:
            self.symbol.setdefault(c, n + len(self.symbol) - len(normal))
        self.n_symbols = n + len(self.symbol) - len(normal)
        self.char_symbol = np.full(0x110000, -1, np.int32)
        for c in chars:
            self.char_symbol[ord(c)] = self.symbol[c]

        # character pairs that stand side by side in some piece
        self.char_no = np.zeros(0x110000, np.int32)
        for i, c in enumerate(chars, 1):
            self.char_no[ord(c)] = i
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in normal:
            for a, b in zip(p, p[1:]):
                self.beside[self.char_no[ord(a)], self.char_no[ord(b)]] = True

        # pairs of symbols: key left * n_symbols + right -> rank of the score (0 is best), merged piece
        ranks = {s: i for i, s in enumerate(sorted({sp.get_score(i) for i in normal.values()}, reverse=True))}
        found = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    found[a * self.n_symbols + b] = (ranks[sp.get_score(i)], i)
        self.pair_keys = np.array(sorted(found), np.int64)
        self.pair_rank = np.array([found[k][0] for k in self.pair_keys.tolist()] + [_NONE], np.int32)
        self.pair_piece = np.array([found[k][1] for k in self.pair_keys.tolist()] + [-1], np.int32)
        self.pairs = found

        # decoding: the bytes of every id
        self.surface = [b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i)
                        else bytes([int(p[3:5], 16)]) if sp.is_byte(i)
                        else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])
        self.marked = [p.startswith(SPACE) for p in pieces]
        self._cache: dict[str, bytes] = {}

    # ------------------------------------------------------------------ encoding

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index into pair_rank / pair_piece, the last entry where the pair is no piece."""
        key = left.astype(np.int64) * self.n_symbols + right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), at, len(self.pair_keys))

    def merge_words(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian uint32) of each word; a word has at least one character."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sym = self.char_symbol[code]
        # a symbol that is no piece keeps its character, to become bytes
        sym = np.where(sym < 0, -1 - code, sym).astype(np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        char = code
        done_sym, done_word, done_char = [], [], []
        while len(sym):
            at = np.full(len(sym), len(self.pair_keys))
            if len(sym) > 1:
                inside = word[:-1] == word[1:]
                at[:-1] = np.where(inside, self._lookup(sym[:-1], sym[1:]), len(self.pair_keys))
            rank = self.pair_rank[at]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.r_[starts, len(sym)])
            live = np.repeat(best != _NONE, size)
            if not live.all():
                done_sym.append(sym[~live]), done_word.append(word[~live]), done_char.append(char[~live])
            hits = np.flatnonzero((rank == np.repeat(best, size)) & live)
            if not len(hits):
                break
            first = hits[np.r_[True, word[hits[1:]] != word[hits[:-1]]]]  # the leftmost of each word
            sym[first] = self.pair_piece[at[first]]
            live[first + 1] = False
            sym, word, char = sym[live], word[live], char[live]
        sym, word, char = map(np.concatenate, (done_sym, done_word, done_char))
        order = np.argsort(word, kind="stable")
        sym, word, char = sym[order], word[order], char[order]
        return self._as_ids(sym, word, char, len(words))

    def _as_ids(self, sym: np.ndarray, word: np.ndarray, char: np.ndarray, n: int) -> list[bytes]:
        """Symbols to ids: what is no piece goes as its UTF-8 bytes."""
        odd = np.flatnonzero((sym < 0) | (sym >= len(self.surface)))
        if len(odd):
            reps = np.ones(len(sym), np.int64)
            extra = [self._bytes_of(chr(c)) for c in char[odd].tolist()]
            reps[odd] = [len(x) for x in extra]
            at = np.cumsum(reps) - reps
            out = np.repeat(sym, reps)
            for i, x in zip(at[odd].tolist(), extra):
                out[i:i + len(x)] = x
            sym, word = out, np.repeat(word, reps)
        ids = sym.astype("<u4")
        cuts = np.searchsorted(word, np.arange(n + 1)) * 4
        raw, cuts = ids.tobytes(), cuts.tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _bytes_of(self, c: str) -> list[int]:
        return [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unk]

    def merge_long(self, word: str) -> bytes:
        """One word by a heap of pairs (rank, position): the same merges in n log n steps."""
        n = len(word)
        sym = [s if s >= 0 else -1 for s in self.char_symbol[[ord(c) for c in word]].tolist()]
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        alive, m = [True] * n, self.n_symbols
        heap = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n and sym[i] >= 0 and sym[j] >= 0:
                found = self.pairs.get(sym[i] * m + sym[j])
                if found:
                    heap.append((found[0], i, sym[i], sym[j], found[1])) if start else heapq.heappush(
                        heap, (found[0], i, sym[i], sym[j], found[1]))

        start = True
        for i in range(n):
            offer(i)
        heapq.heapify(heap)
        start = False
        while heap:
            _, i, a, b, piece = heapq.heappop(heap)
            if not alive[i] or sym[i] != a or (j := nxt[i]) >= n or sym[j] != b:
                continue
            sym[i], alive[j], nxt[i] = piece, False, nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        out: list[int] = []
        for i in range(n):
            if alive[i]:
                out += [sym[i]] if 0 <= sym[i] < len(self.surface) else self._bytes_of(word[i])
        return np.array(out, "<u4").tobytes()

    def _cut(self, texts: list[str]) -> list[list[str]]:
        """The words of each (marked, non-empty) text."""
        joined = "".join(texts)
        no = self.char_no[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        ends = np.cumsum([len(t) for t in texts])
        cut = ~self.beside[no[:-1], no[1:]]
        cut[ends[:-1] - 1] = True
        at = np.r_[0, np.flatnonzero(cut) + 1, len(joined)]
        per_text = np.searchsorted(at, np.r_[0, ends]).tolist()
        at = at.tolist()
        return [[joined[a:b] for a, b in zip(at[i:j], at[i + 1:j + 1])] for i, j in zip(per_text, per_text[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text without begin and end, as little-endian uint32 bytes."""
        out = [b""] * len(texts)
        group: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if t:
                group.append(i)
                size += len(t)
            if group and (size >= self.group_chars or i == len(texts) - 1):
                for j, ids in zip(group, self._encode_group([SPACE + texts[j].replace(" ", SPACE) for j in group])):
                    out[j] = ids
                group, size = [], 0
        return out

    def _encode_group(self, texts: list[str]) -> Iterator[bytes]:
        cut = self._cut(texts)
        if len(self._cache) > self.cache_words:
            self._cache.clear()
        cache = self._cache
        new = list({w for ws in cut for w in ws if w not in cache})
        short = [w for w in new if len(w) <= self.long_word]
        for k in range(0, len(short), 50_000):
            part = short[k:k + 50_000]
            cache.update(zip(part, self.merge_words(part)))
        long = {w: self.merge_long(w) for w in new if len(w) > self.long_word}
        for ws in cut:
            yield b"".join([long[w] if len(w) > self.long_word else cache[w] for w in ws] if long
                           else map(cache.__getitem__, ws))

    # ------------------------------------------------------------------ decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids; control ids are silent, the mark of the first piece is dropped."""
        listed = ids.tolist()
        raw = b"".join(map(self.surface.__getitem__, listed))
        first = next((i for i in listed if self.surface[i]), None)
        if first is not None and self.marked[first]:
            raw = raw[1:]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return self._decode_bytes(ids, first)

    def _decode_bytes(self, ids: np.ndarray, first: int | None) -> str:
        """As decode, for byte ids that are no UTF-8: one replacement character for each byte that fits nowhere."""
        out: list[str] = []
        run = bytearray()

        def flush() -> None:
            i = 0
            while i < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[i:i + n]).decode("utf-8"))
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    n = 1
                i += n
            run.clear()

        for i in ids.tolist():
            if self.is_byte[i]:
                run += self.surface[i]
            else:
                flush()
                out.append(self.surface[i].decode("utf-8"))
        flush()
        text = "".join(out)
        return text[1:] if first is not None and self.marked[first] else text


_CODECS: dict[str, PieceCodec] = {}


def codec_for(model_file: str) -> PieceCodec:
    """One codec per worker process and model."""
    if model_file not in _CODECS:
        _CODECS[model_file] = PieceCodec(model_file)
    return _CODECS[model_file]


def slices(texts: Iterable[str | None], chars: int = 1_000_000) -> Iterator[tuple[int, int, list[str]]]:
    """Runs (first, end, texts) of about so many characters, null as empty."""
    start, part, size = 0, [], 0
    i = -1
    for i, t in enumerate(texts):
        part.append(t or "")
        size += len(part[-1])
        if size >= chars:
            yield start, i + 1, part
            start, part, size = i + 1, [], 0
    if part:
        yield start, i + 1, part


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = True) -> DataFrame:
    """Rows (id, n_tokens, ids, ids_sha256, decoded, decoded_sha256) of every row of ``docs``.

    ``ids``: all ids with begin and end, array<int>; ``decoded``: the text they
    decode to.  Both are left out with ``with_ids=False``, which keeps the wide
    columns inside the task.  Texts never leave their partition.
    """
    ship_package(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    id_type = base.schema["id"].dataType.simpleString()
    wide = ", ids array<int>, decoded string" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(model_file)
        head, tail = (np.array([i], "<u4").tobytes() for i in (codec.bos, codec.eos))
        for batch in batches:
            column = batch.column("text")
            for a, b, texts in slices(x.as_py() for x in column):
                ids = [head + x + tail for x in codec.encode(texts)]
                arrays = [np.frombuffer(x, "<u4") for x in ids]
                decoded = [codec.decode(x) for x in arrays]
                cols = [batch.column("id").slice(a, b - a), pa.array([len(x) for x in arrays], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded])]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols += [pa.array([x.astype(np.int32) for x in arrays], pa.list_(pa.int32())), pa.array(decoded)]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)
        codec._cache.clear()  # the worker goes on to other tasks
        pa.default_memory_pool().release_unused()

    return base.mapInArrow(run, f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string{wide}"
                           ).withColumnRenamed("id", id_col)
