"""Ids of texts by a ``tokenizers`` file, words that were encoded before taken from a bounded cache.

Used by the token counts (operator 3) and the token files (operator 9).
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters whose lower case, composition and word-forming are the same in every Unicode version; up to U+0239, as
#: some after it have a lower case outside.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u0239"
#: Texts of such letters, ASCII and common punctuation; without apostrophes, which join letters to contractions.
_PLAIN = re.compile("[\x00-\x1b !-&(-~\u00a1\u00ab\u00bb\u00bf\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0239"
                    "\u2013\u2014\u201c-\u201e\u2026]*")
#: Plain texts whose only punctuation is the full stop and the comma.
_PROSE = re.compile(f"[A-Z\u00c0-\u00d6\u00d8-\u00de{_LETTERS} \n.,]*")
_RUNS = re.compile(f"[{_LETTERS}]+|[^ \n\t\r{_LETTERS}]+")


def _separated(text: str, added: tuple[str, ...]) -> str:
    """The same tokens in a form with fewer distinct words: lower case, stops and commas set apart.

    Lower case only for plain texts without any of the ``added`` tokens, which
    the library looks for in the text as it stands; stops and commas only in
    prose where each stands before white space, so none touches another
    punctuation mark.
    """
    prose = _PROSE.fullmatch(text)
    if not prose and not _PLAIN.fullmatch(text):
        return text
    low = text.lower()
    if any(x in low for x in added):
        return text
    if prose:
        count = low.count
        if count(".") + count(",") == (count(". ") + count(", ") + count(".\n") + count(",\n") + (low[-1:] in (".", ","))):
            return low.replace(".", " .").replace(",", " ,")
    return low


#: White space that separates.
SPACES = " \n\t\r"


def separating_tokenizer(path: str):
    """The tokenizer of a file without truncation and padding; an error where white space does not separate."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = [s for s in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
             if s.get("type") == "Split" and s.get("invert") and s.get("behavior") == "Removed"]
    if not split or any(set(t["content"]) & set(SPACES) or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("white space is no stable boundary for this tokenizer")
    return tokenizer


class CachedTokenizer:
    """Ids of texts by a ``tokenizers`` file, parts that cannot influence each other cached.

    White space separates, and so does every border between a letter and what
    is none, apostrophes aside: no match of the pattern goes across.  Texts are
    split at white space (plain ones without added tokens lower-cased before, as the tokenizer does,
    and in prose with stops and commas set apart); a word seen for the first time is cut into runs of letters and runs of
    other characters, if it is plain, and the runs not seen before go to the
    library.  About ``cache_words`` are kept.
    """

    def __init__(self, path: str, cache_words: int = 900_000, joined: int = 200):
        self.tokenizer = separating_tokenizer(path)
        suffix = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        #: contents of the added tokens, in lower case
        self.added = tuple(t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.cache_words, self.joined = cache_words, joined
        self._clear()

    def _add(self, words: list[str], others: list[str]) -> None:
        """Encode new parts; runs of letters, one match each, together in one text."""
        groups = [words[i:i + self.joined] for i in range(0, len(words), self.joined)]
        for k in range(0, len(groups), 50):
            some = groups[k:k + 50]
            for group, e in zip(some, self.tokenizer.encode_batch_fast([" ".join(g) for g in some], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
                if len(cuts) != len(group) + 1 or cuts[-1] != 4 * len(ids):
                    others += group  # not one end of a word for each: one by one
                    continue
                raw = ids.tobytes()
                self.cache.update(zip(group, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
        for k in range(0, len(others), 10_000):
            some = others[k:k + 10_000]
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.cache[p] = np.array(e.ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        """Put new words, as they stand between white space, into the cache."""
        cache, cut, words, others = self.cache, [], set(), set()
        for w in new:
            low = w.lower()
            if any(x in low for x in self.added):
                others.add(w)
            elif w.isascii() and w.isalpha():
                if low not in cache:
                    words.add(low)
                if low != w:
                    cut.append((w, (low,)))
            elif _PLAIN.fullmatch(w):
                runs = _RUNS.findall(low)
                for run in runs:
                    if run not in cache:
                        (words if run[0].isalpha() else others).add(run)
                if len(runs) != 1 or runs[0] != w:
                    cut.append((w, runs))
            else:
                others.add(w)
        self._add(list(words), list(others))
        for w, runs in cut:
            cache[w] = b"".join([cache[run] for run in runs])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of each text, without special tokens added.

        The words of all texts are dictionary-encoded together; the distinct ones
        are looked up in the table of words, and the ids are gathered from it.
        """
        if not texts:
            return []
        split = pc.ascii_split_whitespace(pa.array([_separated(t, self.added) for t in texts], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        if len(self.words) > self.cache_words:
            self._clear()
        known = pc.index_in(coded.dictionary, value_set=self.words)
        place = known.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = len(self.words) + np.arange(len(new))
            self._remember(coded.dictionary.take(pa.array(new)))
        at = place[coded.indices.to_numpy()]
        first, n = self.first[at], self.size[at]
        ends = np.cumsum(n)
        gathered = self.ids[np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.r_[0, ends][split.offsets.to_numpy()].tolist()
        return [gathered[a:b] for a, b in zip(cuts, cuts[1:])]

    def _clear(self) -> None:
        self.cache: dict[str, bytes] = {}
        self.words = pa.array([], pa.large_string())
        self.ids, self.first, self.size = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def _remember(self, new: pa.Array) -> None:
        """Append new words and their ids to the table of words."""
        listed = new.to_pylist()
        self._learn(listed)
        found = [self.cache[w] for w in listed]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        self.words = pa.concat_arrays([self.words, new])
        self.first = np.r_[self.first, len(self.ids) + np.cumsum(size) - size]
        self.size = np.r_[self.size, size]
        self.ids = np.r_[self.ids, np.frombuffer(b"".join(found), "<u4")]
