"""Token ids of whole texts by a public byte-level BPE vocabulary, speculating and verifying.

Each distinct word is first cut greedily into the longest tokens. A cut is the right one exactly if every two
neighbouring tokens, taken alone, would be merged into themselves; that is looked up for all pairs of all new words at
once in a sorted table of known pairs. Only words with a pair that fails go through exact merging.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies unless the caller says otherwise; it is read by the workers, not shipped.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the pattern that splits a text into words before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words and pairs a worker remembers, and characters it encodes at once; bounds of memory, not of the result.
WORDS, PAIRS, CHARS = 400_000, 4_000_000, 1 << 21


class Encoder:
    """The vocabulary with a worker's memory of words and pairs."""

    def __init__(self, vocabulary: str = VOCABULARY, pattern: str = PATTERN):
        with open(vocabulary, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token = {i: t for t, i in self.ranks.items()}
        self.span = max(map(len, self.ranks))
        self.size = max(self.token) + 1
        self.words = regex.compile(pattern)
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs, self.fit = np.zeros(0, np.int64), np.zeros(0, bool)

    def merged(self, word: bytes) -> list[int]:
        """The exact encoding of a word: the lowest-ranked neighbouring pair is merged until none is left."""
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        return self._merges(word)

    def _merges(self, word: bytes) -> list[int]:
        n, ranks = len(word), self.ranks
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapify(heap)
        gone = bytearray(n)
        while heap:
            _, i, stop = heappop(heap)
            j = after[i]
            if gone[i] or j >= n or end[j] != stop:
                continue
            end[i], gone[j], after[i] = stop, 1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := ranks.get(word[i : end[after[i]]])) is not None:
                    heappush(heap, (r, i, end[after[i]]))
            if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
                heappush(heap, (r, p, stop))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[word[i : end[i]]])
            i = after[i]
        return ids

    def _greedy(self, word: bytes) -> list[int]:
        ids, i, n, ranks = [], 0, len(word), self.ranks
        while i < n:
            for stop in range(min(n, i + self.span), i, -1):
                if (token := ranks.get(word[i:stop])) is not None:
                    ids.append(token)
                    i = stop
                    break
        return ids

    def _fits(self, wanted: np.ndarray) -> np.ndarray:
        """For each pair code whether the two tokens stay as they are when merged alone."""
        distinct, back = np.unique(wanted, return_inverse=True)
        at = np.searchsorted(self.pairs, distinct)
        there = np.zeros(len(distinct), bool)
        if len(self.pairs):
            there = self.pairs[np.minimum(at, len(self.pairs) - 1)] == distinct
        new = distinct[~there]
        if len(new):
            first, second = np.divmod(new, self.size)
            token = self.token
            fit = np.fromiter((self._merges(token[a] + token[b]) == [a, b] for a, b in zip(first.tolist(), second.tolist())), bool, len(new))
            if len(self.pairs) > PAIRS:
                self.pairs, self.fit = np.zeros(0, np.int64), np.zeros(0, bool)
                return self._fits(wanted)
            pairs = np.concatenate([self.pairs, new])
            order = np.argsort(pairs, kind="stable")
            self.pairs, self.fit = pairs[order], np.concatenate([self.fit, fit])[order]
            at = np.searchsorted(self.pairs, distinct)
        return self.fit[at][back]

    def learn(self, words: set[str]) -> None:
        """Encodes new words, all at once."""
        if len(self.known) > WORDS:
            self.known.clear()
        new = list(words)
        raw = [w.encode() for w in new]
        cuts = [self._greedy(w) for w in raw]
        sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
        flat = np.fromiter(chain.from_iterable(cuts), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = False  # a word's last token has no neighbour in it
        left = np.flatnonzero(inner)
        fits = self._fits(flat[left] * self.size + flat[left + 1]) if len(left) else np.zeros(0, bool)
        failing = set(np.searchsorted(ends, left[~fits], "right").tolist())
        for i, (word, cut) in enumerate(zip(new, cuts)):
            self.known[word] = tuple(self.merged(raw[i]) if i in failing else cut)

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.words.findall(t) for t in texts]
        words = set(chain.from_iterable(split))
        if new := (words - self.known.keys() if len(self.known) <= WORDS else words):
            self.learn(new)
        known = self.known
        return [list(chain.from_iterable([known[w] for w in ws])) for ws in split]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> Encoder:
    """A worker's one encoder of a vocabulary, kept between tasks."""
    if (vocabulary, pattern) not in _ENCODERS:
        _ENCODERS[vocabulary, pattern] = Encoder(vocabulary, pattern)
    return _ENCODERS[vocabulary, pattern]


def encode_texts(df: DataFrame, text_id: str, text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(text_id, ids array<int>): each text's token ids, special tokens read as ordinary text.

    Null and empty text give an empty list; no text is cut short. Rows keep their ids as they are, repeated and null
    ones too; other columns are ignored, whatever their names. Rows don't depend on each other, so nothing is shuffled.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            start = held = 0
            for i, t in enumerate(texts):
                held += len(t or "")
                if held >= CHARS or i + 1 == len(texts):
                    ids = own.encode([t or "" for t in texts[start : i + 1]])
                    offsets = np.r_[0, np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))]
                    values = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
                    column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, i + 1 - start), column], names=["_id", "ids"])
                    start, held = i + 1, 0

    kind = df.schema[text_id].dataType.simpleString()
    return df.select(F.col(text_id).alias("_id"), F.col(text).alias("_text")).mapInArrow(encode, f"_id {kind}, ids array<int>").withColumnRenamed("_id", text_id)
