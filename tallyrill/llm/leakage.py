"""Held-out items whose passages stand in long texts.

Size-partitioned MinHash containment search: texts and items are cut into windows of neighbouring word shingles, and of
each window only the smallest hash is kept. Items are partitioned by size; the window's width is set for each partition
by the shortest passage that counts for its items, so that a passage with all the edits it may have still leaves one
whole window untouched: no passage can be missed by chance, and sketches grow with the text, so a short passage weighs
the same in a long text as in a short one. Partitions of one width are one: where a passage of a fixed number of words
counts, whatever the item's size, there is a single partition, and a share of the item makes them differ.

What the sketches bring up is verified by exact shingle containment, and then from each run of common shingles an
extension to both sides counts the edits.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrill.session import cut

#: Words of a shingle; least words of a passage; words of a passage for each edit it may have.
SHINGLE, PASSAGE, WORDS_AN_EDIT = 5, 20, 10

#: Characters of item texts in one index, which every executor holds; more items are searched in more passes.
INDEX_CHARS = 20_000_000

#: Characters of text read at once, and word hashes a worker remembers.
CHARS, WORDS = 1 << 22, 500_000

#: Pairs of places of common shingles that are looked at together.
PAIRS = 1 << 20

_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb]")
_UNICODE_ESCAPE = re.compile(r"\\+u\{?([0-9a-fA-F]{4})\}?")
_SPACE_ESCAPE = re.compile(r"\\+[nrtbfv]")
_TAG = re.compile(r"<!--.*?-->|</?(?:a|abbr|b|big|cite|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strong|sub|sup|tt|u|wbr)(?:\s[^<>]*)?/?>", re.I | re.S)
_BLOCK_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_EMPTY_COMMENT, _COMMENT_MARK = re.compile(r"<!--\s*-->"), re.compile(r"<!--|-->")
_INLINE = "a|abbr|b|big|cite|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strong|sub|sup|tt|u|wbr"
_BLOCK = (
    "html|head|body|p|div|br|hr|h[1-6]|ul|ol|li|dl|dt|dd|table|thead|tbody|tfoot|tr|td|th|caption|pre|blockquote|img|picture|section|article|header|footer|nav|main|aside|figure|figcaption|details|summary|"
    "script|style|link|meta|title|form|input|button|label|select|option|textarea|iframe|video|audio|source|svg|path|center"
)
_ATTRIBUTES = r"""(?:\s+[\w:.-]+\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=]+))*"""
_KNOWN_TAGS = [[(re.compile(rf"</?(?:{names}){own}\s*/?>", re.I), by) for names, by in ((_INLINE, ""), (_BLOCK, " "))] for own in (_ATTRIBUTES, "")]
_LINK = re.compile(r"\]\([^()\s]*(?:\s\"[^\"]*\")?\)")
_JOINED = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[>\s#*|/]*(?=[^\W\d_])")
_DROPPED = re.compile(r"[*`~\\]|(?<=\w)['’ʼ‘](?=\w)")
_WORD = re.compile(r"[^\W_]+")


def _unescaped(text: str) -> str:
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _SPACE_ESCAPE.sub(" ", _UNICODE_ESCAPE.sub(lambda m: chr(int(m[1], 16)), text))
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return text


def _without_markup(text: str) -> str:
    return _BLOCK_TAG.sub(" ", _TAG.sub("", text))


def _words(text: str) -> list[str]:
    if "](" in text:
        text = _LINK.sub(" ", text)
    return _WORD.findall(_DROPPED.sub("", _JOINED.sub("", text)).casefold())


def plain_words(text: str) -> list[str]:
    """The words of a text without case, punctuation, markup, escapes, invisible signs, accents and line layout."""
    text = _unescaped(text)
    return _words(_without_markup(text) if "<" in text else text)


def readings(text: str) -> list[list[str]]:
    """The different word lists of a text: its ``plain_words``, then those that keep the words of comments, of what only
    looks like a tag, and of attributes. A passage may go past a comment, stand in it or reach into it, so none of them
    replaces another."""
    text = _unescaped(text)
    if "<" not in text:
        return [_words(text)]
    forms = [_without_markup(text)]
    if "<!--" in text:
        text = _COMMENT_MARK.sub(" ", _EMPTY_COMMENT.sub("", text))
        forms.append(_without_markup(text))
    for known in _KNOWN_TAGS:
        form = text
        for tag, by in known:
            form = tag.sub(by, form)
        forms.append(form)
    found = []
    for form in dict.fromkeys(forms):
        if (own := _words(form)) not in found:
            found.append(own)
    return found


_HASHES: dict[str, int] = {}


def word_hashes(words: list[str]) -> np.ndarray:
    if len(_HASHES) > WORDS:
        _HASHES.clear()
    found = _HASHES
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = found.get(w)
        if h is None:
            h = found[w] = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        out[i] = h
    return out


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words, by its first word's place."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            total = total * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
            total ^= total >> np.uint64(29)
        return total * np.uint64(0xBF58476D1CE4E5B9)


def window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places of the smallest hash of each window of ``width`` neighbours."""
    if width <= 1 or len(hashes) <= 1:
        return np.arange(len(hashes))
    width = min(width, len(hashes))
    windows = np.lib.stride_tricks.sliding_window_view(hashes, width)
    return np.unique(np.arange(len(windows)) + windows.argmin(axis=1))


def untouched_run(least: int, most: int, words_an_edit: int) -> int:
    """Words in a row that the worst placed edits leave whole in any passage of ``least`` to ``most`` words."""
    return min(-(-(n - n // words_an_edit) // (n // words_an_edit + 1)) for n in range(least, max(least, most) + 1))


@dataclass
class Item:
    key: object
    words: np.ndarray
    shingles: np.ndarray
    need: int  # words of a passage that counts


@dataclass
class Partition:
    """Items whose passages need one width: sorted window minima and, for each, the item that has it."""

    width: int
    minima: np.ndarray
    owner: np.ndarray


def _furthest(item: list[int], text: list[int], i: int, j: int, most: int, goal: int, matched: bool) -> list[int]:
    """Of 0 to ``most`` edits each, the most item words that can be passed on from item word i and text word j; matched:
    the last word passed has to be one that both share. Stops where ``goal`` words are passed.

    The furthest place on each diagonal with each number of edits follows from those with one edit less."""
    n, m = len(item), len(text)

    def slide(k: int, d: int) -> int:
        while k < n - i and k < goal and 0 <= j + k + d < m and item[i + k] == text[j + k + d]:
            k += 1
        return k

    reach, now = [], {0: 0}
    for e in range(most + 1):
        best, ends = 0, {}
        for d, k in now.items():
            ends[d] = end = slide(k, d)
            if end > best and (end > k or not matched):
                best = end
        reach.append(max(best, reach[-1] if reach else 0))
        if best >= goal:
            return reach + [best] * (most - e)
        now = {}
        for d, k in ends.items():
            steps = [(d, k + 1)] if j + k + d < m else []  # altered
            for to, at in (*steps, (d - 1, k + 1), (d + 1, k)):  # left out, put in
                if at <= n - i and j + at + to <= m and at > now.get(to, -1):
                    now[to] = at
    return reach


@dataclass
class LeakIndex:
    items: list[Item]
    partitions: list[Partition]
    shingles: np.ndarray  # of all items, sorted, with the item that has each
    owner: np.ndarray
    shingle: int
    passage: int
    words_an_edit: int

    @classmethod
    def build(cls, rows: list[tuple], shingle: int, passage: int, words_an_edit: int, share: float = 0.0) -> LeakIndex:
        items = [Item(key, w := word_hashes(own), shingle_hashes(w, shingle), max(passage, ceil(share * len(w)))) for key, text in rows if text for own in readings(text)]
        items = [i for i in items if len(i.words) >= passage]
        sizes: dict[int, list[int]] = {}
        for n, item in enumerate(items):
            sizes.setdefault(int(np.log2(len(item.words) / passage)), []).append(n)
        widths: dict[int, list[int]] = {}
        for members in sizes.values():
            needs = [items[n].need for n in members]
            widths.setdefault(max(1, untouched_run(min(needs), 2 * max(needs), words_an_edit) - shingle + 1), []).extend(members)
        partitions = []
        for width, members in sorted(widths.items()):
            minima = [items[n].shingles[window_minima(items[n].shingles, width)] for n in members]
            flat, owner = np.concatenate(minima), np.repeat(np.array(members, np.int64), [len(m) for m in minima])
            order = np.argsort(flat, kind="stable")
            partitions.append(Partition(width, flat[order], owner[order]))
        every = np.concatenate([np.zeros(0, np.uint64), *(i.shingles for i in items)])
        owner = np.repeat(np.arange(len(items)), [len(i.shingles) for i in items]).astype(np.int64)
        order = np.argsort(every, kind="stable")
        return cls(items, partitions, every[order], owner[order], shingle, passage, words_an_edit)

    def whole(self, need: int) -> int:
        """Whole shingles that the worst placed edits leave in a passage of ``need`` words or more."""
        return max(1, min(n - self.shingle + 1 - self.shingle * (n // self.words_an_edit) for n in range(need, need + self.words_an_edit)))

    def contained(self, hashes: np.ndarray) -> np.ndarray:
        """How many shingles of each item a text holds, for all items at once."""
        own = np.unique(hashes)
        low, high = np.searchsorted(self.shingles, own), np.searchsorted(self.shingles, own, "right")
        count = (high - low)[high > low]
        at = np.repeat(low[high > low], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.bincount(self.owner[at], minlength=len(self.items))

    def search(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(text number, item number) of every leak."""
        words = [(n, word_hashes(own)) for n, t in enumerate(texts) if t for own in readings(t)]
        least = self.passage - self.passage // self.words_an_edit  # a shorter text can't hold a passage
        found = []
        for n, own in words:
            if len(own) < least:
                continue
            hashes = shingle_hashes(own, self.shingle)
            candidates = set()
            for part in self.partitions:
                sketch = hashes[window_minima(hashes, part.width)]
                low, high = np.searchsorted(part.minima, sketch), np.searchsorted(part.minima, sketch, "right")
                for a, b in zip(low[high > low].tolist(), high[high > low].tolist()):
                    candidates.update(part.owner[a:b].tolist())
            if candidates:
                held = self.contained(hashes)
                if candidates := [c for c in sorted(candidates) if held[c] >= self.whole(self.items[c].need)]:
                    order = np.argsort(hashes, kind="stable")
                    found += [(n, c) for c in candidates if self.verify(self.items[c], own, hashes, order)]
        return list(dict.fromkeys(found))

    def verify(self, item: Item, text: np.ndarray, hashes: np.ndarray, order: np.ndarray) -> bool:
        """Exact containment of the item's shingles in the text, then an extension from each run of common ones.

        A passage of n words with n / ``words_an_edit`` edits falls into pieces of at least ``need`` and less than twice
        as many words, one of which has no more edits than it may; so only such pieces are looked for, and the edits to
        try don't grow with the item."""
        need = item.need
        ranked = hashes[order]
        low, high = np.searchsorted(ranked, item.shingles), np.searchsorted(ranked, item.shingles, "right")
        there = high > low
        span = need - self.shingle + 1
        held = np.r_[0, np.cumsum(there)]
        width = min(span, len(there))
        if (held[width:] - held[:-width]).max(initial=0) < min(self.whole(need), span):
            return False
        most = (2 * need - 1) // self.words_an_edit
        run = max(1, untouched_run(need, 2 * need, self.words_an_edit) - self.shingle + 1)
        n, words, own = len(item.words), item.words.tolist(), text.tolist()
        at = np.flatnonzero(there)
        count = (high - low)[at]
        upto = np.cumsum(count)
        start = 0
        while start < len(at):  # common shingles by blocks of item places, so that repeats don't all unfold at once
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS, "right")))
            some, each = at[start:stop], count[start:stop]
            item_place = np.repeat(some, each)
            text_place = order[np.repeat(low[some], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]
            # runs of common shingles that follow each other at one distance
            line = np.sort((text_place - item_place) * (n + 1) + item_place)
            begins = np.flatnonzero(np.r_[True, np.diff(line) != 1])
            length = np.diff(np.r_[begins, len(line)])
            if length.max() >= span:  # a passage word for word
                return True
            for first in line[begins[length >= run]].tolist():
                i = first % (n + 1)
                if self.extends(words, own, i, (first - i) // (n + 1) + i, need, most):
                    return True
            start = stop if stop == len(at) else max(start + 1, stop - run + 1)
        return False

    def extends(self, item: list[int], text: list[int], i: int, j: int, need: int, most: int) -> bool:
        """Whether a passage through item word i at text word j has ``need`` words or more, ``words_an_edit`` for each
        edit. A passage begins with a word that both share; it may end with an edit."""
        right = _furthest(item, text, i, j, most, 2 * need, False)
        lead = slice(max(0, i - 2 * need), i), slice(max(0, j - 2 * need - most), j)
        left = _furthest(item[lead[0]][::-1], text[lead[1]][::-1], 0, 0, most, 2 * need, True)
        return any(left[a] + right[b] >= max(need, self.words_an_edit * (a + b)) for a in range(most + 1) for b in range(most + 1 - a))


def find_leaks(texts: DataFrame, items: DataFrame, text_id: str, text: str, item_id: str, item_text: str, shingle: int = SHINGLE, passage: int = PASSAGE, words_an_edit: int = WORDS_AN_EDIT, share: float = 0.0, index_chars: int = INDEX_CHARS) -> DataFrame:
    """(text_id, item_id) of each text that holds a passage of consecutive words of the item, at least ``passage`` of
    them and at least ``share`` of the item's, with at most one word in ``words_an_edit`` altered, left out or put in.

    Items of fewer words, null and empty texts have no leak. Rows that repeat a text or item give their pairs once
    each. The items' index is broadcast; where they hold more than ``index_chars`` characters, they are searched in
    blocks of about that size, one after the other: a block's pairs are written before the next block's index is built,
    and its broadcast is dropped. Other columns are ignored, whatever their names.
    """
    spark = texts.sparkSession
    own = items.select(F.col(item_id).alias("_key"), F.col(item_text).alias("_text")).where("_text is not null and _key is not null")
    size = own.agg(F.coalesce(F.sum(F.length("_text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // index_chars))
    kind, item_kind = texts.schema[text_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    key_type = pa.int64() if item_kind in ("bigint", "int", "smallint", "tinyint") else pa.string()
    slim = texts.select(F.col(text_id).alias("_id"), F.col(text).alias("_text")).where("_text is not null")

    def search(block: DataFrame, last: bool) -> DataFrame:
        index = spark.sparkContext.broadcast(LeakIndex.build([tuple(r) for r in block.distinct().collect()], shingle, passage, words_an_edit, share))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            leaks = index.value
            for batch in batches:
                rows, start, held = batch.column(1).to_pylist(), 0, 0
                for i, t in enumerate(rows):
                    held += len(t)
                    if held >= CHARS or i + 1 == len(rows):
                        if found := leaks.search(rows[start : i + 1]):
                            ids = batch.column(0).take(pa.array([start + n for n, _ in found]))
                            yield pa.RecordBatch.from_arrays([ids, pa.array([leaks.items[c].key for _, c in found], key_type)], names=["_id", "_item"])
                        start, held = i + 1, 0

        pairs = slim.mapInArrow(find, f"_id {kind}, _item {'bigint' if key_type == pa.int64() else 'string'}").distinct()
        if last:
            return pairs
        pairs = cut(pairs)
        index.destroy()
        return pairs

    parts = [search(own.where(F.pmod(F.xxhash64("_key"), F.lit(blocks)) == b) if blocks > 1 else own, b == blocks - 1) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts).select(F.col("_id").alias(text_id), F.col("_item").cast(item_kind).alias(item_id))
