"""A vectorised structural index of many JSON texts at once.

All texts of a batch lie in one byte buffer. Bitmaps mark quotes, brackets, commas and colons; the parity of unescaped
quotes, summed from the left, tells strings from structure; prefix sums of the brackets give every token its depth.
Tokens of one depth, in order, then split into the children of each container, so grammar, members and elements are
array operations over all texts together, a pass for each depth.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

# Kinds of tokens.
STRING, SCALAR, OBJECT, ARRAY, COMMA, COLON, CLOSE_OBJECT, CLOSE_ARRAY = range(8)

_SCALAR = re.compile(rb"(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)\Z")
_BAD_ESCAPE = re.compile(rb'\\(?!["\\/bfnrt]|u[0-9a-fA-F]{4})')
_PAIR = re.compile(rb"\\\\")

_STRUCTURE = {ord("{"): OBJECT, ord("["): ARRAY, ord(","): COMMA, ord(":"): COLON, ord("}"): CLOSE_OBJECT, ord("]"): CLOSE_ARRAY}
_KIND = np.full(256, -1, np.int8)
for _byte, _kind in _STRUCTURE.items():
    _KIND[_byte] = _kind
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True


@dataclass
class Index:
    """Values of all texts, a row for each: text number, kind, byte span, parent row (-1 at the top), place among the
    parent's children, byte span of the key (-1 outside objects) and depth (0 at the top)."""

    buffer: bytes
    ok: np.ndarray  # of each text
    text: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray
    parent: np.ndarray
    place: np.ndarray
    key_start: np.ndarray
    key_end: np.ndarray
    depth: np.ndarray

    def children(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of some rows, and for each which of the rows it belongs to."""
        if not hasattr(self, "_order"):
            self._order = np.argsort(self.parent, kind="stable")
            self._above = self.parent[self._order]
        low, high = np.searchsorted(self._above, rows), np.searchsorted(self._above, rows, "right")
        count = high - low
        of = np.repeat(np.arange(len(rows)), count)
        return self._order[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())], of

    def keys_in(self, wanted: list[bytes], plain: Callable[[bytes], bytes]) -> np.ndarray:
        """Of each row the number of its key among the wanted ones, -1 for others; keys with escapes are read by ``plain``."""
        found = np.full(len(self.parent), -1, np.int64)
        data = np.frombuffer(self.buffer, np.uint8)
        size = np.where(self.key_start >= 0, self.key_end - self.key_start - 2, -1)
        for length in {len(k) for k in wanted}:
            rows = np.flatnonzero(size == length)
            if not len(rows):
                continue
            held = data[self.key_start[rows][:, None] + np.arange(1, length + 1)]
            for number, key in enumerate(wanted):
                if len(key) == length:
                    found[rows[(held == np.frombuffer(key, np.uint8)).all(axis=1)]] = number
        slashes = np.r_[0, np.cumsum(data == 0x5C)] if b"\\" in self.buffer else None
        if slashes is not None:
            keyed = np.flatnonzero(size > 0)
            for row in keyed[slashes[self.key_end[keyed]] > slashes[self.key_start[keyed]]].tolist():
                key = plain(self.key(row))
                found[row] = wanted.index(key) if key in wanted else -1
        return found

    def raw(self, row: int) -> bytes:
        return self.buffer[self.start[row] : self.end[row]]

    def key(self, row: int) -> bytes:
        return self.buffer[self.key_start[row] : self.key_end[row]]


def _escaped(data: np.ndarray) -> np.ndarray:
    """Marks of bytes after an odd run of backslashes."""
    slash = data == 0x5C
    marks = np.zeros(len(data), bool)
    if not slash.any():
        return marks
    at = np.flatnonzero(slash)
    run_start = np.r_[True, np.diff(at) > 1]
    first = at[run_start]
    length = np.diff(np.r_[np.flatnonzero(run_start), len(at)])
    after = first + length
    after = after[(length % 2 == 1) & (after < len(data))]
    marks[after] = True
    return marks


def build(texts: list[bytes]) -> Index:
    """The index of the texts. A text that is no complete JSON value is not ok and has no rows."""
    count = len(texts)
    sizes = np.fromiter((len(t) for t in texts), np.int64, count)
    bases = np.r_[0, np.cumsum(sizes + 1)]  # texts are parted by a line feed, which no JSON string holds
    buffer = b"\n".join(texts) + b"\n"
    data = np.frombuffer(buffer, np.uint8)
    bad = np.zeros(count, bool)
    owner = lambda at: np.searchsorted(bases, at, "right") - 1

    quote = (data == 0x22) & ~_escaped(data)
    quotes = np.flatnonzero(quote)
    # a text with an odd number of quotes must not turn the strings of those after it inside out
    per = np.bincount(owner(quotes), minlength=count)[:count] if len(quotes) else np.zeros(count, np.int64)
    odd = per % 2 == 1
    bad |= odd
    if odd.any():
        quotes = quotes[~odd[owner(quotes)]]
    flips = np.zeros(len(data), bool)
    flips[quotes] = True
    inside = np.logical_xor.accumulate(flips) if len(data) else flips  # opening quote to the byte before the closing one
    control = inside & (data < 0x20)
    if control.any():
        bad[owner(np.flatnonzero(control))] = True
    closing = np.zeros(len(data), bool)
    closing[quotes[1::2]] = True
    in_string = inside | closing
    slash_out = (data == 0x5C) & ~in_string
    if slash_out.any():
        bad[owner(np.flatnonzero(slash_out))] = True

    kind_of = np.where(in_string, -1, _KIND[data])
    structural = np.flatnonzero(kind_of >= 0)
    loose = ~in_string & (kind_of < 0) & ~_BLANK[data]
    edge = np.diff(np.r_[False, loose, False].astype(np.int8))
    scalar_start, scalar_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(scalar_start):
        spans, verdicts, broken = list(zip(scalar_start.tolist(), scalar_end.tolist())), {}, []
        for s, e in spans:
            word = buffer[s:e]
            if word not in verdicts:
                verdicts[word] = bool(_SCALAR.match(word))
            if not verdicts[word]:
                broken.append(s)
        if broken:
            bad[owner(np.array(broken))] = True

    string_start, string_end = quotes[0::2], quotes[1::2] + 1
    if (data == 0x5C).any():
        slashes = np.cumsum(np.r_[False, data == 0x5C], dtype=np.int32 if len(data) < 2**31 else np.int64)
        for i in np.flatnonzero(slashes[string_end] > slashes[string_start]):
            if _BAD_ESCAPE.search(_PAIR.sub(b"", buffer[string_start[i] : string_end[i]])):
                bad[owner(string_start[i])] = True

    start = np.concatenate([structural, string_start, scalar_start])
    end = np.concatenate([structural + 1, string_end, scalar_end])
    kind = np.concatenate([kind_of[structural], np.full(len(string_start), STRING), np.full(len(scalar_start), SCALAR)]).astype(np.int8)
    order = np.argsort(start, kind="stable")
    start, end, kind = start[order], end[order], kind[order]
    text = owner(start)

    opens, closes = (kind == OBJECT) | (kind == ARRAY), (kind == CLOSE_OBJECT) | (kind == CLOSE_ARRAY)
    step = opens.astype(np.int64) - closes
    depth = np.cumsum(step)
    begins = np.searchsorted(text, np.arange(count + 1))  # first token of each text
    offset = np.r_[0, depth][begins[:-1]]
    level = depth - offset[text] - opens  # brackets have the level of their container, others that of what is around them
    bad[text[level < 0]] = True
    filled = begins[1:] > begins[:-1]
    bad |= ~filled
    last = np.r_[0, depth][begins[1:]] - offset
    bad |= last != 0

    parent = np.full(len(start), -1, np.int64)
    place = np.zeros(len(start), np.int64)
    key_token = np.full(len(start), -1, np.int64)
    close_at = np.full(len(start), -1, np.int64)
    alive = ~bad[text]
    containers = np.zeros(0, np.int64)  # open tokens one level up
    # tokens by level, each level in order, so that a pass reads its own tokens only, however deep one text goes
    living = np.flatnonzero(alive)
    by_level = living[np.argsort(level[living], kind="stable")]
    deepest = int(level[by_level[-1]]) if len(by_level) else -1
    bounds = np.searchsorted(level[by_level], np.arange(deepest + 2))
    for depth_now in range(deepest + 1):
        here = by_level[bounds[depth_now] : bounds[depth_now + 1]]
        if not len(here):
            break
        if depth_now:
            group = np.searchsorted(containers, here, "right") - 1
        else:
            group = text[here]
        # a closing bracket follows its opening one among the tokens of its level
        closer = closes[here]
        opener_before = np.r_[False, opens[here][:-1]] & np.r_[False, group[1:] == group[:-1]]
        matched = np.zeros(len(here), bool)
        spots = np.flatnonzero(closer)
        matched[spots] = opener_before[spots]
        wrong = here[closer & ~matched]
        good = spots[matched[spots]]
        o, c = here[good - 1], here[good]
        mismatch = (kind[o] == OBJECT) != (kind[c] == CLOSE_OBJECT)
        close_at[o] = c
        bad[text[wrong]] = True
        bad[text[o[mismatch]]] = True
        kids, group = here[~closer], group[~closer]
        fresh = np.r_[True, group[1:] != group[:-1]]
        first = np.flatnonzero(fresh)
        number = np.arange(len(kids)) - np.repeat(first, np.diff(np.r_[first, len(kids)]))
        total = np.diff(np.r_[first, len(kids)])
        k = kind[kids]
        value = (k == STRING) | (k == SCALAR) | (k == OBJECT) | (k == ARRAY)
        if depth_now:
            owner_token = containers[group]
            in_object = kind[owner_token] == OBJECT
            turn = number % np.where(in_object, 4, 2)
            fine = np.where(in_object, np.select([turn == 0, turn == 1, turn == 2], [k == STRING, k == COLON, value], k == COMMA), np.where(turn == 0, value, k == COMMA))
            bad[text[kids[~fine]]] = True
            whole = np.where(in_object[first], total % 4 == 3, total % 2 == 1)
            bad[text[kids[first[~whole]]]] = True
            held = fine & value & np.where(in_object, turn == 2, turn == 0)
            parent[kids[held]] = owner_token[held]
            place[kids[held]] = (number // np.where(in_object, 4, 2))[held]
            keyed = np.flatnonzero(held & in_object)
            key_token[kids[keyed]] = kids[keyed - 2]
        else:
            bad[text[kids[first[total != 1]]]] = True
            bad[text[kids[~value]]] = True
            held = value
            parent[kids[held]] = -2  # the value of a text itself
        containers = kids[opens[kids]]
    rows = np.flatnonzero((parent != -1) & ~bad[text])
    of_token = np.full(len(start) + 1, -1, np.int64)
    of_token[rows] = np.arange(len(rows))
    above = parent[rows]
    keys = key_token[rows]
    ends = end[rows].copy()
    containers_here = opens[rows]
    ends[containers_here] = end[close_at[rows[containers_here]]]
    return Index(buffer, ~bad, text[rows], kind[rows], start[rows], ends, np.where(above == -2, -1, of_token[above]), place[rows], np.where(keys >= 0, start[keys], -1), np.where(keys >= 0, end[keys], -1), level[rows])
