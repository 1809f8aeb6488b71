"""Deeply nested JSON records as flat rows that keep their parents.

Texts are indexed structurally, many at once (``functions.jsonindex``). The wanted paths are then followed a step at a
time for all texts together: the spans that a step reaches, the rows they make and the positions that link them are
arrays from the index to the result. A record's rows depend on that record alone, so nothing is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrill.functions import jsonindex as J

#: Bytes of text indexed at once; a longer text is indexed alone.
INDEX_BYTES = 1 << 20

def _key(raw: bytes) -> bytes:
    if b"\\" not in raw:
        return raw[1:-1]
    return json.dumps(json.loads(raw), ensure_ascii=False)[1:-1].encode("utf-8", "surrogatepass")


def _inner(raw: bytes) -> bytes | None:
    """The text of a string that may stand for an array or object."""
    text = json.loads(raw).strip(" \t\r\n")
    return text.encode("utf-8", "surrogatepass") if text[:1] in ("[", "{") and text else None


class _Paths:
    """The wanted paths as a tree of numbered nodes: ``step[node, key]`` is the node a key leads to, -1 if none; ``path``
    is the number of the path that ends at a node, -1 if none does."""

    def __init__(self, paths: Sequence[str]):
        self.names = [*paths]
        tree: list[dict[bytes, int]] = [{}]
        ends = {}
        for number, path in enumerate(paths):
            node = 0
            for name in path.split("."):
                key = json.dumps(name, ensure_ascii=False)[1:-1].encode()
                if key not in tree[node]:
                    tree.append({})
                    tree[node][key] = len(tree) - 1
                node = tree[node][key]
            ends[node] = number
        self.keys = sorted({k for node in tree for k in node})
        self.step = np.full((len(tree), max(1, len(self.keys))), -1, np.int64)
        for node, steps in enumerate(tree):
            for key, to in steps.items():
                self.step[node, self.keys.index(key)] = to
        self.path = np.array([ends.get(n, -1) for n in range(len(tree))])
        self.inner = np.array([bool(steps) for steps in tree])


@dataclass
class _Spans:
    """Spans to visit: their row in the index, owner, node, path above (-1 for the record), positions around them, and
    whether they are a field's value or an array's element."""

    row: np.ndarray
    owner: np.ndarray
    node: np.ndarray
    above: np.ndarray
    around: pa.Array
    field: np.ndarray

    def take(self, which: np.ndarray) -> _Spans:
        return _Spans(self.row[which], self.owner[which], self.node[which], self.above[which], self.around.take(pa.array(which, pa.int64())), self.field[which])


def _below(around: pa.Array, place: np.ndarray) -> pa.Array:
    """Positions with one more behind them."""
    own = pc.cast(pa.array(place, pa.int64()), pa.string())
    return pc.if_else(pc.equal(around, ""), own, pc.binary_join_element_wise(around, own, "."))


class _Walk:
    """The rows of a batch of texts, part by part, and the JSON texts found in strings, which are indexed next."""

    def __init__(self, paths: _Paths, values: bool):
        self.paths, self.values = paths, values
        self.parts: list[tuple] = []
        self.deferred: list[tuple[bytes, int, int, int, str, bool, bytes]] = []

    def emit(self, spans: _Spans, pos: pa.Array, raw: list[bytes] | None) -> None:
        self.parts.append((spans.owner, self.paths.path[spans.node], pos, spans.above, spans.around, raw))

    def round(self, texts: list[bytes], spans: _Spans, strings: list[bytes | None]) -> None:
        """spans: one for each text, its row not yet known; strings: the string that held the text, null for payloads."""
        index = J.build(texts)
        tops = np.full(len(texts), -1, np.int64)
        at_top = np.flatnonzero(index.parent == -1)
        tops[index.text[at_top]] = at_top
        bare = np.flatnonzero((tops < 0) & spans.field & (self.paths.path[spans.node] >= 0) & np.array([s is not None for s in strings], bool))
        if len(bare):  # a string that only looked like the text of an array or object is a bare value
            own = spans.take(bare)
            self.emit(own, _below(own.around, np.zeros(len(bare), np.int64)), [strings[i] for i in bare.tolist()])
        data = np.frombuffer(index.buffer, np.uint8)
        null = (index.kind == J.SCALAR) & (data[index.start] == ord("n")) if len(index.start) else np.zeros(0, bool)
        keys = index.keys_in(self.paths.keys, _key)
        raw = lambda rows: [index.buffer[s:e] for s, e in zip(index.start[rows].tolist(), index.end[rows].tolist())] if self.values else None
        spans.row = tops
        now = spans.take(np.flatnonzero(tops >= 0))
        while len(now.row):
            now = self.step(index, now, data, null, keys, raw)

    def step(self, index: J.Index, now: _Spans, data: np.ndarray, null: np.ndarray, keys: np.ndarray, raw: Callable) -> _Spans:
        paths = self.paths
        kind, listed = index.kind[now.row], now.field & (paths.path[now.node] >= 0)
        begins = data[np.minimum(index.start[now.row] + 1, len(data) - 1)]
        held = np.zeros(len(kind), bool)
        for i in np.flatnonzero((kind == J.STRING) & (now.field | paths.inner[now.node]) & np.isin(begins, _LEADS)).tolist():
            string = index.raw(now.row[i])
            if (text := _inner(string)) is not None:
                held[i] = True
                self.deferred.append((text, int(now.owner[i]), int(now.node[i]), int(now.above[i]), now.around[i].as_py(), bool(now.field[i]), string))
        after = []

        arrays = now.take(np.flatnonzero(listed & (kind == J.ARRAY)))
        element, of = index.children(arrays.row)
        there = ~null[element]
        element, of = element[there], of[there]
        each = arrays.take(of)
        each.row = element
        pos = _below(each.around, index.place[element])
        self.emit(each, pos, raw(element))
        after.append((each, pos, np.flatnonzero(paths.inner[each.node])))

        bare = now.take(np.flatnonzero(listed & (kind != J.ARRAY) & ~null[now.row] & ~held))
        pos = _below(bare.around, np.zeros(len(bare.row), np.int64))
        self.emit(bare, pos, raw(bare.row))
        after.append((bare, pos, np.flatnonzero(paths.inner[bare.node] & (index.kind[bare.row] == J.OBJECT))))

        nexts = []
        for spans, pos, which in after:  # elements are entered under their own positions
            own = spans.take(which)
            own.above, own.around, own.field = paths.path[own.node], pos.take(pa.array(which, pa.int64())), np.zeros(len(which), bool)
            nexts.append(own)
        objects = now.take(np.flatnonzero(~listed & (kind == J.OBJECT)))
        member, of = index.children(objects.row)
        to = np.where(keys[member] >= 0, paths.step[objects.node[of], np.maximum(keys[member], 0)], -1)
        wanted = np.flatnonzero(to >= 0)
        if len(wanted):  # of a name that comes twice in an object the last counts
            order = np.lexsort((member[wanted], keys[member[wanted]], of[wanted]))
            last = np.r_[(np.diff(of[wanted][order]) != 0) | (np.diff(keys[member[wanted]][order]) != 0), True]
            wanted = wanted[order[last]]
        fields = objects.take(of[wanted])
        fields.row, fields.node, fields.field = member[wanted], to[wanted], np.ones(len(wanted), bool)
        nexts.append(fields)
        both = lambda name: np.concatenate([getattr(n, name) for n in nexts])
        return _Spans(both("row"), both("owner"), both("node"), both("above"), pa.concat_arrays([n.around for n in nexts]), both("field"))

    def columns(self) -> list[pa.Array]:
        """owner, path, pos, parent path, parent pos and value of all rows."""
        names = pa.array([*self.paths.names, ""], pa.string())
        cat = lambda i: np.concatenate([p[i] for p in self.parts])
        named = lambda i: names.take(pa.array(np.where(cat(i) < 0, len(names) - 1, cat(i)), pa.int64()))
        texts = lambda i: pa.concat_arrays([p[i].cast(pa.string()) for p in self.parts])
        value = pa.nulls(len(cat(0)), pa.string())
        if self.values:
            raw = [v for p in self.parts for v in p[5]]
            try:
                value = pa.array(raw, pa.binary()).cast(pa.string())
            except pa.ArrowInvalid:  # half a surrogate pair, escaped in a string
                value = pa.array([v.decode("utf-8", "replace") for v in raw], pa.string())
        return [pa.array(cat(0), pa.int64()), named(1), texts(2), named(3), texts(4), value]


#: First bytes of a string that may be the JSON text of an array or object: a bracket, a blank or an escape.
_LEADS = np.frombuffer(b"[{ \t\\", np.uint8)


def flatten_nested(df: DataFrame, record_id: str, payload: str, arrays: Sequence[str], values: bool = True) -> DataFrame:
    """A row for each non-null element of each array on the dotted paths ``arrays`` of a JSON payload:
    (record_id, path, pos, parent_path, parent_pos, value).

    pos: 0-based positions of the element and of the elements around it, outermost first, joined by dots; null elements
    take a position. (record_id, parent_path, parent_pos) is the pos of the row around it, or empty for the record.
    value: the element's JSON text, null where ``values`` is false. A bare value in an array field is its only element; a string that is the JSON text
    of an array or object stands for it; of a name that comes twice in an object the last counts. A null, empty or
    incomplete payload has no rows, nor has a path whose steps aren't objects. Repeated records give repeated rows.
    Other columns are ignored, whatever their names.
    """
    paths = _Paths(arrays)

    def rows_of(texts: list[bytes], owners: list[int]) -> list[pa.Array]:
        walk, n = _Walk(paths, values), len(texts)
        spans = _Spans(np.zeros(n, np.int64), np.array(owners, np.int64), np.zeros(n, np.int64), np.full(n, -1), pa.array([""] * n, pa.string()), np.ones(n, bool))
        walk.round(texts, spans, [None] * n)
        while walk.deferred:
            waiting, walk.deferred = walk.deferred, []
            texts, owner, node, above, around, field, strings = zip(*waiting)
            walk.round(list(texts), _Spans(np.zeros(len(texts), np.int64), np.array(owner), np.array(node), np.array(above), pa.array(around, pa.string()), np.array(field)), list(strings))
        return walk.columns()

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_id", "path", "pos", "parent_path", "parent_pos", "value"]
        for batch in batches:
            ids, payloads = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
            part, held = [], 0
            for i, text in enumerate([*payloads, None]):
                if text:
                    part.append((text, i))
                    held += len(text)
                if part and (held >= INDEX_BYTES or i == len(payloads)):
                    owner, *columns = rows_of([t for t, _ in part], [o for _, o in part])
                    part, held = [], 0
                    for at in range(0, len(owner), 50_000):
                        yield pa.RecordBatch.from_arrays([ids.take(owner.slice(at, 50_000)), *(c.slice(at, 50_000) for c in columns)], names=names)

    kind = df.schema[record_id].dataType.simpleString()
    slim = df.select(F.col(record_id).alias("_id"), F.col(payload).alias("_payload")).where("_payload is not null")
    flat = slim.mapInArrow(flatten, f"_id {kind}, path string, pos string, parent_path string, parent_pos string, value string")
    return flat.withColumnRenamed("_id", record_id)
