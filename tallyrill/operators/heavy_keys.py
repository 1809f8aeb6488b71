"""Results for every key when a handful of keys hold most rows.

Rows are never moved by key. Each split, whatever its size and whichever keys it holds, gives its keys dense codes and
adds them up in numpy arrays (``bincount``, ``add.at``, ``minimum.at``); what moves is one block of arrays for each
split and bucket of keys. A reducer adds the blocks of its buckets, so a key of a third of all rows costs it one array
slot a split, as any other key does. A bucket's size is the number of its keys over the number of buckets; nothing is
broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrill.session import parallelism

#: Distinct keys a split holds before it hands on its arrays and starts anew; bounds the memory, not the result.
SPLIT_KEYS = 200_000

#: What each kind of measure starts from and how it is scattered into its array.
_REDUCERS = {"sum": (0, np.add.at), "min": (np.iinfo(np.int64).max, np.minimum.at), "max": (np.iinfo(np.int64).min, np.maximum.at)}


class _Accumulator:
    """Keys with dense codes, and an int64 array of each measure by code."""

    def __init__(self, kinds: Sequence[str]):
        self.kinds, self.codes, self.arrays, self.rows = kinds, {}, [np.zeros(0, np.int64) for _ in kinds], 0

    def add(self, keys: list[tuple], at: np.ndarray, values: Sequence[np.ndarray]) -> None:
        """keys: distinct; at: each row's place in keys; values: of each row, a measure a column."""
        known = np.fromiter((self.codes.setdefault(k, len(self.codes)) for k in keys), np.int64, len(keys))
        if (short := len(self.codes) - len(self.arrays[0])) > 0:
            self.arrays = [np.concatenate([a, np.full(max(short, len(a)), _REDUCERS[k][0], np.int64)]) for a, k in zip(self.arrays, self.kinds)]
        rows = known[at]
        for array, kind, value in zip(self.arrays, self.kinds, values):
            if value is None:
                array += np.bincount(rows, minlength=len(array))
            else:
                _REDUCERS[kind][1](array, rows, value)

    def take(self) -> tuple[list[tuple], list[np.ndarray]]:
        keys, arrays = list(self.codes), [a[: len(self.codes)] for a in self.arrays]
        self.codes, self.arrays = {}, [np.zeros(0, np.int64) for _ in self.kinds]
        return keys, arrays


def _encoded(columns: list[pa.Array]) -> tuple[list[tuple], np.ndarray]:
    """The distinct key tuples of a batch, and each row's place among them."""
    at, sizes, values = np.zeros(len(columns[0]), np.int64), [], []
    for column in columns:
        encoded = column.dictionary_encode(null_encoding="encode")
        values.append(encoded.dictionary.to_pylist())
        sizes.append(len(values[-1]))
        at = at * sizes[-1] + encoded.indices.to_numpy(zero_copy_only=False)
    there, at = np.unique(at, return_inverse=True)
    keys, rest = [], there.tolist()
    for code in rest:
        key = []
        for size, names in zip(reversed(sizes), reversed(values)):
            code, place = divmod(code, size)
            key.append(names[place])
        keys.append(tuple(reversed(key)))
    return keys, at


def _column(batch: pa.RecordBatch, name: str, kind: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.int64())
    return column.fill_null(_REDUCERS[kind][0]).to_numpy(zero_copy_only=False)


def heavy_key_profile(df: DataFrame, keys: Sequence[str], sums: Sequence[str] = (), mins: Sequence[str] = (), maxs: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """One row for each distinct tuple of ``keys``: the tuple, ``n_rows``, ``total_rows`` (rows of the whole table),
    then ``sum_x``, ``min_x`` and ``max_x`` of the integer columns named.

    Key columns are read as strings; null is a key of its own, apart from the empty string. Null measures add nothing;
    a minimum or maximum of nulls alone is null. An empty table gives no row. Other columns are ignored, whatever
    their names.
    """
    wide = buckets or parallelism(df.sparkSession)
    measures = [("sum", c) for c in sums] + [("min", c) for c in mins] + [("max", c) for c in maxs]
    kinds = ["sum", *(k for k, _ in measures)]
    names = ["n_rows", *(f"{k}_{c}" for k, c in measures)]
    n = len(keys)
    inner = [f"_k{i}" for i in range(n)]
    slim = df.select(*(F.col(k).cast("string").alias(i) for k, i in zip(keys, inner)), *(F.col(c).cast("bigint").alias(f"_m{i}") for i, (_, c) in enumerate(measures)))
    block = "bucket int, total bigint, " + ", ".join(f"{i} array<string>" for i in inner) + ", " + ", ".join(f"_v{i} array<bigint>" for i in range(len(kinds)))
    result = ", ".join(f"{i} string" for i in inner) + ", total_rows bigint, " + ", ".join(f"_v{i} bigint" for i in range(len(kinds)))

    def blocks(acc: _Accumulator, total: int) -> pa.RecordBatch:
        tuples, arrays = acc.take()
        bucket = np.fromiter((crc32("\x1f".join("\x00" if x is None else x for x in t).encode()) % wide for t in tuples), np.int64, len(tuples))
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(wide + 1))
        parts = [order[ends[b] : ends[b + 1]] for b in range(wide)]
        columns = [pa.array(range(wide), pa.int32()), pa.array([total] * wide, pa.int64())]
        columns += [pa.array([[tuples[i][k] for i in p] for p in parts], pa.list_(pa.string())) for k in range(n)]
        columns += [pa.array([a[p] for p in parts], pa.list_(pa.int64())) for a in arrays]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "total", *inner, *(f"_v{i}" for i in range(len(kinds)))])

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, total = _Accumulator(kinds), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            tuples, at = _encoded([batch.column(i) for i in range(n)])
            acc.add(tuples, at, [None, *(_column(batch, f"_m{i}", k) for i, (k, _) in enumerate(measures))])
            total += batch.num_rows
            if len(acc.codes) > SPLIT_KEYS:
                yield blocks(acc, total)
                total = 0
        if total:
            yield blocks(acc, total)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, totals = _Accumulator(kinds), {}
        for batch in batches:
            for b, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                totals[b] = totals.get(b, 0) + t
            flat = [batch.column(i).flatten() for i in range(2, 2 + n + len(kinds))]
            if batch.num_rows and len(flat[0]):
                tuples, at = _encoded(flat[:n])
                acc.add(tuples, at, [v.to_numpy(zero_copy_only=False) for v in flat[n:]])
        if not totals:
            return
        tuples, arrays = acc.take()
        whole = next(iter(totals.values()))  # every split tells every bucket its rows, so each bucket knows the whole
        for i in range(0, len(tuples), 10_000):
            part = tuples[i : i + 10_000]
            columns = [pa.array([t[k] for t in part], pa.string()) for k in range(n)] + [pa.array([whole] * len(part), pa.int64())]
            columns += [pa.array(a[i : i + 10_000], pa.int64()) for a in arrays]
            yield pa.RecordBatch.from_arrays(columns, names=[*inner, "total_rows", *(f"_v{j}" for j in range(len(kinds)))])

    # a bucket is a partition of its own: hashing the bucket's number would leave reducers idle and give others several
    merged = slim.mapInArrow(scatter, block).repartitionById(wide, "bucket").mapInArrow(gather, result)
    shown = [F.col(f"_v{i}") if k == "sum" else F.when(F.col(f"_v{i}") != int(_REDUCERS[k][0]), F.col(f"_v{i}")) for i, k in enumerate(kinds)]
    return merged.select(*(F.col(i).alias(k) for i, k in zip(inner, keys)), F.col("_v0").alias("n_rows"), "total_rows", *(c.alias(x) for c, x in list(zip(shown, names))[1:]))
