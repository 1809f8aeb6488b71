"""What changed between consecutive full snapshots of many sources.

Items move as numbers only: the hashes of source, item key and item values, with the snapshot's number in its source.
They are spread over hash buckets of source and item, so neither a source of a third of all rows nor a long history is
one task. Each bucket sorts its arrays in numpy and finds with ``searchsorted`` which (item, snapshot) has no
counterpart one snapshot before or after.

Full keys are retrieved only for items that differ somewhere: a bitmap of their hashes, of a fixed size, goes to every
scan task, and of the items it lets through each distinct one moves once a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrill.operators.ordering import ordered_positions
from tallyrill.session import cut, parallelism

#: Items a hash bucket holds on average, whose arrays are in memory at once; and fewest buckets for each shuffle partition.
BUCKET_ITEMS, BUCKETS_EACH = 1 << 20, 2

#: Bits of the bitmap of differing items, 4 MiB; where more items differ it lets more through, which a join sorts out.
BITMAP_BITS = 1 << 25

#: Parts an item's changes are spread over when its key is looked up.
SALTS = 8

_CHANGES = np.array(["added", "removed", "changed"])


def _bucket_changes(table: pa.Table) -> pa.Table:
    col = lambda name: table.column(name).combine_chunks().to_numpy(zero_copy_only=False)
    source, item, pos, row, mark = (col(c) for c in ("source_hash", "item_hash", "pos", "row_hash", "item_mark"))
    own, later = col("snapshot_id"), table.column("next_snapshot_id").combine_chunks()
    has_next, later = later.is_valid().to_numpy(zero_copy_only=False), later.fill_null(0).to_numpy(zero_copy_only=False)

    # each (source, item) gets a number, and (number, position) is one sorted int64 key
    order = np.lexsort((row, pos, item, source))
    source, item, pos, row, mark, own, later, has_next = (a[order] for a in (source, item, pos, row, mark, own, later, has_next))
    new = np.ones(len(pos), bool)
    new[1:] = (source[1:] != source[:-1]) | (item[1:] != item[:-1])
    number = np.cumsum(new) - 1
    width = int(pos.max()) + 3
    key = number * width + pos
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    fresh = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])]
    values = np.add.reduceat(np.where(fresh, row, 0), first)  # repeated items count once; several values of a key add up
    key, pos, own, later, has_next = (a[first] for a in (key, pos, own, later, has_next))
    number_of = number[first]

    def place(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(key, wanted)
        return at, (at < len(key)) & (key[np.minimum(at, len(key) - 1)] == wanted)

    before, has_before = place(key - 1)
    _, has_after = place(key + 1)
    added = (pos > 1) & ~has_before
    changed = has_before & (values != values[np.maximum(np.minimum(before, len(key) - 1), 0)])
    removed = has_next & ~has_after
    parts = [(added, 0, own), (removed, 1, later), (changed, 2, own)]
    pick = np.concatenate([np.flatnonzero(m) for m, _, _ in parts])
    return pa.table({
        "item_hash": item[np.flatnonzero(new)][number_of[pick]],
        "item_mark": mark[np.flatnonzero(new)][number_of[pick]],
        "snapshot_id": np.concatenate([s[m] for m, _, s in parts]),
        "change": pa.array(np.concatenate([np.repeat(_CHANGES[c], int(m.sum())) for m, c, _ in parts]).tolist(), pa.string()),
    })


def _bitmap(hashes: DataFrame, column: str) -> DataFrame:
    """(word, bits) of the hashes' places in a bitmap of ``BITMAP_BITS`` bits: at most 1,024 rows of 4 KiB."""
    place = F.pmod(column, F.lit(BITMAP_BITS))
    return hashes.groupBy(F.bitmap_bucket_number(place).alias("word")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))


def _within(rows: DataFrame, column: str, bitmap: DataFrame) -> DataFrame:
    """The rows whose hash has its bit set; narrow, as the bitmap has a fixed size and is broadcast."""
    place = F.pmod(column, F.lit(BITMAP_BITS))
    at = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    joined = rows.withColumn("_word", F.bitmap_bucket_number(place)).join(F.broadcast(bitmap), F.col("_word") == F.col("word"))
    return joined.where(F.call_function("shiftright", byte, F.pmod(at, F.lit(8))).bitwiseAND(F.lit(1)) == 1).select(*rows.columns)


def snapshot_changes(snapshots: DataFrame, items: DataFrame, key: Sequence[str], values: Sequence[str], block: Column, buckets: int | None = None, single: bool = False) -> DataFrame:
    """Items added, removed or changed from each snapshot to the next of its source: (snapshot_id, *key, change).

    snapshots: (source, taken_at, snapshot_id bigint), one row for each snapshot that counts, empty ones included; the
    first of a source reports nothing. Rows with a null source, time or id are dropped. Snapshots of a source with one
    time are copies: the smallest id stands for them; single: there are none, so they needn't be looked for.
    items: (snapshot_id, *key, *values), a row for each item; repeated items count once, nulls equal nulls. An item
    with several values in a snapshot is changed where their set differs.
    block: non-decreasing in taken_at; cuts long histories, see ``ordered_positions``.
    """
    known = snapshots.where("source is not null and taken_at is not null and snapshot_id is not null")
    if not single:
        known = known.groupBy("source", "taken_at").agg(F.min("snapshot_id").alias("snapshot_id"))
    chain = ordered_positions(known, ["source"], ["taken_at"], block, "snapshot_id").select("snapshot_id", "pos", "next_snapshot_id", F.xxhash64("source").alias("source_hash"))
    # a place in front of each field tells a null from the next field's value; two hashes of 96 bits together name an item
    tagged = lambda of, names: of(*(F.struct(F.lit(i), F.col(n)) for i, n in enumerate(names)))
    marks = [tagged(F.xxhash64, key).alias("item_hash"), tagged(F.hash, key).alias("item_mark")]
    if buckets is None:
        buckets = max(parallelism(snapshots.sparkSession) * BUCKETS_EACH, -(-items.count() // BUCKET_ITEMS))
    hashed = items.select("snapshot_id", *marks, tagged(F.xxhash64, values).alias("row_hash"))
    numbered = hashed.join(chain, "snapshot_id").withColumn("bucket", F.pmod(F.hash("source_hash", "item_hash"), F.lit(buckets)))
    differ = cut(numbered.groupBy("bucket").applyInArrow(_bucket_changes, "item_hash bigint, item_mark int, snapshot_id bigint, change string"))

    named = items.select(*marks, *(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)))
    wanted = _within(named, "item_hash", _bitmap(differ, "item_hash")).distinct()
    salted = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return differ.withColumn("_salt", F.pmod(F.hash("snapshot_id"), F.lit(SALTS))).join(salted, ["item_hash", "item_mark", "_salt"]).select("snapshot_id", *(F.col(f"_k{i}").alias(k) for i, k in enumerate(key)), "change")
