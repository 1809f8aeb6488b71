"""Runs of repeated consecutive events, each folded into one row.

Only boundaries are kept: an event that differs from its predecessor starts a run, and a lead over the starts gives
each run its end, since every start also carries what stood just before it. The position difference of two starts is
the run's length, and the time before the next start, less its own, its duration.

A sequence is cut into blocks of positions, so one that holds a third of all rows is many groups. Runs inside a block
are final; the first and last run of each block go through the same boundary step once more, by sequence, and are joined
where they continue. That second pass sees at most two rows a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a block.
BLOCK = 4096

_EDGE = -1


def _boundaries(df: DataFrame, group: list[str], max_gap: int, across: bool) -> DataFrame:
    """Items (first_pos, last_pos, first_at, last_at, n, sig) of each group folded where neighbours continue each other.

    across: neighbours within one block are known to be apart, so only items of different blocks can be joined.
    """
    order = Window.partitionBy(*group).orderBy("first_pos")
    seen = df.select(
        "*",
        F.lag("sig").over(order).alias("_sig"),
        F.lag("last_pos").over(order).alias("_pos"),
        F.lag("last_at").over(order).alias("_at"),
        F.lag("_block").over(order).alias("_from"),
        F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.lead("first_pos").over(order).isNull().alias("_ends"),
    )
    goes_on = F.col("_sig").eqNullSafe(F.col("sig")) & F.col("_pos").isNotNull() & (F.col("first_at") - F.col("_at") <= max_gap)
    if across:
        goes_on &= F.col("_from") != F.col("_block")
    starts = seen.withColumn("_starts", ~F.coalesce(goes_on, F.lit(False))).where("_starts or _ends")
    # the last item of a group closes its run, whether or not it starts one itself
    ahead = Window.partitionBy(*group).orderBy("first_pos")
    follows = F.lead("_starts").over(ahead)
    own = F.struct(F.col("last_pos").alias("pos"), F.col("last_at").alias("at"), (F.col("_before") + F.col("n")).alias("upto"))
    before = F.struct(F.col("_pos").alias("pos"), F.col("_at").alias("at"), F.col("_before").alias("upto"))
    end = F.when(F.col("_ends"), own).otherwise(F.when(follows, F.lead(before).over(ahead)).otherwise(F.lead(own).over(ahead)))
    return (
        starts.withColumn("_end", end)
        .where("_starts")
        .select(*dict.fromkeys([*group, "_seq", "_block"]), "sig", "first_pos", F.col("_end.pos").alias("last_pos"), "first_at", F.col("_end.at").alias("last_at"), (F.col("_end.upto") - F.col("_before")).alias("n"))
    )


def collapse_runs(df: DataFrame, sequence: str, position: str, at: str, same: list[str | Column], max_gap: int, least: int = 1, block: int = BLOCK) -> DataFrame:
    """The longest runs of neighbouring events equal in ``same`` with at most ``max_gap`` from each one's ``at`` to the
    next: (sequence, first_pos, last_pos, first_at, last_at, n_events, duration).

    Neighbours are neighbours by position; a missing position doesn't part them. Copies of a (sequence, position) count
    once, by their smallest ``at`` and values' hash. Values compare by a 64-bit hash, null equal to null. A null ``at``
    parts the event from both neighbours. Rows without sequence or position are dropped; an empty table gives no row;
    columns that aren't named are ignored, whatever their names. Runs of fewer than ``least`` events are left out.
    """
    tagged = [F.struct(F.lit(i), F.col(c) if isinstance(c, str) else c) for i, c in enumerate(same)]
    events = (
        df.where(F.col(sequence).isNotNull() & F.col(position).isNotNull())
        .select(F.col(sequence).alias("_seq"), F.col(position).cast("bigint").alias("first_pos"), F.col(at).cast("bigint").alias("first_at"), F.xxhash64(*tagged).alias("sig"))
        .groupBy("_seq", "first_pos")
        .agg(F.min("first_at").alias("first_at"), F.min("sig").alias("sig"))
        .select("_seq", F.floor(F.col("first_pos") / block).cast("bigint").alias("_block"), "first_pos", F.col("first_pos").alias("last_pos"), "first_at", F.col("first_at").alias("last_at"), F.lit(1).cast("bigint").alias("n"), "sig")
    )
    inner = _boundaries(events, ["_seq", "_block"], max_gap, across=False)
    by_block = Window.partitionBy("_seq", "_block").orderBy("first_pos")
    edged = inner.withColumn("_edge", F.lag("first_pos").over(by_block).isNull() | F.lead("first_pos").over(by_block).isNull())
    # inner runs keep to their block, edge runs meet by sequence: one pass for both
    joined = _boundaries(edged.where(F.col("_edge") | (F.col("n") >= least)).withColumn("_part", F.when(F.col("_edge"), _EDGE).otherwise(F.col("_block"))).drop("_edge"), ["_seq", "_part"], max_gap, across=True)
    return joined.where(F.col("n") >= least).select(
        F.col("_seq").alias(sequence), "first_pos", "last_pos", "first_at", "last_at", F.col("n").alias("n_events"), (F.col("last_at") - F.col("first_at")).alias("duration")
    )
