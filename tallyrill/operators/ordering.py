"""Positions and neighbours inside ordered groups, without putting a group into one task.

A group is cut into blocks of its order value. Blocks are numbered on their own; one small row a block then carries
counts and last rows from block to block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_positions(df: DataFrame, group: Sequence[str], order: Sequence[str], block: Column, carry: str) -> DataFrame:
    """``df`` with ``pos`` (1 for the first row of each group), ``prev_x`` and ``next_x``: column ``carry`` of the row
    before and after, null at the ends.

    block: non-decreasing in the order. Ties in ``order`` are numbered arbitrarily; null group values are a group.
    """
    keyed = df.withColumn("_block", block)
    inside = Window.partitionBy(*group, "_block").orderBy(*order)
    numbered = keyed.select("*", F.row_number().over(inside).alias("_at"), F.lag(carry).over(inside).alias("_prev"), F.lead(carry).over(inside).alias("_next"), F.lead(F.lit(1)).over(inside).isNull().alias("_ends"))
    ends = numbered.where("_ends or _at = 1")
    summary = ends.groupBy(*group, "_block").agg(F.max("_at").alias("_rows"), F.max(F.when(F.col("_at") == 1, F.col(carry))).alias("_first"), F.max(F.when(F.col("_ends"), F.col(carry))).alias("_last"))
    across = Window.partitionBy(*group).orderBy("_block")
    linked = summary.select(*(F.col(g).alias(f"_g_{g}") for g in group), F.col("_block").alias("_b"), F.coalesce(F.sum("_rows").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_skip"), F.lag("_last").over(across).alias("_prev_block"), F.lead("_first").over(across).alias("_next_block"))
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group] + [F.col("_block").eqNullSafe(F.col("_b"))]
    condition = same[0]
    for term in same[1:]:
        condition &= term
    return numbered.join(linked, condition).select(
        *df.columns,
        (F.col("_skip") + F.col("_at")).alias("pos"),
        F.when(F.col("_at") == 1, F.col("_prev_block")).otherwise(F.col("_prev")).alias(f"prev_{carry}"),
        F.when(F.col("_ends"), F.col("_next_block")).otherwise(F.col("_next")).alias(f"next_{carry}"),
    )
