"""One row for each entity with its counts, recency and the totals of each of hundreds of types.

Two stages, salted: rows fold by (entity, types, salt), where only groups that hold many rows are spread over ``salts``
salts, so that light groups aren't folded in vain into as many partial rows; the partial statistics then fold by entity
into the complete list of types. Which groups are heavy is told by a sample; it decides where rows are folded, never what
they add up to.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Share of the rows from which on a group is spread, and of the table that is looked at to tell.
HEAVY_SHARE, SAMPLED = 1 / 128, 0.01


def type_list(df: DataFrame, columns: Sequence[str], most: int = 5_000) -> dict[str, list[str]]:
    """The distinct non-empty values of each type column, sorted, in one pass. At most ``most`` reach the driver: longer
    lists can't be the columns of a table, so they raise; ``entity_type_totals`` gives the same totals as rows."""
    pairs = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns))).alias("p")).select("p.column", "p.value")
    found = pairs.where("value is not null and value <> ''").distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} types; use entity_type_totals")
    return {c: sorted(value for column, value in found if column == c) for c in columns}


def heavy_groups(df: DataFrame, group: Sequence[str], share: float = HEAVY_SHARE, fraction: float = SAMPLED) -> list[int]:
    """Hashes of the groups with at least ``share`` of the rows that the 1 / ``share`` largest groups of a sample hold: no
    more groups than that, whatever the table's size."""
    sizes = df.select(F.xxhash64(*group).alias("g")).sample(fraction=fraction, seed=7).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), "g").limit(int(1 / share)).collect()
    return [r["g"] for r in most if r["n"] >= share * sum(x["n"] for x in most)]


def _salt(group: Sequence[str], heavy: Sequence[int], spread: Column, salts: int) -> Column:
    """The salt of a row: 0 but in heavy groups."""
    return F.when(F.xxhash64(*group).isin(list(heavy)), F.pmod(spread, F.lit(salts))).otherwise(F.lit(0)) if heavy else F.lit(0)


def _partial(df: DataFrame, entity: str, types: Sequence[str], at: str, spread: Column, salts: int, sampled: DataFrame | None) -> DataFrame:
    group = [entity, *types]
    salt = _salt(group, heavy_groups(df if sampled is None else sampled, group), spread, salts)
    return df.groupBy(*group, salt.alias("_salt")).agg(F.count(F.lit(1)).alias("_n"), F.max(at).alias("_last"))


def entity_type_totals(df: DataFrame, entity: str, type_column: str, at: str, spread: Column, salts: int = 16, sampled: DataFrame | None = None) -> DataFrame:
    """A row for each (entity, type) met: ``n_events`` and ``last_at``. Null types are left out, null entities kept.

    sampled: a table with the same columns from which heavy groups can be told, where ``df`` itself costs a shuffle."""
    typed = lambda x: x.where(F.col(type_column).isNotNull() & (F.col(type_column) != ""))
    partial = _partial(typed(df), entity, [type_column], at, spread, salts, sampled if sampled is None else typed(sampled))
    return partial.groupBy(entity, type_column).agg(F.sum("_n").alias("n_events"), F.max("_last").alias("last_at"))


def entity_features(df: DataFrame, entity: str, types: Mapping[str, Sequence[str]], at: str, spread: Column, salts: int = 16, sampled: DataFrame | None = None) -> DataFrame:
    """One row for each entity: ``n_events``, ``last_at`` and, for each type column and each value listed for it, a
    column ``<type column>__<value>`` with the number of events, 0 where there is none.

    A null entity is an entity; null, empty and unlisted types count only in ``n_events``. ``spread`` is any integer
    that differs from row to row, ``at`` one that orders them in time; sampled as in ``entity_type_totals``. An empty table gives no row. Columns of the table
    that aren't named are ignored.
    """
    partial = _partial(df, entity, list(types), at, spread, salts, sampled)
    # every count is a kind of value, and so is the latest time, so that one pivot expands them all
    value = lambda kind, v: F.struct(kind.alias("kind"), v.alias("value"))
    kinds = [value(F.lit("all"), F.col("_n")), value(F.lit("last"), F.col("_last")), *(F.when(F.col(c) != "", value(F.concat(F.lit(f"{c}__"), F.col(c)), F.col("_n"))) for c in types)]
    each = partial.withColumn("_last", F.col("_last").cast("bigint")).select(entity, F.explode(F.array_compact(F.array(*kinds))).alias("_x")).select(entity, F.col("_x.kind").alias("_kind"), F.col("_x.value").alias("_value"))
    names = [f"{column}__{value}" for column, values in types.items() for value in values]
    is_last = F.col("_kind") == "last"
    wide = each.groupBy(entity).pivot("_kind", ["all", "last", *names]).agg(F.coalesce(F.max(F.when(is_last, F.col("_value"))), F.sum(F.when(~is_last, F.col("_value")))))
    return wide.select(entity, F.col("all").alias("n_events"), F.col("last").alias("last_at"), *(F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(n) for n in names))
