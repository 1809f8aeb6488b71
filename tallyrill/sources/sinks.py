"""Writing events, exports and states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrill.sources.eventlog import FIELDS


def without_blanks(df: DataFrame) -> DataFrame:
    """Empty strings as nulls, so that JSON leaves the fields out."""
    return df.select(*(F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def append_jsonl(df: DataFrame, path: str) -> None:
    """Appends one JSON object a line; empty fields are left out."""
    without_blanks(df).write.mode("append").option("ignoreNullFields", "true").json(path)


def as_json_array(df: DataFrame, order: str) -> DataFrame:
    """One row whose ``json`` is the array of all rows in order; ``[]`` where there are none. For results that are small
    by nature, as it is one value in one task; ``write_json_array`` writes any number."""
    rows = df.agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.struct(*df.columns).alias("row")))).alias("rows"))
    return rows.select(F.to_json(F.transform("rows", lambda r: r["row"])).alias("json"))


def csv_lines(df: DataFrame) -> DataFrame:
    """The nine exported columns of events; their context isn't exported."""
    return df.select(*FIELDS)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes inside fields are doubled."""
    csv_lines(df).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json_array(df: DataFrame, path: str, order: str) -> None:
    """One JSON array of all rows by an order column, as parts of text that make it when read one after the other; ``[]``
    where there are none. Empty fields are left out; no task holds more than its part."""
    spark = df.sparkSession
    rows = without_blanks(df).select(F.col(order).alias("_order"), F.to_json(F.struct(*df.columns)).alias("value"))
    key = F.struct(F.col("_order").isNotNull().alias("known"), "_order", "value")
    first = rows.agg(F.min(key).alias("k")).first()["k"]
    # the first element, which has no comma before it, is written with its repeats; every other one by its own task
    is_first = F.lit(False) if first is None else F.col("_order").eqNullSafe(F.lit(first["_order"])) & (F.col("value") == first["value"])
    repeats = rows.where(is_first).count()
    line = lambda n, kind, value: spark.range(n).select(F.lit(kind).alias("_kind"), F.lit(value).alias("value"))
    head = first["value"] if first is not None else ""
    ends = line(1, 0, "[" + head).unionByName(line(max(repeats - 1, 0), 1, "," + head)).unionByName(line(1, 3, "]"))
    others = rows.where(~is_first).select(F.lit(2).alias("_kind"), "_order", F.concat(F.lit(","), "value").alias("value"))
    others.unionByName(ends, allowMissingColumns=True).orderBy("_kind", F.asc_nulls_first("_order"), "value").select("value").write.mode("overwrite").text(path)


def export(df: DataFrame, path: str, form: str, order: str = "timestamp") -> None:
    """An export as a ``json`` array by an order column, or as ``csv``; any other form raises ValueError."""
    match form.strip().lower():
        case "json":
            write_json_array(df, path, order)
        case "csv":
            write_csv(df, path)
        case other:
            raise ValueError(f"unsupported export format {other!r}")


def envelope_ok(operation: Column, body: Column, allowed: tuple[str, ...] = ("sync", "evaluate", "events"), most: int = 1 << 20) -> Column:
    """Whether a broker envelope names an allowed operation and its body isn't over 1 MiB."""
    return operation.isin(list(allowed)) & (F.octet_length(body) <= most)


def acknowledged(status: Column, ok: Column, error: Column, received: Column, sent: Column, disabled: Column) -> Column:
    """What becomes of a sent batch: ``requeued`` on a failed status, ``dropped`` where uploads are disabled,
    ``requeued`` where it isn't acknowledged whole, else ``done``. A null ``received`` counts as all."""
    short = ~F.coalesce(ok, F.lit(False)) | (F.coalesce(error, F.lit("")) != "") | (F.coalesce(received, sent) < sent)
    return F.when(~F.coalesce(status.between(200, 299), F.lit(False)), "requeued").when(F.coalesce(disabled, F.lit(False)), "dropped").when(short, "requeued").otherwise("done")


def overwrite_state(df: DataFrame, path: str) -> None:
    """Replaces a state table through the committer, so that readers see the old or the new one."""
    df.write.mode("overwrite").parquet(path)


def upload_batches(send: Callable[[list[dict]], bool], size: int = 500) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that sends rows from the executors in lists of ``size``; a refused list raises, so that
    the micro-batch is tried again: at least once, in order within a partition."""

    def of_partition(rows) -> None:
        batch: list[dict] = []
        for row in rows:
            batch.append(row.asDict(recursive=True))
            if len(batch) == size:
                if not send(batch):
                    raise RuntimeError("upload refused")
                batch = []
        if batch and not send(batch):
            raise RuntimeError("upload refused")

    return lambda df, _: df.foreachPartition(of_partition)
