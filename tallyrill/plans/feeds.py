"""Queries over feeds of drifting records (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrill.operators.schema_drift import project_typed, schema_changes, settled_columns
from tallyrill.session import table

def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every change of a file's fields against the file before it in its feed."""
    return schema_changes(table(spark, folder, "feed_records"), "feed", "file_no", "record")


def p4_table(spark: SparkSession, folder: str) -> DataFrame:
    """All records of all feeds as one table: its columns come from the renames found and the types met; with what no
    column took and the values that didn't fit their column's type."""
    records, keep = table(spark, folder, "feed_records"), ["file_id", "feed", "file_no", "line_no"]
    flat = project_typed(records, "record", keep, settled_columns(records, "feed", "file_no", "record", keep))
    return flat.withColumn("failed_casts", F.to_json("failed_casts"))


QUERIES = {"p4_found": p4_found, "p4_table": p4_table}
