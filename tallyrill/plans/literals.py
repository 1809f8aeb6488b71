"""Small literal tables, written once and read by both Spark and SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def sql_text(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(sql_text, value)) + "]"
    if isinstance(value, dict):
        return f"MAP {{{', '.join(f'{sql_text(k)}: {sql_text(v)}' for k, v in value.items())}}}" if value else "MAP {}"
    return str(value)


class Literal:
    """A literal table: names with their Spark types, and rows."""

    def __init__(self, schema: str, rows: Sequence[tuple]):
        self.schema, self.rows = schema, list(rows)
        self.names = [part.split()[0] for part in schema.replace("map<string,string>", "map").split(", ")]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def sql(self) -> str:
        rows = ", ".join("(" + ", ".join(map(sql_text, row)) + ")" for row in self.rows)
        return f"(SELECT * FROM (VALUES {rows}) AS t({', '.join(self.names)}))"
