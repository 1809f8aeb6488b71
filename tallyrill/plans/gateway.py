"""Queries over the gateway log: heavy keys (p3) and features of each server (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrill.functions import keys as K
from tallyrill.operators.entity_features import entity_features, entity_type_totals, type_list
from tallyrill.operators.heavy_keys import heavy_key_profile
from tallyrill.session import table

#: Share of the log lines with both keys that a pair of keys needs to be found, in percent.
HEAVY_PERCENT = 1


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    lines = K.log_lines(table(spark, folder, "gateway_log"), server_key=K.server_key(), tool_key=K.tool_key(), at=K.epoch_nanos("timestamp"), blocked=(K.verdict() == "block").cast("bigint"))
    return heavy_key_profile(lines.where((F.col("server_key") != "") & (F.col("tool_key") != "")), ["server_key", "tool_key"], sums=["blocked"], mins=["at"], maxs=["at"])


def p3_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Lines, blocked lines, first and last time of every pair of server and tool."""
    return _pairs(spark, folder).select("server_key", "tool_key", F.col("n_rows").alias("n_lines"), F.col("sum_blocked").alias("n_blocked"), F.timestamp_micros(F.expr("min_at div 1000")).alias("first_at"), F.timestamp_micros(F.expr("max_at div 1000")).alias("last_at"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs with at least ``HEAVY_PERCENT`` of all lines that have both keys."""
    lines = K.log_lines(table(spark, folder, "gateway_log"), server_key=K.server_key(), tool_key=K.tool_key())
    both = lines.where((F.col("server_key") != "") & (F.col("tool_key") != ""))
    return heavy_key_profile(both, ["server_key", "tool_key"]).where(F.col("n_rows") * 100 >= F.col("total_rows") * HEAVY_PERCENT).select("server_key", "tool_key")


_FEATURES = {"server_key": K.server_key, "pattern": lambda: K.label("pattern_name"), "severity": lambda: K.label("severity")}


def _wide(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """The feature table of every server key, and the complete lists of patterns and severities."""
    log = table(spark, folder, "gateway_log")
    columns = {n: c() for n, c in _FEATURES.items()}
    named = log.select(*(c.alias(n) for n, c in columns.items()))
    types = type_list(named, ["pattern", "severity"])
    lines = K.log_lines(log, **columns, at=K.epoch_nanos("timestamp"))
    wide = entity_features(lines, "server_key", types, "at", F.xxhash64("session_id", "line_no"), sampled=named)
    return wide.withColumn("last_at", F.timestamp_micros(F.expr("last_at div 1000"))).withColumnRenamed("n_events", "n_lines"), types


def p5_features(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each server key with its log lines, latest time and the totals of every pattern and every severity of
    the log, zeros included, each list as one JSON text."""
    wide, types = _wide(spark, folder)
    totals = [F.to_json(F.struct(*(F.col(f"`{kind}__{name}`").alias(name) for name in names))).alias(f"{kind}_totals") if names else F.lit("{}").alias(f"{kind}_totals") for kind, names in types.items()]
    return wide.select("server_key", "n_lines", "last_at", *totals)


def p5_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a column for each pattern and severity."""
    return _wide(spark, folder)[0]


def p5_type_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The same totals as rows, with the latest time of each: one for each server key and pattern it has met. Types of
    any number fit here, where a table of columns has its bound."""
    log = table(spark, folder, "gateway_log")
    columns = {n: _FEATURES[n]() for n in ("server_key", "pattern")}
    lines = K.log_lines(log, **columns, at=K.epoch_nanos("timestamp"))
    totals = entity_type_totals(lines, "server_key", "pattern", "at", F.xxhash64("session_id", "line_no"), sampled=log.select(*(c.alias(n) for n, c in columns.items())))
    return totals.select("server_key", "pattern", F.col("n_events").alias("n_lines"), F.timestamp_micros(F.expr("last_at div 1000")).alias("last_at"))


_LINE_ROWS = """(SELECT DISTINCT session_id, line_no,
  regexp_replace(lower(coalesce(server_name, '')), '[^a-z0-9]', '', 'g') AS server_key,
  regexp_replace(lower(regexp_replace(coalesce(tool_name, ''), '^.*__', '', 's')), '[^a-z0-9]', '', 'g') AS tool_key,
  lower(trim(coalesce(pattern_name, ''))) AS pattern, lower(trim(coalesce(severity, ''))) AS severity,
  CASE WHEN lower(trim(coalesce(verdict, ''))) = 'block' THEN 1 ELSE 0 END AS blocked,
  CAST(CAST(regexp_replace(timestamp, '([.][0-9]{6})[0-9]+', '\\1') AS TIMESTAMPTZ) AS TIMESTAMP) AS line_at
  FROM gateway_log WHERE session_id IS NOT NULL AND line_no IS NOT NULL)"""

_LINES = f"WITH lines AS {_LINE_ROWS}\n"

QUERIES = {"p3_found": p3_found, "p3_profile": p3_profile, "p5_features": p5_features, "p5_columns": p5_columns, "p5_type_totals": p5_type_totals}

SQL = {
    "p3_found": _LINES + ", both_keys AS (SELECT * FROM lines WHERE server_key <> '' AND tool_key <> '') SELECT server_key, tool_key FROM both_keys GROUP BY ALL HAVING count(*) * 100 >= (SELECT count(*) FROM both_keys)",
    "p5_features": _LINES + ", servers AS (SELECT server_key, count(*) AS n_lines, max(line_at) AS last_at FROM lines GROUP BY ALL)" + "".join(
        f""", {kind}_n AS (SELECT server_key, {kind} AS name, count(*) AS n FROM lines WHERE {kind} <> '' GROUP BY ALL),
    {kind}_t AS (SELECT s.server_key, '{{' || coalesce(string_agg('"' || t.name || '":' || coalesce(n, 0), ',' ORDER BY t.name), '') || '}}' AS {kind}_totals
      FROM servers s JOIN (SELECT DISTINCT name FROM {kind}_n) t ON true LEFT JOIN {kind}_n x ON x.server_key = s.server_key AND x.name = t.name GROUP BY ALL)"""
        for kind in ("pattern", "severity")
    ) + " SELECT server_key, n_lines, last_at, pattern_totals, severity_totals FROM servers JOIN pattern_t USING (server_key) JOIN severity_t USING (server_key)",
    "p5_type_totals": _LINES + "SELECT server_key, pattern, count(*) AS n_lines, max(line_at) AS last_at FROM lines WHERE pattern <> '' GROUP BY ALL",
    "p3_profile": _LINES + "SELECT server_key, tool_key, count(*) AS n_lines, CAST(sum(blocked) AS BIGINT) AS n_blocked, min(line_at) AS first_at, max(line_at) AS last_at FROM lines WHERE server_key <> '' AND tool_key <> '' GROUP BY ALL",
}
