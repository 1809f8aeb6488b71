"""Queries over posture scans and check-ins as flat related tables (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrill.operators.nested import flatten_nested
from tallyrill.session import spread, table

#: The array fields of a scan's payload.
SCAN_ARRAYS = (
    "checks", "checks.evidence.names", "raw_report.mcp_servers", "raw_report.mcp_servers.env_keys", "raw_report.mcp_servers.sensitive_env_names",
    "raw_report.egress.allowed_domains", "raw_report.extensions.examples", "raw_report.extensions.examples.dangerous_tools",
    "raw_report.plugins.enabled_plugin_name_hashes", "raw_report.hooks.hook_names", "raw_report.skills.examples", "raw_report.cookies.files", "raw_report.unreadable",
)


def p6_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Every element of every array of every scan, with its parent and its JSON text."""
    return flatten_nested(spread(table(spark, folder, "posture_scans").select("scan_id", "payload")), "scan_id", "payload", SCAN_ARRAYS)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Where every element of every array of every scan stands."""
    scans = spread(table(spark, folder, "posture_scans").select("scan_id", "payload"))
    return flatten_nested(scans, "scan_id", "payload", SCAN_ARRAYS, values=False).select("scan_id", "path", "pos")


def p6_checks(spark: SparkSession, folder: str) -> DataFrame:
    """The table of checks: a row for each check that is an object, with its scan and position."""
    fields = "status string, check_name string, detail string, source string, category string, severity string"
    checks = p6_elements(spark, folder).where("path = 'checks'").withColumn("check", F.from_json("value", fields))
    return checks.select("scan_id", F.col("pos").alias("check_pos"), "check.*")


def p6_checkin_items(spark: SparkSession, folder: str) -> DataFrame:
    """The skills and servers of every check-in as one table of items that point to their check-in and position."""
    checkins = table(spark, folder, "checkins")
    item = lambda kind, column, *own: checkins.select("checkin_id", F.posexplode(column).alias("pos", "i")).where("i is not null").select(
        "checkin_id", F.lit(kind).alias("item_kind"), "pos", "i.name", "i.source", "i.platform", *(F.col(f"i.{c}") if c in own else F.lit(None).cast("string").alias(c) for c in ("hash", "preview", "type", "command"))
    )
    return item("skill", "installed_skills", "hash", "preview").unionByName(item("server", "installed_mcp_servers", "type", "command"))


_ITEM = "SELECT checkin_id, '{0}' AS item_kind, CAST(g - 1 AS INTEGER) AS pos, i.name, i.source, i.platform, {2} FROM (SELECT checkin_id, unnest({1}) AS i, generate_subscripts({1}, 1) AS g FROM checkins) WHERE i IS NOT NULL"

#: The checks of readable scans: of an array, of the JSON text of one, or a bare value as the only one.
CHECKS_SQL = """(WITH j AS (SELECT scan_id, json_extract(CASE WHEN json_valid(payload) THEN payload END, '$.checks') AS c FROM posture_scans),
  o AS (SELECT scan_id, CASE WHEN json_type(c) = 'VARCHAR' AND ltrim(c->>'$')[1] IN ('[', '{') THEN coalesce(TRY_CAST(c->>'$' AS JSON), c) ELSE c END AS c FROM j WHERE c IS NOT NULL AND json_type(c) <> 'NULL'),
  e AS (SELECT scan_id, unnest(CASE WHEN json_type(c) = 'ARRAY' THEN json_extract(c, '$[*]') ELSE [c] END) AS e, generate_subscripts(CASE WHEN json_type(c) = 'ARRAY' THEN json_extract(c, '$[*]') ELSE [c] END, 1) - 1 AS pos FROM o)
  SELECT scan_id, CAST(pos AS VARCHAR) AS check_pos, e->>'status' AS status, e->>'check_name' AS check_name, e->>'detail' AS detail, e->>'source' AS source, e->>'category' AS category, e->>'severity' AS severity FROM e WHERE json_type(e) <> 'NULL')"""

QUERIES = {"p6_found": p6_found, "p6_elements": p6_elements, "p6_checks": p6_checks, "p6_checkin_items": p6_checkin_items}

SQL = {
    "p6_checks": f"SELECT * FROM {CHECKS_SQL}",
    "p6_checkin_items": _ITEM.format("skill", "installed_skills", "i.hash, i.preview, NULL::VARCHAR AS type, NULL::VARCHAR AS command")
    + " UNION ALL " + _ITEM.format("server", "installed_mcp_servers", "NULL::VARCHAR AS hash, NULL::VARCHAR AS preview, i.type, i.command"),
}
