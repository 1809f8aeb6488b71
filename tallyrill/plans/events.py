"""Queries over the event log: filters, tails, exports, last calls, backend health."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrill.functions import keys as K
from tallyrill.functions.servers import namespaced, original_tool
from tallyrill.operators.inventory import AUTH_ERROR, backend_health, health_detail, health_summary, keep_first, namespaced_tools, tool_cache_summary
from tallyrill.plans.literals import Literal, sql_text
from tallyrill.session import checkpoint_dir, table
from tallyrill.sources import eventlog, sinks

SINCE = "2026-03-01"
TAIL = 20

#: Answers to uploads: HTTP status, body's fields, rows sent.
ACKS = Literal(
    "ack_id int, status int, ok boolean, error string, received int, sent int, disabled boolean",
    [(1, 200, True, None, 5, 5, False), (2, 200, True, None, 4, 5, False), (3, 200, True, "", None, 5, None), (4, 500, True, None, 5, 5, False), (5, 200, False, None, 5, 5, False), (6, 200, True, "no", 5, 5, False), (7, 200, True, None, 0, 5, True), (8, 503, None, None, None, 5, True), (9, 204, None, None, None, 0, None)],
)
ENVELOPES = Literal("envelope_id int, operation string, body string", [(1, "sync", "{}"), (2, "evaluate", "x"), (3, "events", ""), (4, "delete", "{}"), (5, "", "")])
STATUSES = Literal("server string, status string", [("audiokiln", "ready"), ("graphmill", "degraded"), ("nowhere", "degraded"), ("stockbridge", "degraded")])


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """The log with absent fields as empty strings; delivery order is the order of log_id."""
    log = table(spark, folder, "gateway_log")
    return log.select("log_id", *(K.text(f).alias(f) for f in eventlog.FIELDS))


def events_since(spark: SparkSession, folder: str) -> DataFrame:
    """Events since a day, counted by their kind."""
    return eventlog.since(_events(spark, folder), SINCE).groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"), F.min("log_id").alias("first_log_id"), F.max("log_id").alias("last_log_id"))


def events_tail(spark: SparkSession, folder: str) -> DataFrame:
    return eventlog.tail(_events(spark, folder), TAIL, "log_id").select("log_id", *eventlog.FIELDS)


def last_call_per_server(spark: SparkSession, folder: str) -> DataFrame:
    return eventlog.last_per_server(_events(spark, folder), "log_id")


def ingest_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Events that would be uploaded, counted by verdict as it is spelled."""
    return eventlog.uploadable(_events(spark, folder)).groupBy("event_type", "verdict").agg(F.count(F.lit(1)).alias("n_events"))


def export_csv_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The exported columns of the findings."""
    return sinks.csv_lines(_events(spark, folder).where(F.lower("event_type").contains("threat_detected")))


def export_json(spark: SparkSession, folder: str) -> DataFrame:
    """The findings' JSON lines, empty fields left out."""
    findings = sinks.without_blanks(_events(spark, folder).where(F.lower("event_type").contains("threat_detected")))
    return findings.select("log_id", F.to_json(F.struct(*eventlog.FIELDS)).alias("json"))


def _written(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/log-{uuid.uuid4().hex}"


def log_strict(spark: SparkSession, folder: str) -> DataFrame:
    """The whole log written as JSON lines in two appends and read back strictly, counted."""
    path, events = _written(spark), _events(spark, folder)
    for part in (0, 1):
        sinks.append_jsonl(events.where(F.col("log_id") % 2 == part).select(*eventlog.FIELDS), path)
    return eventlog.read_strict(spark, path).groupBy("event_type", "verdict").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("severity") == "").alias("n_without_severity"))


def log_lenient(spark: SparkSession, folder: str) -> DataFrame:
    """The whole log written as lines of which each fiftieth is broken, and read back leniently, counted."""
    path = _written(spark)
    line = F.to_json(F.struct(*eventlog.FIELDS))
    _events(spark, folder).select(F.when(F.col("log_id") % 50 == 0, F.concat(F.lit("{broken"), line)).otherwise(line).alias("value")).write.text(path)
    return eventlog.read_lenient(spark, path).groupBy("event_type", "verdict").agg(F.count(F.lit(1)).alias("n_events"))


def exported_array(spark: SparkSession, folder: str) -> DataFrame:
    """The findings exported as one JSON array and read back as one document."""
    path = _written(spark)
    sinks.export(_events(spark, folder).where(F.lower("event_type").contains("threat_detected")).select("log_id", *eventlog.FIELDS), path, "json", "log_id")
    return spark.read.text(path).where("length(value) > 1").select(F.from_json(F.substring("value", 2, 1 << 30), "log_id bigint, pattern_name string, severity string").alias("e")).select("e.*")


def event_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Events built anew from log lines, by the verdict they end up with."""
    log = table(spark, folder, "gateway_log").where(K.event_type() == "tool_call")
    detection = F.struct(F.col("verdict"), F.col("severity"), F.col("pattern_name"), F.col("category"), F.col("description"))
    return log.select(eventlog.make_event("tool_call", F.col("timestamp"), F.col("server_name"), F.col("tool_name"), detection).alias("e")).groupBy(F.col("e.event_type").alias("event_type"), F.col("e.verdict").alias("verdict"), F.col("e.severity").alias("severity")).agg(F.count(F.lit(1)).alias("n_events"))


def _backends(spark: SparkSession, folder: str) -> DataFrame:
    """Each server entry's first registration by name."""
    return keep_first(table(spark, folder, "server_entries"), ["name"], ["entry_id"]).select("name", "transport", "url", "headers")


def backend_health_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every backend with its status and what is to be said about it."""
    health = backend_health(_backends(spark, folder), last_call_per_server(spark, folder))
    return health.withColumn("detail", health_detail())


def backend_health_summary(spark: SparkSession, folder: str) -> DataFrame:
    return health_summary(backend_health(_backends(spark, folder), last_call_per_server(spark, folder)))


def upload_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    acks = ACKS.frame(spark)
    return acks.select("ack_id", sinks.acknowledged(*(F.col(c) for c in ("status", "ok", "error", "received", "sent", "disabled"))).alias("outcome"))


def broker_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    return ENVELOPES.frame(spark).select("envelope_id", sinks.envelope_ok(F.col("operation"), F.col("body")).alias("accepted"))


def _cache(spark: SparkSession, folder: str) -> DataFrame:
    tools = table(spark, folder, "tool_catalog").select(K.server_key().alias("server"), F.substring_index("tool_name", "__", -1).alias("tool"))
    return tools.where("server <> '' and tool is not null").groupBy("server").agg(F.array_sort(F.collect_set("tool")).alias("tools"))


def tool_namespace(spark: SparkSession, folder: str) -> DataFrame:
    """Every tool under its server's name, with the name it goes back to."""
    named = namespaced_tools(_cache(spark, folder))
    return named.select("tool", "server", original_tool(F.col("server"), F.col("tool")).alias("original"))


def tool_summary(spark: SparkSession, folder: str) -> DataFrame:
    return tool_cache_summary(_cache(spark, folder), STATUSES.frame(spark))


QUERIES = {f.__name__: f for f in (events_since, events_tail, last_call_per_server, ingest_filter, export_csv_rows, export_json, log_strict, log_lenient, exported_array, event_rows, backend_health_rows, backend_health_summary, upload_outcomes, broker_envelopes, tool_namespace, tool_summary)}

_EVENTS = "(SELECT log_id, " + ", ".join(f"coalesce({f}, '') AS {f}" for f in eventlog.FIELDS) + " FROM gateway_log)"
_LAST = f"(SELECT server_name, max_by(timestamp, log_id) AS last_call_at, max_by(tool_name, log_id) AS last_tool_name FROM {_EVENTS} WHERE event_type = 'mcp.tool_call' AND server_name <> '' GROUP BY server_name)"
_HEALTH = f"""WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY entry_id) AS rn FROM server_entries) WHERE rn = 1),
  t AS (SELECT name, url, CASE WHEN lower(trim(coalesce(transport, ''))) IN ('http', 'sse', 'streamable-http') THEN 'http' WHEN trim(coalesce(transport, '')) <> '' THEN lower(trim(transport)) WHEN trim(coalesce(url, '')) <> '' THEN 'http' ELSE 'stdio' END AS transport,
    len(list_filter(map_entries(coalesce(headers, MAP {{}})), lambda e: lower(trim(e.key)) = 'authorization' AND trim(coalesce(e.value, '')) <> '')) > 0 AS auth FROM b),
  h AS (SELECT t.name, transport, CASE WHEN l.server_name IS NOT NULL THEN 'calls_observed' WHEN transport = 'http' AND NOT auth AND regexp_matches(lower(coalesce(url, '')), 'mcp[.]notion[.]com|mcp[.]raindrop[.]ai|mcp[.]linear[.]app') THEN 'auth_required'
    WHEN transport = 'http' AND auth THEN 'auth_configured' ELSE 'pending' END AS status, coalesce(last_call_at, '') AS last_call_at, coalesce(last_tool_name, '') AS last_tool_name FROM t LEFT JOIN {_LAST} l ON t.name = l.server_name)
"""
_TOOLS = "(SELECT DISTINCT regexp_replace(lower(coalesce(server_name, '')), '[^a-z0-9]', '', 'g') AS server, regexp_replace(tool_name, '^.*__', '') AS original FROM tool_catalog WHERE tool_name IS NOT NULL AND regexp_replace(lower(coalesce(server_name, '')), '[^a-z0-9]', '', 'g') <> '')"

SQL = {
    "events_since": f"SELECT event_type, count(*) AS n_events, min(log_id) AS first_log_id, max(log_id) AS last_log_id FROM {_EVENTS} WHERE TRY_CAST(regexp_replace(timestamp, '([.][0-9]{{6}})[0-9]+', '\\1') AS TIMESTAMPTZ) >= TIMESTAMPTZ '{SINCE} 00:00:00+00' GROUP BY ALL",
    "events_tail": f"SELECT * FROM {_EVENTS} ORDER BY log_id DESC LIMIT {TAIL}",
    "last_call_per_server": f"SELECT * FROM {_LAST}",
    "ingest_filter": f"SELECT event_type, verdict, count(*) AS n_events FROM {_EVENTS} WHERE server_name <> '' AND tool_name <> '' GROUP BY ALL",
    "export_csv_rows": f"SELECT {', '.join(eventlog.FIELDS)} FROM {_EVENTS} WHERE contains(lower(event_type), 'threat_detected')",
    "export_json": f"SELECT log_id, '{{' || concat_ws(',', " + ", ".join(f"CASE WHEN {f} <> '' THEN '\"{f}\":' || to_json({f}) END" for f in eventlog.FIELDS) + f") || '}}' AS json FROM {_EVENTS} WHERE contains(lower(event_type), 'threat_detected')",
    "log_strict": f"SELECT event_type, verdict, count(*) AS n_events, count(*) FILTER (severity = '') AS n_without_severity FROM {_EVENTS} GROUP BY ALL",
    "log_lenient": f"SELECT event_type, verdict, count(*) AS n_events FROM {_EVENTS} WHERE log_id % 50 <> 0 GROUP BY ALL",
    "exported_array": f"SELECT log_id, nullif(pattern_name, '') AS pattern_name, nullif(severity, '') AS severity FROM {_EVENTS} WHERE contains(lower(event_type), 'threat_detected')",
    "event_rows": f"SELECT 'mcp.tool_call' AS event_type, CASE WHEN verdict = '' THEN 'pass' ELSE verdict END AS verdict, severity, count(*) AS n_events FROM {_EVENTS} WHERE regexp_replace(lower(event_type), '^.*[.]', '') = 'tool_call' GROUP BY ALL",
    "backend_health_rows": _HEALTH + f"""SELECT *, CASE WHEN status = 'auth_required' THEN {sql_text(AUTH_ERROR)} ELSE '' END AS error, CASE WHEN status = 'auth_required' THEN {sql_text(AUTH_ERROR)} WHEN last_tool_name <> '' AND last_call_at <> '' THEN 'last call ' || last_tool_name || ' at ' || last_call_at
      WHEN last_call_at <> '' THEN 'last call at ' || last_call_at ELSE '' END AS detail FROM h""",
    "backend_health_summary": _HEALTH + """SELECT backends, pending, auth_required, auth_configured, calls_observed, 0 AS tools_observed, 0 AS unreachable, CASE WHEN backends = 0 THEN 'unknown' WHEN auth_required > 0 THEN 'action_required' WHEN calls_observed > 0 THEN 'observed' ELSE 'pending' END AS manifest_status
      FROM (SELECT count(*) AS backends, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'auth_required') AS auth_required, count(*) FILTER (status = 'auth_configured') AS auth_configured, count(*) FILTER (status = 'calls_observed') AS calls_observed FROM h)""",
    "upload_outcomes": f"SELECT ack_id, CASE WHEN status < 200 OR status > 299 THEN 'requeued' WHEN coalesce(disabled, false) THEN 'dropped' WHEN NOT coalesce(ok, false) OR coalesce(error, '') <> '' OR coalesce(received, sent) < sent THEN 'requeued' ELSE 'done' END AS outcome FROM {ACKS.sql()}",
    "broker_envelopes": f"SELECT envelope_id, operation IN ('sync', 'evaluate', 'events') AS accepted FROM {ENVELOPES.sql()}",
    "tool_namespace": f"SELECT server || '__' || original AS tool, server, original FROM {_TOOLS}",
    "tool_summary": f"SELECT count(DISTINCT server) AS backends, count(*) AS tools, (SELECT count(*) FROM {STATUSES.sql()} WHERE status = 'degraded' AND server IN (SELECT server FROM {_TOOLS})) AS degraded FROM {_TOOLS}",
}
