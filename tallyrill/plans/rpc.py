"""Queries over JSON-RPC lines, results, server-sent events and request correlation."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrill.functions import keys as K
from tallyrill.functions import servers as S
from tallyrill.operators.inventory import keep_first
from tallyrill.plans.literals import Literal
from tallyrill.session import table
from tallyrill.sources import configs, rpc

BODIES = Literal(
    "body_id int, body string, wanted int",
    [(1, '{"jsonrpc":"2.0","id":7,"result":{"a":1}}', 7), (2, '{"id":8,"result":{}}', 7), (3, '{"id":7,"error":{"code":1,"message":"no"}}', 7), (4, '{"id":7}', 7), (5, "{", 7), (6, '{"result":{"b":2}}', 7), (7, "", 7), (8, None, 7), (9, '{"id":7,"error":{"code":2}}', 7), (10, "[1]", 7)],
)
STREAMS = Literal(
    "stream_id int, stream string",
    [(1, 'event: m\ndata: {"id":7,"result":{"a":1}}\n\ndata: [DONE]\n'), (2, 'data: {"id":9,"result":{"x":0}}\r\ndata:{"id":7,"result":{"y":1}}\r\n'), (3, "data:\ndata: [DONE]"), (4, ""), (5, None), (6, 'data: nonsense\ndata: {"id":7,"error":{"message":"m"}}')],
)
ANSWERS = Literal(
    "answer_id int, status int, kind string, body string",
    [(1, 202, "", "x"), (2, 401, "application/json", '{"id":7,"result":{"ok":1}}'), (3, 500, "text/html", '{"id":7,"result":{}}'), (4, 200, "Text/Event-Stream; charset=utf-8", 'data: {"id":7,"result":{"s":1}}'), (5, 200, "application/json", '{"id":7,"result":{"t":1}}'), (6, 200, None, '{"id":6,"result":{}}'), (7, 404, "application/json", "{")],
)
LINES = Literal("line_no int, line string", [(1, '{"jsonrpc":"2.0","id":1,"method":"tools/call","params":{"n":1}}'), (2, "   "), (3, "plain words"), (4, '{"method":"notifications/initialized"}'), (5, '{"id":1,"result":{}}'), (6, '{"id":2,"method":"x/y"}'), (7, "[1,2]"), (8, '{"id":3,"method":"initialize"}')])
SETTINGS = Literal("row_id int, file string, env string", [(1, "f", "e"), (2, " ", "e"), (3, None, None), (4, "", "  "), (5, None, "e")])
_PROJECTS = {p: {"mcpServers": {f"srv{i}": {"command": "c"}}} for i, p in enumerate(("/w", "/w/app", "/w/app/sub", "/other", "/w/application"))}
USER_CONFIGS = Literal("config string, text string", [("one", json.dumps({"projects": _PROJECTS})), ("two", json.dumps({"projects": {k: v for k, v in _PROJECTS.items() if k != "/w/app"}})), ("three", "{"), ("four", "{}")])
SESSIONS = Literal("session string, text string", [("s1", '{"remoteMcpServersConfig":[{"uuid":"u1","name":"My Docs","url":"https://docs.example","headers":{"Authorization":"x"}},{"uuid":"u2","name":"","url":" "}]}'), ("s2", '{"remoteMcpServersConfig":[{"uuid":"u1","name":"My Docs","url":"https://docs.example"}]}'), ("s3", "[]")])
_START = datetime(2026, 1, 1)
_WAITS = [("tools/call", 59), ("tools/call", 61), ("tools/list", 20), ("tools/list", 21), ("ping", 8), ("ping", 9), ("initialize", -1)]


def rpc_results(spark: SparkSession, folder: str) -> DataFrame:
    return BODIES.frame(spark).select("body_id", rpc.parse_result(F.col("body"), F.col("wanted")).alias("r")).select("body_id", "r.result", "r.error")


def sse_results(spark: SparkSession, folder: str) -> DataFrame:
    streams = STREAMS.frame(spark)
    return streams.select("stream_id", F.size(rpc.sse_payloads(F.col("stream"))).alias("n_payloads"), rpc.sse_result(F.col("stream"), F.lit(7)).alias("result"))


def http_results(spark: SparkSession, folder: str) -> DataFrame:
    return ANSWERS.frame(spark).select("answer_id", rpc.http_outcome(F.col("status"), F.col("kind"), F.col("body"), F.lit(7)).alias("result"))


def rpc_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as messages and what is passed through, with the branch each takes."""
    read = rpc.read_messages(LINES.frame(spark), "line")
    return read.select("line_no", "passthrough", F.when(~F.col("passthrough"), rpc.method_branch(F.col("message"))).otherwise("").alias("branch"))


def jsonrpc_correlate(spark: SparkSession, folder: str) -> DataFrame:
    """Requests with the responses that came within their method's time."""
    requests = spark.createDataFrame([("s", str(i), m, _START) for i, (m, _) in enumerate(_WAITS)] + [("s", "9", "ping", _START), ("t", "0", "ping", _START)], "server string, id string, method string, at timestamp")
    responses = spark.createDataFrame([("s", str(i), "{}", _START + timedelta(seconds=w)) for i, (_, w) in enumerate(_WAITS)] + [("s", None, "{}", _START)], "server string, id string, result string, at timestamp")
    return rpc.correlate(requests, responses).select("server", "id", "method", "timed_out")


def settings_origin(spark: SparkSession, folder: str) -> DataFrame:
    rows = SETTINGS.frame(spark)
    return rows.select("row_id", configs.setting(F.col("file"), F.col("env"), F.lit("d")).alias("s"), configs.first_path(F.col("file"), F.col("env"), F.lit("/etc/d")).alias("path")).select("row_id", "s.value", "s.origin", "path")


def _scan_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Every scan's payload as the result of a response; each fifth answers another request, each seventh has an error."""
    scans = table(spark, folder, "posture_scans").select("scan_id", F.coalesce("payload", F.lit("null")).alias("p"))
    error = F.when(F.col("scan_id") % 7 == 0, ',"error":{"code":1,"message":"refused"}').otherwise("")
    return scans.select("scan_id", F.concat(F.lit('{"id":'), F.col("scan_id") + (F.col("scan_id") % 5 == 0).cast("int"), error, F.lit(',"result":'), F.regexp_replace("p", "[\\r\\n]", " "), F.lit("}")).alias("body"))


def rpc_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Every scan read as a response by itself, as a server-sent event and as an HTTP answer: the machine it tells, and
    the error."""
    bodies, wanted = _scan_bodies(spark, folder), F.col("scan_id")
    stream = F.concat(F.lit("event: m\ndata: {\ndata: "), F.col("body"), F.lit("\n\ndata: [DONE]\n"))
    status, kind = F.when(wanted % 3 == 0, 500).otherwise(200), F.when(wanted % 2 == 0, "application/json").otherwise("text/event-stream")
    read = bodies.select("scan_id", rpc.parse_result(F.col("body"), wanted).alias("r"), rpc.sse_result(stream, wanted).alias("s"), rpc.http_outcome(status, kind, F.when(wanted % 2 == 0, F.col("body")).otherwise(stream), wanted).alias("h"))
    machine = lambda c: F.get_json_object(c, "$.machine_id")
    return read.select("scan_id", "r.error", machine("r.result").alias("machine"), F.col("s").isNotNull().alias("streamed"), F.col("h").isNotNull().alias("answered"), machine("h").alias("answered_machine"))


def rpc_feed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Feed records as lines of a session: what is passed through, and the branch that the rest take."""
    read = rpc.read_messages(table(spark, folder, "feed_records"), "record")
    return read.groupBy("passthrough", F.when(~F.col("passthrough"), rpc.method_branch(F.col("message"))).otherwise("").alias("branch")).agg(F.count(F.lit(1)).alias("n_lines"))


def correlate_log(spark: SparkSession, folder: str) -> DataFrame:
    """Every log line of an even number as a request, the line behind it as its answer; counts by method and outcome."""
    log = K.log_lines(table(spark, folder, "gateway_log"), kind=K.event_type(), ns=K.epoch_nanos("timestamp")).withColumn("at", F.timestamp_micros(F.expr("ns div 1000")))
    method = F.when(F.col("kind") == "tool_call", "tools/call").when(F.col("kind") == "session_start", "initialize").otherwise("tools/list")
    requests = log.where("line_no % 2 = 0").select(F.col("session_id").alias("server"), F.col("line_no").cast("string").alias("id"), method.alias("method"), "at")
    answers = log.where("line_no % 2 = 1").select(F.col("session_id").alias("server"), (F.col("line_no") - 1).cast("string").alias("id"), F.lit("{}").alias("result"), "at")
    return rpc.correlate(requests, answers).groupBy("method", "timed_out").agg(F.count(F.lit(1)).alias("n_requests"))


def settings_of_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Where each server entry's address would come from, its command standing in for the environment's."""
    entries = table(spark, folder, "server_entries")
    read = entries.select("entry_id", configs.setting(F.col("url"), F.col("command"), F.lit("default")).alias("s"), configs.first_path(F.col("transport"), F.col("url"), F.col("command"), F.lit("none")).alias("first"))
    return read.select("entry_id", "s.value", "s.origin", "first")


def json_statuses(spark: SparkSession, folder: str) -> DataFrame:
    """How each posture payload reads as a document."""
    scans = table(spark, folder, "posture_scans")
    return scans.select("scan_id", configs.json_status(F.octet_length("payload"), F.col("payload")).alias("status"))


def config_file_servers(spark: SparkSession, folder: str) -> DataFrame:
    """The named servers of all config files that hold a client's map of them, by command and number of environment keys."""
    files = table(spark, folder, "config_files").withColumn("key", F.col("file_id").cast("string"))
    servers = configs.config_servers(files, "key", "content")
    return servers.select(F.col("path").cast("bigint").alias("file_id"), "name", F.coalesce("entry.command", F.lit("")).alias("command"), F.coalesce(F.size("entry.env"), F.lit(0)).alias("n_env"))


def state_names(spark: SparkSession, folder: str) -> DataFrame:
    """Which config files are named like state documents."""
    files = table(spark, folder, "config_files").select("file_id", F.element_at(F.split("path", "/"), -1).alias("name"))
    return files.select("file_id", configs.looks_like_state(F.col("name")).alias("is_state"), configs.name_matches(F.array("name"), ["deploy", "SERVER"]).alias("n_matches"))


def project_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Servers of the projects that belong to /w/app: the project named so, else those around and in it."""
    return configs.project_servers(USER_CONFIGS.frame(spark), "config", "text", "/w/app").select(F.col("path").alias("config"), "project", "name")


def session_servers(spark: SparkSession, folder: str) -> DataFrame:
    """Remote servers of session documents, once for each name and address, with the name and route they get."""
    remotes = configs.remote_servers(SESSIONS.frame(spark), "session", "text").withColumn("server_name", S.remote_name(F.col("name"), F.col("url"), F.col("uuid")))
    return keep_first(remotes, ["server_name", "url"], ["path"]).select("server_name", "url", F.col("path").alias("first_session"), S.needs_native_auth(F.lit("http"), F.col("url"), F.col("headers")).alias("native_auth"))


QUERIES = {f.__name__: f for f in (rpc_results, sse_results, http_results, rpc_lines, jsonrpc_correlate, rpc_scans, rpc_feed_lines, correlate_log, settings_of_entries, settings_origin, json_statuses, config_file_servers, state_names, project_matches, session_servers)}

_REQUESTS = Literal("server string, id string, method string, wait int", [*(("s", str(i), m, w) for i, (m, w) in enumerate(_WAITS)), ("s", "9", "ping", None), ("t", "0", "ping", None)])
_BRANCH = "CASE WHEN m IN ('initialize', 'tools/list', 'tools/call', 'resources/list', 'resources/read', 'prompts/list', 'prompts/get', 'ping') THEN m WHEN m LIKE 'notifications/%' THEN 'notification' WHEN m = '' THEN 'response' ELSE 'unknown' END"
_EVENTS = f"""(SELECT stream_id, pos, trim(substring(line, 6)) AS data FROM (SELECT stream_id, trim(unnest(string_split(replace(coalesce(stream, ''), chr(13), ''), chr(10)))) AS line, generate_subscripts(string_split(replace(coalesce(stream, ''), chr(13), ''), chr(10)), 1) AS pos FROM {STREAMS.sql()}) WHERE line LIKE 'data:%' AND trim(substring(line, 6)) NOT IN ('', '[DONE]'))"""
_READ = "CASE WHEN json_valid({0}) AND coalesce(json_extract_string(CASE WHEN json_valid({0}) THEN {0} END, '$.id'), '7') = '7' AND NOT json_exists(CASE WHEN json_valid({0}) THEN {0} END, '$.error') THEN coalesce(CAST(json_extract(CASE WHEN json_valid({0}) THEN {0} END, '$.result') AS VARCHAR), '{{}}') END"
_HEADERS = "'authorization', 'proxy-authorization', 'cookie', 'x-api-key', 'api-key', 'x-auth-token', 'x-access-token'"

SQL = {
    "project_matches": f"""WITH p AS (SELECT config, j, unnest(json_keys(j, '$.projects')) AS project FROM (SELECT config, TRY_CAST(text AS JSON) AS j FROM {USER_CONFIGS.sql()})),
      near AS (SELECT * FROM p WHERE project = '/w/app' OR starts_with('/w/app/', project || '/') OR starts_with(project, '/w/app/'))
      SELECT config, project, unnest(json_keys(json_extract(j, '$.projects."' || project || '".mcpServers'))) AS name FROM near n WHERE project = '/w/app' OR NOT EXISTS (SELECT 1 FROM near m WHERE m.config = n.config AND m.project = '/w/app')""",
    "session_servers": f"""WITH r AS (SELECT session, unnest(json_extract(TRY_CAST(text AS JSON), '$.remoteMcpServersConfig[*]')) AS r FROM {SESSIONS.sql()}),
      n AS (SELECT session, r->>'url' AS url, lower(regexp_replace(replace(trim(r->>'name'), ' ', '-'), '[^A-Za-z0-9_.-]', '-', 'g')) AS server_name, len(list_filter(coalesce(json_keys(r, '$.headers'), []), lambda k: lower(k) IN ({_HEADERS}))) = 0 AS native_auth FROM r WHERE trim(coalesce(r->>'url', '')) <> '')
      SELECT server_name, url, min(session) AS first_session, arg_min(native_auth, session) AS native_auth FROM n GROUP BY server_name, url""",
    "rpc_results": f"""SELECT body_id, CASE WHEN error <> '' THEN NULL WHEN blank THEN '{{}}' ELSE coalesce(CAST(j->'$.result' AS VARCHAR), '{{}}') END AS result, error FROM (SELECT *, CASE WHEN blank THEN '' WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'unparsable response'
      WHEN j->>'$.id' <> CAST(wanted AS VARCHAR) THEN 'unexpected response id' WHEN json_exists(j, '$.error') THEN coalesce(nullif(j->>'$.error.message', ''), 'error') ELSE '' END AS error FROM (SELECT *, trim(coalesce(body, '')) = '' AS blank, TRY_CAST(body AS JSON) AS j FROM {BODIES.sql()}))""",
    "sse_results": f"""WITH e AS (SELECT *, {_READ.format('data')} AS r FROM {_EVENTS}) SELECT s.stream_id, CAST(count(e.data) AS INTEGER) AS n_payloads, arg_min(r, pos) FILTER (r IS NOT NULL) AS result FROM {STREAMS.sql()} s LEFT JOIN e USING (stream_id) GROUP BY s.stream_id""",
    "http_results": f"""SELECT answer_id, CASE WHEN status = 202 THEN '{{}}' WHEN status NOT BETWEEN 200 AND 299 AND lower(coalesce(kind, '')) NOT LIKE '%application/json%' THEN NULL ELSE {_READ.format('b')} END AS result
      FROM (SELECT *, CASE WHEN status BETWEEN 200 AND 299 AND lower(coalesce(kind, '')) LIKE '%text/event-stream%' THEN regexp_extract(body, 'data: (.*)', 1) ELSE body END AS b FROM {ANSWERS.sql()})""",
    "rpc_lines": f"SELECT line_no, NOT o AS passthrough, CASE WHEN o THEN {_BRANCH} ELSE '' END AS branch FROM (SELECT line_no, coalesce(json_type(TRY_CAST(line AS JSON)) = 'OBJECT', false) AS o, coalesce(TRY_CAST(line AS JSON)->>'$.method', '') AS m FROM {LINES.sql()} WHERE trim(line) <> '')",
    "rpc_feed_lines": f"SELECT NOT o AS passthrough, CASE WHEN o THEN {_BRANCH} ELSE '' END AS branch, count(*) AS n_lines FROM (SELECT coalesce(json_type(TRY_CAST(record AS JSON)) = 'OBJECT', false) AS o, coalesce(TRY_CAST(record AS JSON)->>'$.method', '') AS m FROM feed_records WHERE trim(coalesce(record, '')) <> '') GROUP BY ALL",
    "jsonrpc_correlate": f"SELECT server, id, method, NOT coalesce(wait BETWEEN 0 AND CASE method WHEN 'tools/call' THEN 60 WHEN 'tools/list' THEN 20 WHEN 'initialize' THEN 20 ELSE 8 END, false) AS timed_out FROM {_REQUESTS.sql()}",
    "correlate_log": """WITH l AS (SELECT DISTINCT session_id, line_no, regexp_replace(lower(coalesce(event_type, '')), '^.*[.]', '') AS kind, epoch_us(CAST(regexp_replace(timestamp, '([.][0-9]{6})[0-9]+', '\\1') AS TIMESTAMPTZ)) AS us FROM gateway_log WHERE session_id IS NOT NULL AND line_no IS NOT NULL),
      q AS (SELECT *, CASE kind WHEN 'tool_call' THEN 'tools/call' WHEN 'session_start' THEN 'initialize' ELSE 'tools/list' END AS method FROM l WHERE line_no % 2 = 0)
      SELECT method, a.us IS NULL AS timed_out, count(*) AS n_requests FROM q LEFT JOIN l a ON a.session_id = q.session_id AND a.line_no = q.line_no + 1 AND a.us BETWEEN q.us AND q.us + 1000000 * CASE method WHEN 'tools/call' THEN 60 WHEN 'tools/list' THEN 20 WHEN 'initialize' THEN 20 ELSE 8 END GROUP BY ALL""",
    "rpc_scans": """WITH s AS (SELECT scan_id, payload, json_valid(coalesce(payload, 'null')) AS ok, scan_id % 5 = 0 AS other, scan_id % 7 = 0 AS refused FROM posture_scans),
      r AS (SELECT *, CASE WHEN NOT ok THEN 'unparsable response' WHEN other THEN 'unexpected response id' WHEN refused THEN 'refused' ELSE '' END AS error FROM s),
      m AS (SELECT *, CASE WHEN error = '' AND payload IS NOT NULL THEN json_extract_string(CASE WHEN ok THEN payload END, '$.machine_id') END AS machine, error = '' AND NOT (scan_id % 3 = 0 AND scan_id % 2 = 1) AS answered FROM r)
      SELECT scan_id, error, machine, error = '' AS streamed, answered, CASE WHEN answered THEN machine END AS answered_machine FROM m""",
    "settings_of_entries": "SELECT entry_id, coalesce(nullif(trim(url), ''), nullif(trim(command), ''), 'default') AS value, CASE WHEN trim(coalesce(url, '')) <> '' THEN 'file' WHEN trim(coalesce(command, '')) <> '' THEN 'env' ELSE 'default' END AS origin, coalesce(nullif(trim(transport), ''), nullif(trim(url), ''), nullif(trim(command), ''), 'none') AS first FROM server_entries",
    "settings_origin": f"SELECT row_id, coalesce(nullif(trim(file), ''), nullif(trim(env), ''), 'd') AS value, CASE WHEN trim(coalesce(file, '')) <> '' THEN 'file' WHEN trim(coalesce(env, '')) <> '' THEN 'env' ELSE 'default' END AS origin, coalesce(nullif(trim(file), ''), nullif(trim(env), ''), '/etc/d') AS path FROM {SETTINGS.sql()}",
    "json_statuses": "SELECT scan_id, CASE WHEN payload IS NULL THEN 'missing' WHEN octet_length(encode(payload)) > 5242880 THEN 'too_large' WHEN NOT json_valid(payload) THEN 'invalid_json' ELSE 'ok' END AS status FROM posture_scans",
    "config_file_servers": """WITH f AS (SELECT file_id, TRY_CAST(content AS JSON) AS j FROM config_files), n AS (SELECT file_id, j, unnest(json_keys(j, '$.mcpServers')) AS name FROM f)
      SELECT file_id, name, coalesce(j->'mcpServers'->name->>'command', '') AS command, CAST(coalesce(len(json_keys(j->'mcpServers'->name, '$.env')), 0) AS INTEGER) AS n_env FROM n""",
    "state_names": "SELECT file_id, n IN ('cowork_settings.json', 'settings.json', 'config.json') OR starts_with(n, 'local_') OR contains(n, 'session') OR contains(n, 'task') OR contains(n, 'plugin') AS is_state, CASE WHEN contains(n, 'deploy') OR contains(n, 'server') THEN 1 ELSE 0 END AS n_matches FROM (SELECT file_id, lower(regexp_extract(path, '[^/]*$')) AS n FROM config_files)",
}
