"""Queries of reports, tool routing, response events and the plans of routing clients through a gateway."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrill.functions import keys as K
from tallyrill.functions import servers as S
from tallyrill.operators import inventory as I
from tallyrill.operators import routing as R
from tallyrill.operators.detection import detect_text
from tallyrill.operators.policy import usable_key
from tallyrill.plans import events, inventory
from tallyrill.plans.detection import first_rule
from tallyrill.plans.inventory import _DISC, _ENT, _LABEL, _NATIVE, GATEWAY, OLD_GATEWAY, STALE
from tallyrill.plans.literals import Literal, sql_text
from tallyrill.session import spread, table

#: The protocol and credential mode of a managed runtime, and who owns its configuration, in these queries.
CONTRACT, OWNER = ("local-socket.v1", "none"), "owner.v1"

MANAGED = Literal(
    "row_id int, raw string",
    [
        (1, '{"schema_version":1,"protocol":"local-socket.v1","credential_mode":"none","ownership_id":"owner.v1","runtime_socket":"/run/x"}'), (2, '{"schema_version":2,"protocol":"local-socket.v1","credential_mode":"none","ownership_id":"owner.v1","runtime_socket":"/run/x"}'),
        (3, '{"schema_version":1,"protocol":"local-socket.v1","credential_mode":"none","ownership_id":"other","runtime_socket":"/run/x"}'), (4, '{"schema_version":1,"protocol":"local-socket.v1","credential_mode":"none","ownership_id":"owner.v1","runtime_socket":"run/x"}'),
        (5, "{"), (6, "[]"), (7, None), (8, "{}"), (9, '{"a":"' + "x" * 70_000 + '"}'),
    ],
)
SETTINGS = Literal("row_id int, api_key string, socket string, protocol string, mode string", [(1, "k-1", "", "", ""), (2, " YOURKEY ", "/run/x", "local-socket.v1", "none"), (3, "", "/run/x", "local-socket.v1", "token"), (4, None, " ", "local-socket.v1", "none"), (5, "k", "/run/x", "local-socket.v1", "none")])


def health_report(spark: SparkSession, folder: str) -> DataFrame:
    """The assembled health report over all discovered servers and the gateway's own backends."""
    health = I.backend_health(inventory._backends(spark, folder), events.last_call_per_server(spark, folder))
    report = I.health_report(inventory._discovered(spark, folder), health, STALE, F.lit(False), F.lit(False))
    return report.withColumn("next_steps", F.array_join("next_steps", "\n"))


def health_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The backends' table of the health report as lines of text, each with its name, transport, status and detail."""
    health = I.backend_health(inventory._backends(spark, folder), events.last_call_per_server(spark, folder)).withColumn("detail", I.health_detail())
    return health.select("name", F.format_string("%-32s %-8s %-16s %s", "name", "transport", "status", "detail").alias("line"))


def discover_clients(spark: SparkSession, folder: str) -> DataFrame:
    """The sources of every client put together by the client asked for, and what each asks for finds."""
    entries = inventory._entries(spark, folder).where("name <> ''")
    sources = {c: [entries.where(F.col("client") == c)] for c in I.CLIENTS}
    asked = [I.discover(I.dedupe_discovered(I.discover_sources(sources, c), ["source_order", "entry_id"]), GATEWAY).withColumn("asked", F.lit(c)) for c in ("all", *I.CLIENTS)]
    both = asked[0]
    for part in asked[1:]:
        both = both.unionByName(part)
    return both.groupBy("asked", "client").agg(F.count(F.lit(1)).alias("servers"), F.count_if("routable").alias("routable"), F.count_if(F.col("route_state") == "routed").alias("routed"))


def tool_routes(spark: SparkSession, folder: str) -> DataFrame:
    """The server that each logged tool's name leads to, and the calls of tools that none has."""
    log = table(spark, folder, "gateway_log").where(K.event_type() == "tool_call").groupBy(S.text(F.col("tool_name")).alias("tool_name")).agg(F.count(F.lit(1)).alias("n_calls"))
    tools = table(spark, folder, "tool_catalog").where("tool_name is not null").select(F.col("tool_name").alias("tool"), F.col("server_name").alias("server"))
    return R.route_calls(log, tools, "tool_name").select("tool_name", "n_calls", "server", "unknown")


def response_threats(spark: SparkSession, folder: str) -> DataFrame:
    """The events and the fate of responses that don't pass, each document's text read as a response of its server."""
    found = detect_text(spread(table(spark, folder, "documents").select("doc_id", "server_name", "text")), "text")
    return R.response_events(found.select("doc_id", "server_name", "detection"), {"sensitive_data": "block"}, {}, True).select("doc_id", "server_name", "event_type", "verdict", "pattern_name", "severity", "action")


def client_plans(spark: SparkSession, folder: str) -> DataFrame:
    """What routing each client's source through the gateway would migrate and keep."""
    entries = I.keep_first(inventory._entries(spark, folder).where("name <> ''"), ["client", "source_path", "name"], ["entry_id"])
    plan = R.client_plan(entries, GATEWAY, STALE)
    return plan.withColumn("migrated", F.array_join("migrated", ",")).withColumn("native_kept", F.array_join("native_kept", ","))


def project_plans(spark: SparkSession, folder: str) -> DataFrame:
    """What a migration would do with each project of a source, a fourth of its entries being each of four projects."""
    entries = inventory._entries(spark, folder).where("name <> ''").withColumn("scope", F.concat(F.lit("project-"), F.col("entry_id") % 4))
    found = I.discover(I.dedupe_discovered(entries, ["entry_id"]), GATEWAY).withColumn("source_hash", R.project_hash(F.col("source_path"), F.col("scope"), F.col("name")))
    plan = I.migration_plan(found, GATEWAY, STALE, ("client", "source_path", "scope"))
    hashes = found.groupBy("client", "source_path", "scope").agg(F.min("source_hash").alias("first_hash"))
    joined = plan.join(hashes, ["client", "source_path", "scope"])
    return joined.select("client", "source_path", F.col("scope").alias("project"), F.array_join("migrated", ",").alias("migrated"), F.array_join("native_kept", ",").alias("native_kept"), "needs_rewrite", "already_routed", "first_hash")


def configured_backends(spark: SparkSession, folder: str) -> DataFrame:
    """One client's servers as the gateway's configured ones, shown without values."""
    entries = inventory._entries(spark, folder).where("client = 'cowork'")
    shown = R.gateway_backends(entries, GATEWAY, STALE)
    return shown.select("name", "transport", F.array_join("env_keys", ",").alias("env_keys"), F.array_join("header_keys", ",").alias("header_keys"))


def pruned_backends(spark: SparkSession, folder: str) -> DataFrame:
    """The gateway's backends without those that a client keeps for its own sign-in."""
    backends = inventory._backends(spark, folder)
    others = inventory._entries(spark, folder).where("client <> 'cursor'")
    kept = others.where(S.needs_native_auth(F.col("transport"), F.col("url"), F.col("headers"))).select("name", S.text(F.col("url")).alias("url"))
    return I.prune_kept(backends, kept).select("name", "position")


def recovered_servers(spark: SparkSession, folder: str) -> DataFrame:
    """The backends that rely on a client's own sign-in and that one client no longer names, merged into its servers."""
    desktop = I.keep_first(inventory._entries(spark, folder).where("client = 'claude-desktop' and name <> ''"), ["name"], ["entry_id"]).select("name", "url", "transport", "headers")
    recovered = R.recover_native(inventory._backends(spark, folder).select("name", "url", "transport", "headers"), desktop)
    return R.merge_named(desktop.withColumn("origin", F.lit("client")), recovered.withColumn("origin", F.lit("gateway")), ["name"]).select("name", "url", "origin")


def upserted_servers(spark: SparkSession, folder: str) -> DataFrame:
    """The gateway's backends after another client's servers of the same names replaced them and the stopped ones went."""
    backends = inventory._backends(spark, folder).select("name", F.col("position").alias("entry_id"))
    fresh = I.keep_first(inventory._entries(spark, folder).where("client = 'cowork' and name <> ''"), ["name"], ["entry_id"]).select("name", "entry_id")
    stopped = fresh.where("entry_id % 5 = 0").select("name")
    return R.delete_by(I.upsert(backends, fresh, "name"), stopped, "name")


def restored_servers(spark: SparkSession, folder: str) -> DataFrame:
    """Which backends a removal of managed routing gives back to the clients, the manifest being one client's names."""
    return R.restore_plan(inventory._backends(spark, folder).select("name"), inventory._entries(spark, folder).where("client = 'cowork'").select("name"))


def replaced_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Check-ins of two clients as a list of snapshots, one of which replaces what it names and keeps the positions."""
    entries = inventory._entries(spark, folder).where("name <> ''")
    listed = I.keep_first(entries.where("client = 'cursor'"), ["name", "source_path"], ["entry_id"]).select(F.col("entry_id").alias("position"), "name", F.col("source_path").alias("path"), F.lit("old").alias("body"))
    fresh = I.keep_first(entries.where("client = 'cowork'"), ["name", "source_path"], ["entry_id"]).select("name", F.col("source_path").alias("path"), F.lit("new").alias("body"))
    return R.replace_snapshot(listed, fresh)


def paths_checked(spark: SparkSession, folder: str) -> DataFrame:
    """The configuration paths that a report of each check-in names."""
    checkins = table(spark, folder, "checkins")
    paths = R.checked_paths(F.array(F.concat("cwd", F.lit("/.mcp.json")), F.lit(""), F.lit("/etc/x.json")), F.col("cwd"), F.lit("/home/u"), F.col("os"))
    return checkins.select("checkin_id", F.array_join(paths, ",").alias("paths"))


def managed_configs(spark: SparkSession, folder: str) -> DataFrame:
    return MANAGED.frame(spark).select("row_id", R.managed_config_status(F.col("raw"), CONTRACT, OWNER).alias("status"))


def connection_modes(spark: SparkSession, folder: str) -> DataFrame:
    managed = R.managed_broker(F.col("socket"), F.col("protocol"), F.col("mode"), CONTRACT)
    return SETTINGS.frame(spark).select("row_id", I.connection_mode(usable_key(F.col("api_key")), managed).alias("connection_mode"))


def hook_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """The working folder and version that each feed record tells, read as a hook's envelope."""
    read = table(spark, folder, "feed_records").select("file_id", "line_no", R.hook_envelope(F.col("record")).alias("e"))
    return read.groupBy("e.cwd", "e.claude_version").agg(F.count(F.lit(1)).alias("n_records"))


def start_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Why configured servers couldn't be started."""
    entries = table(spark, folder, "server_entries")
    return entries.select("entry_id", R.start_problem(F.col("name"), F.col("transport"), F.col("url"), F.col("command")).alias("problem"), S.server_type(F.col("transport"), F.col("url")).alias("server_type"))


def first_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Of each session the first server, by key, whose logged calls weren't blocked."""
    log = table(spark, folder, "gateway_log").where("session_id is not null").select("session_id", K.server_key().alias("server"), (K.verdict() == "block").alias("failed"))
    return R.first_answers(log.where("server <> ''"), "session_id", "server", "failed")


def checkin_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """The payload of every check-in as it is uploaded: its lists' sizes and its fields, absent ones left out."""
    checkins = table(spark, folder, "checkins").withColumn("skills", F.size("installed_skills")).withColumn("servers", F.size("installed_mcp_servers"))
    return R.payload_rows(checkins, ["machine_id", "hostname", "os", "claude_version", "cwd", "skills", "servers"], "checkin_id")


def app_data(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "checkins").groupBy("os").agg(F.count(F.lit(1)).alias("n_checkins")).select("os", R.app_data_kind(F.col("os")).alias("app_data_kind"), "n_checkins")


def file_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Every config file's whole hash, its path at a home folder, and its first words as a log and a report show them."""
    files = table(spark, folder, "config_files")
    return files.select("file_id", S.file_hash(F.col("content")).alias("file_hash"), S.expand_home(F.col("path"), F.lit("/home/u")).alias("full_path"), S.log_text(S.text(F.col("content")), 40).alias("log_text"), S.display_name(F.col("path"), ("secret", "otter")).alias("shown_path"))


QUERIES = {f.__name__: f for f in (
    health_report, health_lines, discover_clients, tool_routes, response_threats, client_plans, project_plans, configured_backends, pruned_backends, recovered_servers, upserted_servers, restored_servers, replaced_snapshots, paths_checked, managed_configs, connection_modes,
    hook_envelopes, start_problems, first_answers, checkin_payloads, app_data, file_facts,
)}

_STEP = {k: sql_text(v) for k, v in I.NEXT_STEPS.items()}
_LOOSE = "CASE WHEN lower(trim(coalesce(transport, ''))) IN ('http', 'sse', 'streamable-http') THEN 'http' WHEN trim(coalesce(transport, '')) <> '' THEN lower(trim(transport)) WHEN trim(coalesce(url, '')) <> '' THEN 'http' ELSE 'stdio' END"
_OWN_BACK = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY entry_id) AS rn FROM {_ENT} WHERE client = 'cursor' AND name <> '' AND name <> '{STALE}') WHERE rn = 1)"
_HEALTH = f"""h AS (SELECT b.name, {_LOOSE} AS transport, CASE WHEN l.server_name IS NOT NULL THEN 'calls_observed'
    WHEN {_LOOSE} = 'http' AND NOT auth AND regexp_matches(lower(coalesce(url, '')), 'mcp[.]notion[.]com|mcp[.]raindrop[.]ai|mcp[.]linear[.]app') THEN 'auth_required' WHEN {_LOOSE} = 'http' AND auth THEN 'auth_configured' ELSE 'pending' END AS status, last_call_at, last_tool_name
  FROM (SELECT *, len(list_filter(map_entries(coalesce(headers, MAP {{}})), lambda e: lower(trim(e.key)) = 'authorization' AND trim(coalesce(e.value, '')) <> '')) > 0 AS auth FROM {_OWN_BACK}) b LEFT JOIN {events._LAST} l ON b.name = l.server_name)"""
_FIRST = lambda client: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY entry_id) AS rn FROM {_ENT} WHERE client = '{client}' AND name <> '') WHERE rn = 1)"
_BY_PATH = lambda client: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, source_path ORDER BY entry_id) AS rn FROM {_ENT} WHERE client = '{client}' AND name <> '') WHERE rn = 1)"

SQL = {
    "health_report": f"""WITH d AS (SELECT count(*) AS discovered, count(*) FILTER (route_state <> 'routed' AND routable AND name <> '{STALE}') AS seen_only, coalesce(bool_or(route_state <> 'routed' AND routable AND client = 'cowork'), false) AS direct_session FROM {_DISC}), {_HEALTH},
      s AS (SELECT count(*) AS backends, count(*) FILTER (status = 'auth_required') AS ar, count(*) FILTER (status = 'calls_observed') AS co, count(*) FILTER (status IN ('pending', 'auth_configured')) AS waiting FROM h)
      SELECT discovered, seen_only, direct_session, backends, CASE WHEN backends = 0 THEN 'unknown' WHEN ar > 0 THEN 'action_required' WHEN co > 0 THEN 'observed' ELSE 'pending' END AS manifest_status, 'local_only' AS connection_mode, false AS connected,
        concat_ws(chr(10), CASE WHEN discovered = 0 AND backends = 0 THEN {_STEP['nothing']} END, CASE WHEN seen_only > 0 THEN {_STEP['seen_only']} END, CASE WHEN direct_session THEN {_STEP['direct_session']} END, CASE WHEN ar > 0 THEN {_STEP['auth_required']} END,
          CASE WHEN waiting > 0 THEN {_STEP['pending']} END, {_STEP['no_key']}, {_STEP['always']}) AS next_steps FROM d JOIN s ON true""",
    "health_lines": f"""WITH {_HEALTH}, t AS (SELECT *, CASE WHEN status = 'auth_required' THEN {sql_text(I.AUTH_ERROR)} WHEN coalesce(last_tool_name, '') <> '' AND coalesce(last_call_at, '') <> '' THEN 'last call ' || last_tool_name || ' at ' || last_call_at WHEN coalesce(last_call_at, '') <> '' THEN 'last call at ' || last_call_at ELSE '' END AS detail FROM h)
      SELECT name, rpad(name, CAST(greatest(32, len(name)) AS INTEGER), ' ') || ' ' || rpad(transport, CAST(greatest(8, len(transport)) AS INTEGER), ' ') || ' ' || rpad(status, CAST(greatest(16, len(status)) AS INTEGER), ' ') || ' ' || detail AS line FROM t""",
    "discover_clients": f"SELECT asked, client, count(*) AS servers, count(*) FILTER (routable) AS routable, count(*) FILTER (route_state = 'routed') AS routed FROM {_DISC} JOIN (SELECT unnest(['all', 'claude-code', 'claude-desktop', 'cowork', 'cursor']) AS asked) ON asked IN ('all', client) WHERE client IN ('claude-code', 'claude-desktop', 'cowork', 'cursor') GROUP BY ALL",
    "tool_routes": """WITH c AS (SELECT coalesce(tool_name, '') AS tool_name, count(*) AS n_calls FROM gateway_log WHERE regexp_replace(lower(coalesce(event_type, '')), '^.*[.]', '') = 'tool_call' GROUP BY ALL)
      SELECT c.tool_name, n_calls, max(server_name) AS server, max(server_name) IS NULL AS "unknown" FROM c LEFT JOIN tool_catalog t ON t.tool_name = c.tool_name GROUP BY ALL""",
    "response_threats": f"SELECT doc_id, server_name, 'mcp.threat_detected' AS event_type, CASE WHEN category = 'sensitive_data' THEN 'block' ELSE 'warn' END AS verdict, pattern_name, severity, CASE WHEN category = 'sensitive_data' THEN 'withheld' ELSE 'forwarded' END AS action FROM (SELECT doc_id, server_name, {first_rule('t', 'pattern_name')} AS pattern_name, {first_rule('t', 'severity')} AS severity, {first_rule('t', 'category')} AS category FROM (SELECT doc_id, server_name, coalesce(text, '') AS t FROM documents)) WHERE pattern_name <> ''",
    "client_plans": f"""WITH e AS (SELECT *, {_NATIVE} AS native FROM (SELECT *, row_number() OVER (PARTITION BY client, source_path, name ORDER BY entry_id) AS rn FROM {_ENT} WHERE name <> '') WHERE rn = 1),
      p AS (SELECT client, source_path, bool_or(name = '{STALE}' AND coalesce(command = '{GATEWAY}' AND args[1] = 'server', false)) AS has_gateway, coalesce(string_agg(name, ',' ORDER BY name) FILTER (name <> '{STALE}' AND NOT native), '') AS migrated, coalesce(string_agg(name, ',' ORDER BY name) FILTER (name <> '{STALE}' AND native), '') AS native_kept FROM e GROUP BY ALL)
      SELECT *, has_gateway AND migrated = '' AS already_wired FROM p""",
    "project_plans": f"""WITH e AS (SELECT *, 'project-' || (entry_id % 4) AS project FROM {_ENT} WHERE name <> ''), d AS (SELECT *, coalesce(command = '{GATEWAY}' AND args[1] = 'server', false) AS routed, coalesce(command = '{OLD_GATEWAY}' AND args[1] = 'server', false) AS stale, {_LABEL} AS label
        FROM (SELECT *, row_number() OVER (PARTITION BY client, source_path, project, name ORDER BY entry_id) AS rn FROM e) WHERE rn = 1),
      m AS (SELECT client, source_path, project, coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT routed AND NOT stale AND label = 'local_routable'), '') AS migrated, coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT routed AND NOT stale AND label = 'native_client_auth_required'), '') AS native_kept,
        bool_or(stale) AS stale, bool_or(routed) AS routed, bool_and(routed OR label = 'native_client_auth_required') AS settled, min(substring(sha256(source_path || '|' || project || '|' || name), 1, 12)) AS first_hash FROM d GROUP BY ALL),
      r AS (SELECT *, migrated <> '' OR stale OR (native_kept <> '' AND NOT routed) AS needs_rewrite FROM m) SELECT client, source_path, project, migrated, native_kept, needs_rewrite, NOT needs_rewrite AND settled AS already_routed, first_hash FROM r""",
    "configured_backends": f"""SELECT name, {_LOOSE} AS transport, nullif(array_to_string(list_sort(map_keys(env)), ','), '') AS env_keys, nullif(array_to_string(list_sort(map_keys(headers)), ','), '') AS header_keys
      FROM {_ENT} WHERE client = 'cowork' AND NOT (coalesce(name, '') = '{STALE}' OR coalesce(regexp_extract(regexp_replace(trim(command), '/+$', ''), '([^/]*)$', 1), '') = 'gateway-mcp')""",
    "pruned_backends": f"SELECT name, entry_id AS position FROM {_OWN_BACK} b WHERE NOT (name <> '' AND coalesce(url, '') <> '' AND {_NATIVE} AND EXISTS (SELECT 1 FROM {_ENT} o WHERE o.client <> 'cursor' AND o.name = b.name AND coalesce(o.url, '') = b.url AND {_NATIVE.replace('url', 'o.url').replace('transport', 'o.transport').replace('headers', 'o.headers')}))",
    "recovered_servers": f"SELECT name, url, 'client' AS origin FROM {_FIRST('claude-desktop')} UNION ALL SELECT name, url, 'gateway' FROM {_OWN_BACK} WHERE {_NATIVE} AND name NOT IN (SELECT name FROM {_FIRST('claude-desktop')})",
    "upserted_servers": f"""WITH f AS (SELECT name, entry_id FROM {_FIRST('cowork')}), u AS (SELECT name, entry_id FROM {_OWN_BACK} WHERE name NOT IN (SELECT name FROM f) UNION ALL SELECT * FROM f)
      SELECT * FROM u WHERE name NOT IN (SELECT name FROM f WHERE entry_id % 5 = 0)""",
    "restored_servers": f"SELECT name, CASE WHEN name IN (SELECT name FROM {_ENT} WHERE client = 'cowork' AND name IS NOT NULL) THEN 'restored' ELSE 'kept' END AS disposition FROM {_OWN_BACK}",
    "replaced_snapshots": f"""WITH l AS (SELECT entry_id, name, source_path FROM {_BY_PATH('cursor')}), f AS (SELECT name, source_path FROM {_BY_PATH('cowork')})
      SELECT coalesce(l.entry_id, (SELECT max(entry_id) + 1 FROM l)) AS position, coalesce(f.name, l.name) AS name, coalesce(f.source_path, l.source_path) AS path, CASE WHEN f.name IS NULL THEN 'old' ELSE 'new' END AS body FROM l FULL JOIN f ON l.name = f.name AND l.source_path = f.source_path""",
    "paths_checked": """SELECT checkin_id, concat_ws(',', CASE WHEN cwd IS NOT NULL THEN cwd || '/.mcp.json' END, '/etc/x.json', CASE WHEN cwd = '' THEN NULL END, '/home/u/.claude.json', '/home/u/.claude/settings.json', '/home/u/.cursor/mcp.json',
      CASE os WHEN 'darwin' THEN '/home/u/Library/Application Support/Claude/claude_desktop_config.json' WHEN 'windows' THEN '/home/u/AppData/Roaming/Claude/claude_desktop_config.json' ELSE '/home/u/.config/Claude/claude_desktop_config.json' END) AS paths FROM checkins""",
    "managed_configs": f"""SELECT row_id, CASE WHEN octet_length(encode(raw)) > 65536 THEN 'too_large' WHEN raw IS NULL OR NOT json_valid(raw) OR json_type(CASE WHEN json_valid(raw) THEN raw END) <> 'OBJECT' THEN 'invalid_json'
      WHEN coalesce(TRY_CAST(json_extract_string(raw, '$.schema_version') AS INTEGER), 0) <> 1 OR coalesce(json_extract_string(raw, '$.protocol'), '') <> '{CONTRACT[0]}' OR coalesce(json_extract_string(raw, '$.credential_mode'), '') <> '{CONTRACT[1]}' THEN 'incompatible'
      WHEN coalesce(json_extract_string(raw, '$.ownership_id'), '') <> '{OWNER}' THEN 'wrong_owner' WHEN coalesce(json_extract_string(raw, '$.runtime_socket'), '') NOT LIKE '/%' THEN 'relative_socket' ELSE 'ok' END AS status FROM {MANAGED.sql()}""",
    "connection_modes": f"SELECT row_id, CASE WHEN trim(coalesce(api_key, '')) NOT IN ('', 'ak_live_YOURKEY', 'ak_live_YOUR_KEY', 'YOUR_API_KEY', 'YOURKEY') THEN 'api_key' WHEN trim(coalesce(socket, '')) <> '' AND protocol = '{CONTRACT[0]}' AND mode = '{CONTRACT[1]}' THEN 'managed_runtime_broker' ELSE 'local_only' END AS connection_mode FROM {SETTINGS.sql()}",
    "hook_envelopes": "SELECT coalesce(json_extract_string(r, '$.cwd'), '') AS cwd, coalesce(json_extract_string(r, '$.claude_version'), '') AS claude_version, count(*) AS n_records FROM (SELECT CASE WHEN json_valid(record) THEN record END AS r FROM feed_records) GROUP BY ALL",
    "start_problems": f"SELECT entry_id, CASE WHEN trim(coalesce(name, '')) = '' THEN 'no_name' WHEN {_LOOSE} = 'http' AND trim(coalesce(url, '')) = '' THEN 'no_url' WHEN {_LOOSE} <> 'http' AND trim(coalesce(command, '')) = '' THEN 'no_command' ELSE '' END AS problem, CASE WHEN coalesce(transport, '') <> '' THEN transport WHEN coalesce(url, '') <> '' THEN 'http' ELSE 'stdio' END AS server_type FROM server_entries",
    "first_answers": "SELECT session_id, min(regexp_replace(lower(coalesce(server_name, '')), '[^a-z0-9]', '', 'g')) AS server FROM gateway_log WHERE session_id IS NOT NULL AND regexp_replace(lower(coalesce(server_name, '')), '[^a-z0-9]', '', 'g') <> '' AND lower(trim(coalesce(verdict, ''))) <> 'block' GROUP BY ALL",
    "checkin_payloads": """SELECT checkin_id, '{' || concat_ws(',', '"machine_id":"' || machine_id || '"', '"hostname":"' || hostname || '"', '"os":"' || os || '"', '"claude_version":"' || claude_version || '"', '"cwd":"' || cwd || '"', '"skills":' || len(installed_skills), '"servers":' || len(installed_mcp_servers)) || '}' AS payload FROM checkins""",
    "app_data": "SELECT os, CASE os WHEN 'darwin' THEN 'macos_current_user' WHEN 'windows' THEN 'windows_current_user' ELSE 'unsupported' END AS app_data_kind, count(*) AS n_checkins FROM checkins GROUP BY ALL",
    "file_facts": """SELECT file_id, sha256(content) AS file_hash, CASE WHEN path = '~' THEN '/home/u' WHEN path LIKE '~/%' THEN '/home/u' || substring(path, 2) ELSE path END AS full_path,
      CASE WHEN octet_length(encode(c)) > 40 THEN c[:40] || '...' ELSE c END AS log_text, CASE WHEN regexp_matches(lower(coalesce(path, '')), 'secret|otter') THEN '[REDACTED]' ELSE coalesce(path, '')[:80] END AS shown_path FROM (SELECT *, replace(replace(coalesce(content, ''), chr(10), ' '), chr(13), ' ') AS c FROM config_files)""",
}
