"""Queries over server entries and check-ins: discovery, coverage, migration plans, inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrill.functions import servers as S
from tallyrill.operators import inventory as I
from tallyrill.plans.checkins import platform
from tallyrill.plans.literals import Literal
from tallyrill.session import table

#: The gateway's own command in these queries, the name of its entries, and the command of a stale one.
GATEWAY, STALE, OLD_GATEWAY = "/opt/gw/gateway-mcp", "gateway-mcp", "/usr/local/bin/gateway-mcp"

REMOTES = Literal(
    "remote_no int, uuid string, name string, url string",
    [(1, "u-1", "Docs Search", "https://docs.example/mcp"), (2, "u-2", "", "https://mail.example/mcp/v1"), (3, "", "", ""), (4, "u-4", "  ", None), (5, "u-9", "Plan B", "https://plan.example"), (6, None, "Ünïcode Tool!", "http://x.example"), (7, "u-7", "--", "")],
)
DIRECT = Literal("remote_id string, name string, url string", [("u-1", "other", "https://else.example"), ("", "PLAN-B", "https://plan.example"), ("u-x", "mail.example", "https://mail.example/mcp/v1 ")])
TOOLS = Literal("row_id int, tools map<string,string>", [(1, {"u-1:a": "true", "u-10:b": "true", "u-2:c": "false"}), (2, {}), (3, {"u-1": "x", "x:u-1:y": "z"})])
RAW_IDS = Literal("row_id int, raw string", [(1, '  "IOPlatformUUID" = "AB CD-12"'), (2, "DeviceId : 0a1b2c3d-0000-1111-2222-333344445555"), (3, "  MachineGuid    REG_SZ    0A1B2C3D-1111"), (4, "00000000-0000-0000-0000-000000000000"), (5, "4C4C4544-0042-3510-8052-B4C04F564433"), (6, "To be filled by O.E.M."), (7, "0000"), (8, "SN-77 88"), (9, ""), (10, None)])
PATHS = Literal("row_id int, path string", [(1, "/"), (2, "C:\\"), (3, "/home/a/Documents/"), (4, "/home/a/Desktop/x"), (5, "~"), (6, "%USERPROFILE%"), (7, "/opt//app/"), (8, "c:\\Users\\a\\Desktop")])


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    """Server entries as discovered ones: the client as it is spelled without case, the machine as the source. The table
    has no gateway, so a third of the sources get an entry of it, and another third a stale one."""
    entries = table(spark, folder, "server_entries")
    own = entries.select("entry_id", "name", F.lower("client").alias("client"), F.coalesce("machine_id", F.lit("")).alias("source_path"), *I.ENTRY_COLUMNS)
    sources = own.groupBy("client", "source_path").agg(F.min("entry_id").alias("first"))
    gateways = sources.where("first % 3 < 2").select((F.col("first") + 10**9).alias("entry_id"), F.lit(STALE).alias("name"), "client", "source_path", F.when(F.col("first") % 3 == 0, GATEWAY).otherwise(OLD_GATEWAY).alias("command"), F.array(F.lit("server")).alias("args"))
    return own.unionByName(gateways, allowMissingColumns=True).select("entry_id", "name", "client", F.lit("user").alias("scope"), F.lit("config").alias("source_kind"), "source_path", *I.ENTRY_COLUMNS)


def _discovered(spark: SparkSession, folder: str) -> DataFrame:
    kept = I.dedupe_discovered(_entries(spark, folder).where("name <> ''"), ["entry_id"])
    return I.discover(kept, GATEWAY)


def _backends(spark: SparkSession, folder: str) -> DataFrame:
    """The gateway's own entries: every registration of a cursor client, by name the first."""
    own = I.keep_first(_entries(spark, folder).where(F.col("client").eqNullSafe("cursor") & (F.col("name") != "") & (F.col("name") != STALE)), ["name"], ["entry_id"])
    return own.withColumn("entry_key", I.entry_key()).withColumnRenamed("entry_id", "position")


def discover_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Every registration with its transport both ways, its route and keys instead of values."""
    entries = _entries(spark, folder)
    route = S.routeability(F.col("transport"), F.col("url"), F.col("command"), F.col("headers"))
    return entries.select("entry_id", S.transport_exact(F.col("transport"), F.col("url")).alias("transport"), S.transport_loose(F.col("transport"), F.col("url")).alias("loose_transport"), route["label"].alias("routeability"), route["routable"].alias("routable"), S.needs_native_auth(F.col("transport"), F.col("url"), F.col("headers")).alias("native_auth"), F.array_join(S.sorted_keys(F.col("env")), ",").alias("env_keys"), F.array_join(S.sorted_keys(F.col("headers")), ",").alias("header_keys"), S.render_command(F.col("url"), F.col("command"), F.col("args")).alias("shown"), S.inventory_command(F.col("command"), F.col("args")).alias("command_line"))


def discover_dedupe_sort(spark: SparkSession, folder: str) -> DataFrame:
    """Discovered servers once for each client, source and name, in order."""
    return I.sort_discovered(_discovered(spark, folder).select("client", "source_kind", "scope", "name", "source_path", "source_hash", "transport", "routeability", "routable"))


def coverage_verdict(spark: SparkSession, folder: str) -> DataFrame:
    """How many discovered servers the gateway's own entries cover, and the verdict."""
    backends = _backends(spark, folder)
    covered = I.cover(_discovered(spark, folder).where("client <> 'cursor'"), backends)
    return I.coverage(covered, backends.select(F.count(F.lit(1))).scalar())


def migration_plans(spark: SparkSession, folder: str) -> DataFrame:
    """What a migration would do with each client's source."""
    plan = I.migration_plan(_discovered(spark, folder), GATEWAY, STALE)
    return plan.select("client", "source_path", F.array_join("migrated", ",").alias("migrated"), F.array_join("native_kept", ",").alias("native_kept"), "needs_rewrite", "already_routed")


def short_hash_names(spark: SparkSession, folder: str) -> DataFrame:
    """The names that the routable servers of all clients get as backends, beside those of the gateway."""
    rows = _discovered(spark, folder).where("route_state = 'direct' and routable").select("name", "entry_key", "source_hash", "source_path", "client")
    return I.free_names(rows, _backends(spark, folder), ["client", "source_path"]).select("name", "source_path", "client", "gateway_name")


def remote_matching(spark: SparkSession, folder: str) -> DataFrame:
    """Remote servers by the name they get and whether a migrated row disables them."""
    matched = I.match_remotes(REMOTES.frame(spark), DIRECT.frame(spark))
    return matched.select("remote_no", S.remote_name(F.col("name"), F.col("url"), F.col("uuid")).alias("server_name"), "disabled")


def enabled_tools(spark: SparkSession, folder: str) -> DataFrame:
    kept = TOOLS.frame(spark).withColumn("kept", I.without_tools(F.col("tools"), F.array(F.lit("u-1"))))
    return kept.select("row_id", F.array_join(F.array_sort(F.map_keys("kept")), ",").alias("kept"))


def inventory_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Skills and servers over all check-ins, once for each kind, name, source and platform, as first reported."""
    checkins = table(spark, folder, "checkins")
    items = lambda kind, column, value: checkins.select("checkin_id", F.posexplode(column).alias("pos", "i")).where("i is not null").select(F.lit(kind).alias("item_kind"), F.trim(S.text(F.col("i.name"))).alias("name"), S.text(F.col("i.source")).alias("source"), platform("i.platform").alias("platform"), value.alias("value"), "checkin_id", "pos")
    parts = [I.inventory(items(*x), ["checkin_id", "pos"]) for x in (("skill", "installed_skills", F.lower(S.text(F.col("i.hash")))), ("server", "installed_mcp_servers", S.text(F.col("i.command"))))]
    return parts[0].unionByName(parts[1]).select("item_kind", "name", "source", "platform", "value", "checkin_id")


def unique_names(spark: SparkSession, folder: str) -> DataFrame:
    """Of each check-in its distinct server names in the order met, joined."""
    names = F.transform(F.coalesce("installed_mcp_servers", F.array()), lambda s: s["name"])
    return table(spark, folder, "checkins").select("checkin_id", F.array_join(S.unique_texts(names), ",").alias("names"), F.size(S.unique_texts(names)).alias("n_names"))


def machine_ids(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.col("raw")
    return RAW_IDS.frame(spark).select("row_id", S.platform_uuid(raw).alias("platform_uuid"), S.device_id(raw).alias("device_id"), S.registry_guid(raw).alias("registry_guid"), S.firmware_uuid(raw).alias("firmware_uuid"), S.firmware_serial(raw).alias("serial"))


def config_strings(spark: SparkSession, folder: str) -> DataFrame:
    """Preview, hashes and cleaned names of every config file."""
    files = table(spark, folder, "config_files")
    return files.select("file_id", S.stable_hash(F.col("content")).alias("stable_hash"), S.short_hash(F.col("path")).alias("short_hash"), S.clean_name(F.col("path")).alias("clean_name"), S.backup_name(F.col("path")).alias("backup_name"), S.basename(F.col("path")).alias("base_name"), S.holds_term(F.col("content"), S.SENSITIVE_KEY_TERMS).alias("sensitive"), F.octet_length(S.preview(F.col("content"))).alias("preview_bytes"))


def names_across_clients(spark: SparkSession, folder: str) -> DataFrame:
    """Servers once for each name over all clients, the first registered one."""
    return I.keep_first(_entries(spark, folder).where("name <> ''"), ["name"], ["entry_id"]).select("name", "client", "entry_id")


def broad_paths(spark: SparkSession, folder: str) -> DataFrame:
    return PATHS.frame(spark).select("row_id", S.broad_folders(F.array("path"), "/home/a").alias("broad"))


QUERIES = {f.__name__: f for f in (discover_normalize, discover_dedupe_sort, coverage_verdict, migration_plans, short_hash_names, remote_matching, enabled_tools, inventory_dedupe, unique_names, machine_ids, config_strings, names_across_clients, broad_paths)}

_T = "CASE WHEN coalesce(transport, '') IN ('sse', 'streamable-http') THEN 'http' WHEN coalesce(transport, '') <> '' THEN transport WHEN coalesce(url, '') <> '' THEN 'http' ELSE 'stdio' END"
_NATIVE = """(trim(coalesce(url, '')) <> '' AND lower(trim(coalesce(transport, ''))) IN ('', 'http', 'sse', 'streamable-http') AND len(list_filter(map_entries(coalesce(headers, MAP {})), lambda e: trim(coalesce(e.value, '')) <> ''
  AND lower(trim(e.key)) IN ('authorization', 'proxy-authorization', 'cookie', 'x-api-key', 'api-key', 'x-auth-token', 'x-access-token'))) = 0)"""
_REVIEW = f"CASE WHEN {_T} = 'http' THEN trim(coalesce(url, '')) = '' WHEN {_T} IN ('stdio', 'local') THEN trim(coalesce(command, '')) = '' ELSE trim(coalesce(url, '')) = '' AND trim(coalesce(command, '')) = '' END"
_LABEL = f"CASE WHEN {_REVIEW} THEN 'cowork_unknown_requires_review' WHEN {_T} = 'http' AND {_NATIVE} THEN 'native_client_auth_required' ELSE 'local_routable' END"
_OWN = "SELECT entry_id, name, lower(client) AS client, coalesce(machine_id, '') AS source_path, command, args, env, transport, url, headers FROM server_entries"
_ENT = f"""(WITH own AS ({_OWN}) SELECT * FROM own UNION ALL
  SELECT first + 1000000000, '{STALE}', client, source_path, CASE WHEN first % 3 = 0 THEN '{GATEWAY}' ELSE '{OLD_GATEWAY}' END, ['server'], NULL, NULL, NULL, NULL FROM (SELECT client, source_path, min(entry_id) AS first FROM own GROUP BY ALL) WHERE first % 3 < 2)"""
_KEY = "concat_ws(chr(1), coalesce(command, ''), coalesce(transport, ''), coalesce(url, ''), CAST(coalesce(args, []) AS VARCHAR), CAST(list_sort(map_entries(coalesce(env, MAP {}))) AS VARCHAR), CAST(list_sort(map_entries(coalesce(headers, MAP {}))) AS VARCHAR))"
_ROUTED = f"(command = '{GATEWAY}' AND args[1] = 'server')"
_DISC = f"""(SELECT client, 'config' AS source_kind, 'user' AS scope, name, source_path, substring(sha256(source_path), 1, 12) AS source_hash, {_T} AS transport,
    CASE WHEN coalesce({_ROUTED}, false) THEN 'routed' ELSE 'direct' END AS route_state, CASE WHEN coalesce({_ROUTED}, false) THEN 'local_routable' ELSE {_LABEL} END AS routeability,
    NOT coalesce({_ROUTED}, false) AND {_LABEL} = 'local_routable' AS routable, coalesce(command = '{OLD_GATEWAY}' AND args[1] = 'server', false) AS stale, {_KEY} AS k
  FROM (SELECT *, row_number() OVER (PARTITION BY client, source_path, name ORDER BY entry_id) AS rn FROM {_ENT} WHERE name <> '') WHERE rn = 1)"""
_BACK = f"(SELECT name, min_by(k, entry_id) AS k, min(entry_id) AS position FROM (SELECT *, {_KEY} AS k FROM {_ENT}) WHERE client = 'cursor' AND name <> '' AND name <> '{STALE}' GROUP BY name)"
_CLEAN = "regexp_replace(regexp_replace(coalesce({0}, ''), '[^A-Za-z0-9_.-]', '-', 'g'), '^-+|-+$', '', 'g')"
_KEYS = "array_to_string(list_sort(map_keys({0})), ',')"

SQL = {
    "discover_normalize": f"""SELECT entry_id, {_T} AS transport, CASE WHEN lower(trim(coalesce(transport, ''))) IN ('http', 'sse', 'streamable-http') THEN 'http' WHEN trim(coalesce(transport, '')) <> '' THEN lower(trim(transport)) WHEN trim(coalesce(url, '')) <> '' THEN 'http' ELSE 'stdio' END AS loose_transport,
      {_LABEL} AS routeability, {_LABEL} = 'local_routable' AS routable, {_NATIVE} AS native_auth, nullif({_KEYS.format('env')}, '') AS env_keys, nullif({_KEYS.format('headers')}, '') AS header_keys,
      CASE WHEN trim(coalesce(url, '')) <> '' THEN url WHEN trim(coalesce(command, '')) = '' THEN '(empty command)' ELSE concat_ws(' ', trim(command), nullif(array_to_string(args, ' '), '')) END AS shown,
      trim(concat_ws(' ', coalesce(command, ''), nullif(array_to_string(args, ' '), ''))) AS command_line FROM {_ENT}""",
    "discover_dedupe_sort": f"SELECT client, source_kind, scope, name, source_path, source_hash, transport, routeability, routable FROM {_DISC}",
    "coverage_verdict": f"""WITH d AS (SELECT *, route_state = 'direct' AND k IN (SELECT k FROM {_BACK}) AS covered FROM {_DISC} WHERE client <> 'cursor'),
      c AS (SELECT count(*) FILTER (route_state = 'routed') AS routed, count(*) FILTER (route_state = 'direct') AS direct, count(*) FILTER (route_state = 'direct' AND routable) AS routable, count(*) FILTER (covered) AS covered_direct, (SELECT count(*) FROM {_BACK}) AS backends FROM d)
      SELECT *, CASE WHEN routed > 0 AND direct = 0 THEN CASE WHEN backends = 0 THEN 'cowork_gateway_entrypoint_routed_but_no_backends_configured' ELSE 'cowork_local_mcp_routed_native_connectors_require_zip' END
        WHEN routed > 0 THEN 'cowork_gateway_routed_but_direct_bypass_detected' WHEN covered_direct > 0 THEN 'cowork_gateway_covered_but_direct_bypass_detected' WHEN routable > 0 THEN 'cowork_servers_discovered_not_routed' ELSE 'no_cowork_servers_discovered' END AS verdict FROM c""",
    "migration_plans": f"""WITH m AS (SELECT client, source_path, coalesce(string_agg(name, ',' ORDER BY name) FILTER (routable AND NOT stale), '') AS migrated, coalesce(string_agg(name, ',' ORDER BY name) FILTER (routeability = 'native_client_auth_required'), '') AS native_kept,
        bool_or(stale) AS stale, bool_or(route_state = 'routed') AS routed, bool_and(route_state = 'routed' OR routeability = 'native_client_auth_required') AS settled FROM {_DISC} GROUP BY ALL),
      r AS (SELECT *, migrated <> '' OR stale OR (native_kept <> '' AND NOT routed) AS needs_rewrite FROM m)
      SELECT client, source_path, migrated, native_kept, needs_rewrite, NOT needs_rewrite AND settled AS already_routed FROM r""",
    "short_hash_names": f"""WITH r AS (SELECT *, {_CLEAN.format('name')} AS clean FROM {_DISC} WHERE route_state = 'direct' AND routable),
      o AS (SELECT r.*, coalesce(b.k, first_value(r.k) OVER (PARTITION BY r.name ORDER BY client, source_path, r.k)) = r.k AS own FROM r LEFT JOIN {_BACK} b USING (name)),
      h AS (SELECT *, CASE WHEN clean = '' THEN 'mcp' ELSE clean END || '-' || substring(sha256(name || '|' || source_hash), 1, 12) AS hashed FROM o),
      n AS (SELECT *, dense_rank() OVER (PARTITION BY own, hashed ORDER BY met, k) AS place FROM (SELECT *, min((client, source_path)) OVER (PARTITION BY own, hashed, k) AS met FROM h))
      SELECT name, source_path, client, CASE WHEN own THEN name WHEN place = 1 THEN hashed ELSE hashed || '-' || place END AS gateway_name FROM n""",
    "names_across_clients": f"SELECT name, min_by(client, entry_id) AS client, min(entry_id) AS entry_id FROM {_ENT} WHERE name <> '' GROUP BY name",
    "remote_matching": f"""WITH r AS (SELECT *, coalesce(nullif(lower({_CLEAN.format("replace(trim(coalesce(name, '')), ' ', '-')")}), ''), nullif(lower({_CLEAN.format("split_part(regexp_replace(coalesce(url, ''), '^https?://', ''), '/', 1)")}), ''), CASE WHEN trim(coalesce(uuid, '')) <> '' THEN 'remote-' || substring(sha256(uuid), 1, 12) END, 'remote-mcp') AS server_name FROM {REMOTES.sql()})
      SELECT remote_no, server_name, (uuid IN (SELECT remote_id FROM {DIRECT.sql()} WHERE trim(remote_id) <> '') AND uuid IS NOT NULL) OR lower(trim(server_name)) || '~' || trim(coalesce(url, '')) IN (SELECT lower(trim(name)) || '~' || trim(url) FROM {DIRECT.sql()}) AS disabled FROM r""",
    "enabled_tools": f"SELECT row_id, array_to_string(list_sort(list_filter(map_keys(tools), lambda k: NOT starts_with(k, 'u-1:'))), ',') AS kept FROM {TOOLS.sql()}",
    "inventory_dedupe": " UNION ALL ".join(
        f"""SELECT '{kind}' AS item_kind, name, source, platform, value, checkin_id FROM (SELECT *, row_number() OVER (PARTITION BY name, source, platform ORDER BY checkin_id, pos) AS rn FROM (
      SELECT trim(coalesce(i.name, '')) AS name, coalesce(i.source, '') AS source, CASE p WHEN 'claudecode' THEN 'claude_code' WHEN 'claudedesktop' THEN 'claude_desktop' ELSE p END AS platform, {value} AS value, checkin_id, pos
      FROM (SELECT *, lower(regexp_replace(coalesce(i.platform, ''), '[^A-Za-z]', '', 'g')) AS p FROM (SELECT checkin_id, unnest({column}) AS i, generate_subscripts({column}, 1) AS pos FROM checkins) WHERE i IS NOT NULL))) WHERE rn = 1"""
        for kind, column, value in (("skill", "installed_skills", "lower(coalesce(i.hash, ''))"), ("server", "installed_mcp_servers", "coalesce(i.command, '')"))
    ),
    "unique_names": """WITH each AS (SELECT checkin_id, unnest(installed_mcp_servers).name AS name, generate_subscripts(installed_mcp_servers, 1) AS pos FROM checkins),
      firsts AS (SELECT checkin_id, name, min(pos) AS pos FROM each WHERE name <> '' GROUP BY ALL), joined AS (SELECT checkin_id, string_agg(name, ',' ORDER BY pos) AS names, count(*) AS n FROM firsts GROUP BY ALL)
      SELECT checkin_id, coalesce(names, '') AS names, CAST(coalesce(n, 0) AS INTEGER) AS n_names FROM checkins LEFT JOIN joined USING (checkin_id)""",
    "machine_ids": f"""WITH r AS (SELECT row_id, coalesce(raw, '') AS raw, lower(regexp_replace(coalesce(raw, ''), '\\s+', '', 'g')) AS k FROM {RAW_IDS.sql()})
      SELECT row_id, lower(regexp_replace(regexp_extract(raw, '"IOPlatformUUID"\\s*=\\s*"([^"]+)"', 1), '\\s+', '', 'g')) AS platform_uuid, lower(regexp_extract(raw, '(?im)^\\s*(?:DeviceId|Device\\s+Id)\\s*:\\s*([0-9a-fA-F-]{{36}})\\s*$', 1)) AS device_id,
        lower(regexp_extract(raw, '(?im)\\bMachineGuid\\b\\s+REG_SZ\\s+([0-9a-fA-F-]{{8,}})\\s*$', 1)) AS registry_guid,
        CASE WHEN regexp_full_match(k, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}') AND NOT regexp_full_match(k, '[0-]+|[f-]+') THEN k ELSE '' END AS firmware_uuid,
        CASE WHEN k IN ('', 'tobefilledbyo.e.m.', 'defaultstring', 'systemserialnumber', 'none', 'unknown', 'notspecified') OR regexp_full_match(k, '0+') THEN '' ELSE k END AS serial FROM r""",
    "config_strings": f"""SELECT file_id, CASE WHEN coalesce(content, '') = '' THEN '' ELSE substring(sha256(content), 1, 16) END AS stable_hash, substring(sha256(coalesce(path, '')), 1, 12) AS short_hash, {_CLEAN.format('path')} AS clean_name,
      regexp_replace(coalesce(path, ''), '[^A-Za-z0-9_.-]', '_', 'g') AS backup_name, regexp_extract(trim(path), '([^/]*)/*$', 1) AS base_name,
      regexp_matches(lower(coalesce(content, '')), 'token|secret|password|passwd|api_key|apikey|authorization|cookie|oauth|private_key|privatekey|client_secret|access_key|refresh') AS sensitive, CAST(least(300, octet_length(encode(content))) AS INTEGER) AS preview_bytes FROM config_files""",
    "broad_paths": f"""WITH p AS (SELECT row_id, regexp_replace(regexp_replace(replace(trim(path), chr(92), '/'), '/+', '/', 'g'), '(.)/$', '\\1') AS p FROM {PATHS.sql()})
      SELECT row_id, CAST(p IN ('/', '~', '.', '') OR lower(p) IN ('c:', 'c:/', '%userprofile%', '/home/a') OR lower(p) LIKE '%/documents' OR lower(p) LIKE '%/desktop' AS INTEGER) AS broad FROM p""",
}
