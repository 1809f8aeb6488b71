"""Plans of routing clients' servers through a gateway, and lookups of tools, owners and settings that go with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrill.functions import servers as S
from tallyrill.operators.detection import escalate
from tallyrill.operators.policy import action

# Contract of a managed runtime's configuration and its size in bytes, that of a hook's envelope, the known
# paths of client configurations below the home folder, and what the platforms' app data are.
PROTOCOL_VERSION, MANAGED_BYTES, ENVELOPE_BYTES = 1, 64 * 1024, 64 * 1024
KNOWN_PATHS = (".claude.json", ".claude/settings.json", ".cursor/mcp.json")
DESKTOP_PATHS = {"darwin": "Library/Application Support/Claude/claude_desktop_config.json", "windows": "AppData/Roaming/Claude/claude_desktop_config.json"}
DESKTOP_PATH = ".config/Claude/claude_desktop_config.json"
APP_DATA = {"darwin": "macos_current_user", "windows": "windows_current_user"}


def route_calls(calls: DataFrame, tools: DataFrame, tool: str) -> DataFrame:
    """``calls`` with the ``server`` of the called tool's name and ``unknown``, true where no server has it; of a name
    that several servers have, the last server in order gets the call. tools: (tool, server)."""
    owner = tools.groupBy(F.col("tool").alias("_tool")).agg(F.max("server").alias("server"))
    return calls.join(owner, F.col(tool) == F.col("_tool"), "left").withColumn("unknown", F.col("server").isNull()).drop("_tool")


def response_events(judged: DataFrame, policy_mode: dict[str, str], local_mode: dict[str, str], enforce: bool) -> DataFrame:
    """Of judged responses (server_name, tool_name, detection, ...) the events that the gateway logs: one
    ``mcp.threat_detected`` row for each that doesn't pass, with what becomes of the response."""
    # what doesn't pass is unfolded, not filtered: a filter would be pushed below the rules and try them all once more
    found = judged.withColumn("__tr_x", F.explode(F.filter(F.array("detection"), lambda d: d["verdict"] != "pass")))
    lifted = found.withColumn("__tr_d", escalate(F.col("__tr_x"), policy_mode, local_mode))
    return lifted.select(*(c for c in judged.columns if c != "detection"), F.lit("mcp.threat_detected").alias("event_type"), *(F.col(f"__tr_d.{f}").alias(f) for f in ("verdict", "severity", "pattern_name", "category", "description")), F.when(action(F.col("__tr_d.verdict"), enforce) == "blocked", "withheld").otherwise("forwarded").alias("action"))


def merge_named(existing: DataFrame, more: DataFrame, key: Sequence[str]) -> DataFrame:
    """Named servers of two tables; where both have a name, the existing one stays."""
    return existing.unionByName(more.join(existing.select(*key).distinct(), list(key), "left_anti").select(*existing.columns))


def recover_native(backends: DataFrame, existing: DataFrame) -> DataFrame:
    """The gateway's named backends that rely on their client's own sign-in and that no client entry names any more."""
    native = S.needs_native_auth(F.col("transport"), F.col("url"), F.col("headers"))
    return backends.where((S.text(F.col("name")) != "") & native).join(existing.select("name").distinct(), "name", "left_anti").select(*backends.columns)


def client_plan(entries: DataFrame, gateway: str, gateway_name: str) -> DataFrame:
    """One row for each client and source of named entries: (client, source_path, has_gateway, migrated, native_kept,
    already_wired). The gateway's own entry is neither; a file is wired where it has a current one and nothing is left
    to migrate."""
    own = F.col("name") == gateway_name
    native = S.needs_native_auth(F.col("transport"), F.col("url"), F.col("headers"))
    names = lambda which: F.array_sort(F.collect_list(F.when(~own & which, F.col("name"))))
    plan = entries.groupBy("client", "source_path").agg(F.bool_or(own & S.is_gateway(F.col("command"), F.col("args"), gateway)).alias("has_gateway"), names(~native).alias("migrated"), names(native).alias("native_kept"))
    return plan.withColumn("already_wired", F.col("has_gateway") & (F.size("migrated") == 0))


def is_gateway_server(name: Column, command: Column, gateway: str, gateway_name: str) -> Column:
    """Whether a configured server is the gateway itself: by its name, or by its command's base name."""
    return (S.text(name) == gateway_name) | (S.basename(command) == gateway.rpartition("/")[2])


def gateway_backends(servers: DataFrame, gateway: str, gateway_name: str) -> DataFrame:
    """The gateway's configured servers as a report shows them, by name: without the gateway itself, with a transport,
    and the keys of environments and headers instead of their values."""
    own = servers.where(~is_gateway_server(F.col("name"), F.col("command"), gateway, gateway_name))
    return own.select("name", S.transport_loose(F.col("transport"), F.col("url")).alias("transport"), S.sorted_keys(F.col("env")).alias("env_keys"), S.sorted_keys(F.col("headers")).alias("header_keys")).orderBy("name")


def project_hash(path: Column, project: Column, name: Column) -> Column:
    """What tells a server of a project apart from those of the same name elsewhere."""
    return S.short_hash(F.concat_ws("|", S.text(path), S.text(project), S.text(name)))


def delete_by(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The table without the rows of some keys."""
    return table.join(keys.select(key), key, "left_anti").select(*table.columns)


def restore_plan(backends: DataFrame, owned: DataFrame) -> DataFrame:
    """``backends`` with ``disposition``: ``restored`` to the clients where a manifest of owned names lists them, else
    ``kept`` in the gateway."""
    marks = owned.select(F.col("name").alias("_name")).distinct().withColumn("_owned", F.lit(True))
    return backends.join(marks, F.col("name") == F.col("_name"), "left").select(*backends.columns, F.when(F.col("_owned"), "restored").otherwise("kept").alias("disposition"))


def replace_snapshot(snapshots: DataFrame, replacement: DataFrame) -> DataFrame:
    """Snapshots (position, name, path, ...) with those of the replacement's name and path replaced in their position;
    new ones follow behind. replacement: the same columns but the position."""
    fresh = replacement.select(F.col("name").alias("_n"), F.col("path").alias("_p"), F.struct(*(c for c in replacement.columns)).alias("_new"))
    both = snapshots.join(fresh, (F.col("name") == F.col("_n")) & (F.col("path") == F.col("_p")), "full")
    last = snapshots.agg(F.coalesce(F.max("position"), F.lit(0)).alias("_last"))
    rest = [c for c in snapshots.columns if c != "position"]
    placed = both.join(F.broadcast(last), F.lit(True)).withColumn("position", F.coalesce("position", F.col("_last") + 1))
    return placed.select("position", *(F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c) for c in rest))


def checked_paths(found: Column, cwd: Column, home: Column, platform: Column) -> Column:
    """The discovered source paths in their order, then the known ones, each once; blank ones and those of an unknown
    folder are left out."""
    below = lambda folder, path: F.when(S.text(folder) != "", F.concat(folder, F.lit("/" + path)))
    desktop = below(home, DESKTOP_PATH)
    for name, path in DESKTOP_PATHS.items():
        desktop = F.when(platform == name, below(home, path)).otherwise(desktop)
    known = F.array(below(cwd, ".mcp.json"), *(below(home, p) for p in KNOWN_PATHS), desktop)
    return S.unique_texts(F.concat(F.coalesce(found, F.array().cast("array<string>")), known))


def managed_broker(socket: Column, protocol: Column, mode: Column, contract: tuple[str, str]) -> Column:
    """Whether a gateway's settings name a managed runtime of the given protocol and credential mode."""
    return (F.trim(S.text(socket)) != "") & (S.text(protocol) == contract[0]) & (S.text(mode) == contract[1])


def managed_config_status(raw: Column, contract: tuple[str, str], owner: str) -> Column:
    """too_large, invalid_json, incompatible, wrong_owner, relative_socket or ok for a managed runtime's configuration."""
    doc = F.from_json(raw, "schema_version int, protocol string, credential_mode string, ownership_id string, runtime_socket string")
    readable = F.coalesce(F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT"), F.lit(False))
    fits = (F.coalesce(doc["schema_version"], F.lit(0)) == PROTOCOL_VERSION) & (S.text(doc["protocol"]) == contract[0]) & (S.text(doc["credential_mode"]) == contract[1])
    return (
        F.when(F.octet_length(raw) > MANAGED_BYTES, "too_large").when(~readable, "invalid_json").when(~fits, "incompatible")
        .when(S.text(doc["ownership_id"]) != owner, "wrong_owner").when(~S.text(doc["runtime_socket"]).startswith("/"), "relative_socket").otherwise("ok")
    )


def hook_envelope(raw: Column) -> Column:
    """(cwd, claude_version) of a hook's envelope, empty where it can't be read; only its first 64 KiB count, so a longer
    one isn't readable."""
    doc = F.from_json(F.when(F.octet_length(raw) <= ENVELOPE_BYTES, raw), "cwd string, claude_version string")
    return F.struct(S.text(doc["cwd"]).alias("cwd"), S.text(doc["claude_version"]).alias("claude_version"))


def app_data_kind(platform: Column) -> Column:
    kind = F.lit("unsupported")
    for name, value in APP_DATA.items():
        kind = F.when(platform == name, value).otherwise(kind)
    return kind


def start_problem(name: Column, transport: Column, url: Column, command: Column) -> Column:
    """Why a configured server isn't started: ``no_name``, ``no_url``, ``no_command`` or empty."""
    http = S.transport_loose(transport, url) == "http"
    return F.when(F.trim(S.text(name)) == "", "no_name").when(http & (F.trim(S.text(url)) == ""), "no_url").when(~http & (F.trim(S.text(command)) == ""), "no_command").otherwise("")


def first_answers(answers: DataFrame, request: str, server: str, failed: str) -> DataFrame:
    """Of each request the first server, by name, that answered without an error: (request, server)."""
    return answers.where(~F.coalesce(failed, F.lit(False))).groupBy(request).agg(F.min(server).alias(server))


def payload_rows(df: DataFrame, fields: Sequence[str], key: str) -> DataFrame:
    """(key, payload): the rows' upload payloads as JSON texts; null fields are left out."""
    return df.select(key, F.to_json(F.struct(*fields)).alias("payload"))
