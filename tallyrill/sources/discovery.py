"""Discovery of the servers that a home folder's client configurations name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrill.functions import servers as S
from tallyrill.operators import inventory as I
from tallyrill.operators.routing import DESKTOP_PATH, DESKTOP_PATHS
from tallyrill.sources import configs

# How sources that aren't plain local ones can be routed, and the folder of sessions below the app's.
DESKTOP_ROUTE, PLUGIN_ROUTE, REMOTE_ROUTE, SESSIONS = "cowork_local_desktop_config_routable", "cowork_local_plugin_mcp_routable", "cowork_remote_mcp_routable", "local-agent-mode-sessions"


def _file(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of one file, be its name hidden or not; no row where it is missing."""
    folder, _, name = path.rpartition("/")
    return configs.read_files(spark, folder, name, deepest=0).select("path", configs.without_bom(F.col("content").cast("string")).alias("text"))


def _named(servers: DataFrame, client: str, scope: str, kind: str, route: str) -> DataFrame:
    """(path, name, entry) as the entries of a source."""
    own = F.coalesce(F.nullif("entry.transport", F.lit("")), "entry.type")
    return _labelled(servers.select("path", "name", "entry.command", "entry.args", "entry.env", own.alias("transport"), "entry.url", "entry.headers"), client, scope, kind, route)


def _labelled(entries: DataFrame, client: str, scope: str, kind: str, route: str) -> DataFrame:
    return entries.select("name", F.lit(client).alias("client"), F.lit(scope).alias("scope"), F.lit(kind).alias("source_kind"), F.col("path").alias("source_path"), *I.ENTRY_COLUMNS, F.lit(route).alias("default_route"))


def _sessions(spark: SparkSession, folder: str) -> list[DataFrame]:
    """The plugins' and the remote servers of session folders; folders of packages and builds aren't entered."""
    files = configs.read_files(spark, folder).select("path", F.element_at(F.split("below", "/"), -1).alias("file"), F.col("content").cast("string").alias("text"))
    plugins = configs.config_servers(files.where("file = '.mcp.json'"), "path", "text")
    remotes = configs.remote_servers(files.where("file like 'local\\\\_%.json'"), "path", "text")
    none: Column = F.lit(None)
    named = remotes.select("path", S.remote_name(F.col("name"), F.col("url"), F.col("uuid")).alias("name"), none.cast("string").alias("command"), none.cast("array<string>").alias("args"), none.cast("map<string,string>").alias("env"), F.lit("http").alias("transport"), "url", "headers")
    return [_named(plugins, "cowork", "plugin", "cowork_plugin_mcp", PLUGIN_ROUTE), _labelled(named, "cowork", "remote", I.REMOTE_KIND, REMOTE_ROUTE)]


def discover_home(spark: SparkSession, home: str, cwd: str = "", client: str = "all", gateway: str = "gateway", platform: str = "linux") -> DataFrame:
    """The servers that a home folder's configurations and a working folder's own name, of one client or of all, once
    for each client, scope, kind, source and name, in order; an unknown client raises ValueError. Missing and broken
    files have no servers."""
    named = lambda path, *labels: _named(configs.config_servers(_file(spark, path), "path", "text"), *labels)
    user, desktop = f"{home}/.claude.json", f"{home}/{DESKTOP_PATHS.get(platform, DESKTOP_PATH)}"
    code = []
    if cwd:
        code.append(named(f"{cwd}/.mcp.json", "claude-code", "project", "project_mcp_json", "local_routable"))
        code.append(_named(configs.project_servers(_file(spark, user), "path", "text", cwd), "claude-code", "local", "claude_json_project", "local_routable"))
    code.append(named(f"{home}/.claude/settings.json", "claude-code", "global", "claude_code_settings", "local_routable"))
    code.append(named(user, "claude-code", "user", "claude_json_user", "local_routable"))
    sources = {
        "claude-code": code, "claude-desktop": [named(desktop, "claude-desktop", "global", "claude_desktop_config", "local_routable")],
        "cowork": [named(desktop, "cowork", "global", "claude_desktop_config", DESKTOP_ROUTE), *_sessions(spark, f"{desktop.rpartition('/')[0]}/{SESSIONS}")], "cursor": [named(f"{home}/.cursor/mcp.json", "cursor", "global", "cursor_mcp_json", "local_routable")],
    }
    kept = I.dedupe_discovered(I.discover_sources(sources, client).where("name <> ''"), ["source_order", "source_path"])
    parts = [I.discover(kept.where(F.col("default_route") == route), gateway, route) for route in ("local_routable", DESKTOP_ROUTE, PLUGIN_ROUTE, REMOTE_ROUTE)]
    return I.sort_discovered(reduce(DataFrame.unionByName, parts))
