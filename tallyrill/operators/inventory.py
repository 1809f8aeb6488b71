"""Discovery and inventory of servers and skills: normalise, classify, dedupe, cover, plan, report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrill.functions import servers as S

#: Columns by which two entries are the same server, their name aside.
ENTRY_COLUMNS = ("command", "args", "env", "transport", "url", "headers")

#: Own texts of the health report's next steps, by what calls for them, in order.
NEXT_STEPS = {
    "nothing": "Discover the supported client configurations.",
    "seen_only": "Plan the migration of servers that clients reach directly.",
    "direct_session": "Keep the guard running for sources made after setup.",
    "auth_required": "Reconnect remote servers that ask for a sign-in.",
    "unreachable": "Repair the connection to unreachable servers.",
    "pending": "Restart the client and make one harmless call.",
    "no_key": "Connect an account for synced policies.",
    "always": "Add servers by hand only where their source isn't supported.",
}

#: What the health report says of a server that asks for a sign-in, and the clients of discovery in order.
AUTH_ERROR = "remote MCP endpoint requires OAuth/auth headers; native Claude/Cowork connector auth is separate from the standalone local gateway"
CLIENTS = ("claude-code", "claude-desktop", "cowork", "cursor")
REMOTE_KIND = "cowork_remote_mcp_config"


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Of the rows of a key the first by an order; never an arbitrary one. Null keys are keys."""
    return df.withColumn("__tr_first", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__tr_first = 1").drop("__tr_first")


def dedupe_discovered(entries: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Entries once for each client, scope, kind, source and name; remote servers are told apart by address, whatever
    document lists them."""
    place = F.when(F.col("source_kind") == REMOTE_KIND, S.text(F.col("url"))).otherwise(S.text(F.col("source_path")))
    return keep_first(entries.withColumn("__tr_place", place), ["client", "scope", "source_kind", "__tr_place", "name"], order).drop("__tr_place")


def discover_sources(sources: Mapping[str, Sequence[DataFrame]], client: str = "all") -> DataFrame:
    """The union of the sources of one client, or of all in the order of ``CLIENTS``, with ``source_order``, the number
    of the source; an unknown client raises ValueError."""
    if client != "all" and client not in CLIENTS:
        raise ValueError(f"unknown client {client!r}")
    parts = [source for name in CLIENTS if client in ("all", name) for source in sources.get(name, ())]
    numbered = [part.withColumn("source_order", F.lit(n)) for n, part in enumerate(parts)]
    if not numbered:
        raise ValueError("no source given")
    return reduce(DataFrame.unionByName, numbered)


def discover(entries: DataFrame, gateway: str, default_route: str = "local_routable") -> DataFrame:
    """Named entries (name, client, scope, source_kind, source_path and ``ENTRY_COLUMNS``) with what discovery tells of
    them; values of environments and headers are dropped, only their keys stay."""
    routed = S.is_gateway(F.col("command"), F.col("args"), gateway)
    route = S.routeability(F.col("transport"), F.col("url"), F.col("command"), F.col("headers"), default_route)
    return entries.where(S.text(F.col("name")) != "").select(
        "name", "client", "scope", "source_kind", "source_path",
        S.short_hash(F.col("source_path")).alias("source_hash"),
        S.transport_exact(F.col("transport"), F.col("url")).alias("transport"),
        S.text(F.col("command")).alias("command"), S.text(F.col("url")).alias("url"),
        F.size(F.coalesce("args", F.array().cast("array<string>"))).alias("args_count"),
        S.sorted_keys(F.col("env")).alias("env_keys"), S.sorted_keys(F.col("headers")).alias("header_keys"),
        F.when(routed, "routed").otherwise("direct").alias("route_state"),
        F.when(routed, "local_routable").otherwise(route["label"]).alias("routeability"),
        (~routed & route["routable"]).alias("routable"),
        S.text(F.try_element_at("args", F.lit(1))).alias("first_arg"),
        entry_key().alias("entry_key"),
    )


def entry_key() -> Column:
    """A hash of a whole entry but its name; absent and empty fields are alike."""
    parts = [S.text(F.col(c)) for c in ("command", "transport", "url")]
    maps = [F.to_json(F.array_sort(F.map_entries(F.coalesce(c, F.create_map().cast("map<string,string>"))))) for c in ("env", "headers")]
    return F.sha2(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts)), F.coalesce("args", F.array().cast("array<string>")).alias("args"), *(m.alias(f"m{i}") for i, m in enumerate(maps)))), 256)


def sort_discovered(df: DataFrame) -> DataFrame:
    return df.orderBy("client", "source_kind", "scope", "name", "source_path")


def cover(discovered: DataFrame, backends: DataFrame) -> DataFrame:
    """Adds ``gateway_covered`` and ``gateway_name``: the first backend (name, entry_key, position) whose whole entry
    equals the discovered one. Routed rows aren't looked up."""
    first = backends.groupBy("entry_key").agg(F.min_by("name", "position").alias("gateway_name"))
    joined = discovered.join(first, "entry_key", "left")
    name = F.when(F.col("route_state") != "routed", F.col("gateway_name"))
    return joined.withColumn("gateway_covered", name.isNotNull()).withColumn("gateway_name", S.text(name))


def coverage(discovered: DataFrame, n_backends: Column | int) -> DataFrame:
    """One row: routed, direct, routable and covered direct rows, and the verdict they lead to."""
    direct = F.col("route_state") == "direct"
    counts = discovered.agg(
        F.count_if(F.col("route_state") == "routed").alias("routed"), F.count_if(direct).alias("direct"), F.count_if(direct & F.col("routable")).alias("routable"), F.count_if(direct & F.col("gateway_covered")).alias("covered_direct")
    ).withColumn("backends", n_backends if isinstance(n_backends, Column) else F.lit(n_backends))
    only = (F.col("routed") > 0) & (F.col("direct") == 0)
    verdict = (
        F.when(only & (F.col("backends") == 0), "cowork_gateway_entrypoint_routed_but_no_backends_configured").when(only, "cowork_local_mcp_routed_native_connectors_require_zip")
        .when((F.col("routed") > 0) & (F.col("direct") > 0), "cowork_gateway_routed_but_direct_bypass_detected").when((F.col("direct") > 0) & (F.col("covered_direct") > 0), "cowork_gateway_covered_but_direct_bypass_detected")
        .when(F.col("routable") > 0, "cowork_servers_discovered_not_routed").otherwise("no_cowork_servers_discovered")
    )
    return counts.withColumn("verdict", verdict)


def disposition(gateway: str, stale_name: str) -> Column:
    """What a migration does with a discovered row: ``stale`` (rewritten), ``native_kept``, ``left`` or ``direct``."""
    stale = (F.col("route_state") != "routed") & (F.col("name") == stale_name) & (S.basename(F.col("command")) == gateway.rpartition("/")[2]) & (F.col("first_arg") == "server")
    return F.when(stale, "stale").when(F.col("routeability") == "native_client_auth_required", "native_kept").when((F.col("route_state") == "routed") | ~F.col("routable"), "left").otherwise("direct")


def migration_plan(discovered: DataFrame, gateway: str, stale_name: str, by: Sequence[str] = ("client", "source_path")) -> DataFrame:
    """One row for each client and source path, or project of a client: names to migrate, names kept for their own
    sign-in, whether the file needs a rewrite and whether it is routed already."""
    marked = discovered.withColumn("d", disposition(gateway, stale_name))
    names = lambda which: F.array_sort(F.collect_list(F.when(F.col("d") == which, F.col("name"))))
    settled = F.bool_and((F.col("route_state") == "routed") | (F.col("d") == "native_kept"))
    plan = marked.groupBy(*by).agg(names("direct").alias("migrated"), names("native_kept").alias("native_kept"), F.count_if(F.col("d") == "stale").alias("_stale"), F.bool_or(F.col("route_state") == "routed").alias("_routed"), settled.alias("_settled"))
    rewrite = (F.size("migrated") > 0) | (F.col("_stale") > 0) | ((F.size("native_kept") > 0) & ~F.col("_routed"))
    return plan.withColumn("needs_rewrite", rewrite).withColumn("already_routed", ~rewrite & F.col("_settled")).drop("_stale", "_routed", "_settled")


def guard_summary(plans: DataFrame, migrated: str = "migrated", disabled: str = "native_disabled") -> DataFrame:
    """One row: (plans, migrated, disabled), how many plans there are and the names that they migrate and disable."""
    names = lambda column: F.coalesce(F.sum(F.when(F.col(column).isNotNull(), F.size(column))), F.lit(0))
    return plans.agg(F.count(F.lit(1)).alias("plans"), names(migrated).alias("migrated"), names(disabled).alias("disabled"))


def skill_source(path: Column) -> Column:
    """scheduled, plugin or session, by what a skill file's path holds."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.lower(plain).contains("scheduled"), "scheduled").when(plain.contains("/skills-plugin/"), "plugin").otherwise("session")


def skill_counts(files: DataFrame, path: str = "path") -> DataFrame:
    """One row: (total, scheduled, plugin, session) of the files named SKILL.md, by their source."""
    own = files.where(F.element_at(F.split(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "/"), -1) == "SKILL.md").select(skill_source(F.col(path)).alias("_source"))
    return own.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("_source") == s).alias(s) for s in ("scheduled", "plugin", "session")))


def free_names(rows: DataFrame, taken: DataFrame, order: Sequence[str] = ("entry_key",)) -> DataFrame:
    """``gateway_name`` for new rows (name, entry_key, source_hash, *order): no name stands for two entries.

    A row whose entry has its name already keeps it. A name that is free goes to its first entry by ``order``; other
    entries get the name with a hash of name and source, and a number from 2 on where several entries or a taken name
    want that one. taken: (name, entry_key)."""
    known = taken.groupBy("name").agg(F.min("entry_key").alias("_owner")).withColumnRenamed("name", "_n")
    seen = rows.join(known, F.col("name") == F.col("_n"), "left")
    first = F.first("entry_key").over(Window.partitionBy("name").orderBy(*order, "entry_key"))
    owned = seen.withColumn("_own", F.coalesce("_owner", first) == F.col("entry_key"))
    base = F.when(S.clean_name(F.col("name")) == "", "mcp").otherwise(S.clean_name(F.col("name")))
    hashed = owned.withColumn("_hashed", F.concat_ws("-", base, S.short_hash(F.concat_ws("|", "name", "source_hash"))))
    hashed = hashed.withColumn("_met", F.min(F.struct(*order)).over(Window.partitionBy("_own", "_hashed", "entry_key")))
    place = F.dense_rank().over(Window.partitionBy("_own", "_hashed").orderBy("_met", "entry_key"))
    # numbers of a hashed name that a taken or kept name stands for already; the name itself is number 1
    claimed = taken.select("name").union(owned.where("_own").select("name")).distinct().select(F.explode(F.array(F.struct(F.col("name").alias("_stem"), F.lit(1).alias("_no")), F.struct(F.regexp_replace("name", "-[0-9]+$", "").alias("_stem"), F.expr("try_cast(regexp_extract(name, '-([0-9]+)$', 1) AS int)").alias("_no")))).alias("c")).select("c.*").where("_no is not null")
    wanted = hashed.where("not _own").select(F.col("_hashed").alias("_stem")).distinct()
    blocked = claimed.join(wanted, "_stem", "left_semi").groupBy("_stem").agg(F.collect_set("_no").alias("_blocked"))
    numbered = hashed.withColumn("_place", place).join(blocked, F.col("_hashed") == F.col("_stem"), "left").withColumn("_blocked", F.coalesce("_blocked", F.array().cast("array<int>")))
    number = F.element_at(F.array_except(F.sequence(F.lit(1), F.col("_place") + F.size("_blocked")), "_blocked"), F.col("_place"))
    named = F.when(F.col("_own"), F.col("name")).when(number == 1, F.col("_hashed")).otherwise(F.concat_ws("-", "_hashed", number.cast("string")))
    return numbered.withColumn("gateway_name", named).select(*rows.columns, "gateway_name")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table without the rows' keys, and the rows."""
    return table.join(rows.select(key), key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def match_remotes(remotes: DataFrame, direct: DataFrame) -> DataFrame:
    """Each remote server (uuid, name, url) with ``disabled``: whether a migrated row has its id, or else its name
    without case and its address."""
    by_id = direct.where(F.trim(S.text(F.col("remote_id"))) != "").select(F.col("remote_id").alias("uuid"), F.lit(True).alias("_id")).distinct()
    key = lambda n, u: F.concat_ws("\x00", F.lower(F.trim(S.text(n))), F.trim(S.text(u)))
    by_name = direct.select(key(F.col("name"), F.col("url")).alias("_key"), F.lit(True).alias("_named")).distinct()
    named = remotes.withColumn("_key", key(S.remote_name(F.col("name"), F.col("url"), F.col("uuid")), F.col("url")))
    return named.join(by_id, "uuid", "left").join(by_name, "_key", "left").withColumn("disabled", F.coalesce("_id", "_named", F.lit(False))).select(*remotes.columns, "disabled")


def without_tools(tools: Column, ids: Column) -> Column:
    """A map of enabled tools without the keys that start with one of the ids and a colon."""
    return F.map_filter(tools, lambda k, _: ~F.exists(ids, lambda i: k.startswith(F.concat(i, F.lit(":")))))


def prune_kept(backends: DataFrame, kept: DataFrame) -> DataFrame:
    """Backends without those that a client keeps for its own sign-in (same name and address)."""
    marks = kept.where("name <> '' and url <> ''").select("name", "url", F.lit(True).alias("_kept")).distinct()
    native = S.needs_native_auth(F.col("transport"), F.col("url"), F.col("headers"))
    return backends.join(marks, ["name", "url"], "left").where(F.col("_kept").isNull() | ~native).select(*backends.columns)


def backend_health(backends: DataFrame, last_calls: DataFrame) -> DataFrame:
    """(name, transport, status, error, last_call_at, last_tool_name): pending, auth_required or auth_configured by an
    http server's address and headers; a call that was seen settles it."""
    transport = S.transport_loose(F.col("transport"), F.col("url"))
    authorised = S.has_header(F.col("headers"), ("authorization",))
    known = F.lit(False)
    for host in S.OAUTH_HOSTS:
        known |= F.lower(F.trim(S.text(F.col("url")))).contains(host)
    joined = backends.join(last_calls, F.col("name") == F.col("server_name"), "left")
    seen = F.col("server_name").isNotNull()
    http = transport == "http"
    status = F.when(seen, "calls_observed").when(http & known & ~authorised, "auth_required").when(http & authorised, "auth_configured").otherwise("pending")
    return joined.select("name", transport.alias("transport"), status.alias("status"), F.when(status == "auth_required", AUTH_ERROR).otherwise("").alias("error"), S.text(F.col("last_call_at")).alias("last_call_at"), S.text(F.col("last_tool_name")).alias("last_tool_name"))


def health_detail() -> Column:
    """The error, else the last call."""
    called = F.when((F.col("last_tool_name") != "") & (F.col("last_call_at") != ""), F.format_string("last call %s at %s", "last_tool_name", "last_call_at")).when(F.col("last_call_at") != "", F.concat(F.lit("last call at "), "last_call_at")).otherwise("")
    return F.when(F.col("error") != "", F.col("error")).otherwise(called)


def health_summary(health: DataFrame) -> DataFrame:
    """One row: backends by status, and what the tools' manifest status is."""
    n = lambda s: F.count_if(F.col("status") == s)
    counts = health.agg(F.count(F.lit(1)).alias("backends"), *(n(s).alias(s) for s in ("pending", "auth_required", "auth_configured", "calls_observed", "tools_observed", "unreachable")))
    status = F.when(F.col("backends") == 0, "unknown").when(F.col("auth_required") + F.col("unreachable") > 0, "action_required").when(F.col("tools_observed") + F.col("calls_observed") > 0, "observed").otherwise("pending")
    return counts.withColumn("manifest_status", status)


def next_steps(discovered: Column, backends: Column, seen_only: Column, direct_session: Column, auth_required: Column, unreachable: Column, waiting: Column, connected: Column) -> Column:
    """The health report's ordered advice; waiting: backends that are pending or whose sign-in is set up."""
    steps = [("nothing", (discovered == 0) & (backends == 0)), ("seen_only", seen_only > 0), ("direct_session", direct_session), ("auth_required", auth_required > 0), ("unreachable", unreachable > 0), ("pending", waiting > 0), ("no_key", ~connected), ("always", F.lit(True))]
    return F.filter(F.array(*(F.when(c, F.lit(NEXT_STEPS[k])) for k, c in steps)), lambda x: x.isNotNull())


def seen_only(discovered: DataFrame, gateway_name: str, client: str = "cowork") -> DataFrame:
    """One row: (discovered, seen_only, direct_session), the discovered rows, those that could be routed and aren't, the
    gateway's own name aside, and whether one of them is the given client's."""
    open_ = (F.col("route_state") != "routed") & F.col("routable")
    return discovered.agg(F.count(F.lit(1)).alias("discovered"), F.count_if(open_ & (F.col("name") != gateway_name)).alias("seen_only"), F.coalesce(F.bool_or(open_ & (F.col("client") == client)), F.lit(False)).alias("direct_session"))


def connection_mode(usable_key: Column, managed: Column) -> Column:
    return F.when(usable_key, "api_key").when(managed, "managed_runtime_broker").otherwise("local_only")


def health_report(discovered: DataFrame, health: DataFrame, gateway_name: str, usable_key: Column, managed: Column) -> DataFrame:
    """The assembled report, one row: counts of discovered rows and backends, the tools' manifest status, how the gateway
    is connected, and the ordered next steps. Both inputs are folded to one row each before they meet."""
    found, summary = seen_only(discovered, gateway_name), health_summary(health)
    both = found.join(F.broadcast(summary), F.lit(True))  # one row each
    steps = next_steps(F.col("discovered"), F.col("backends"), F.col("seen_only"), F.col("direct_session"), F.col("auth_required"), F.col("unreachable"), F.col("pending") + F.col("auth_configured"), usable_key | managed)
    return both.select("discovered", "seen_only", "direct_session", "backends", "manifest_status", connection_mode(usable_key, managed).alias("connection_mode"), (usable_key | managed).alias("connected"), steps.alias("next_steps"))


def inventory(items: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Skills or servers (name, source, platform, ...) once for each name, source and platform, the first by order."""
    return keep_first(items, ["name", "source", "platform"], order).orderBy("platform", "source", "name")


def tool_cache_summary(cache: DataFrame, status: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    """One row: backends with tools, all tools, degraded backends; of configured servers only, where any are given.

    cache: (server, tools array); status: (server, status)."""
    if configured is not None:
        names = configured.select("server").distinct()
        cache, status = cache.join(names, "server", "left_semi"), status.join(names, "server", "left_semi")
    else:
        status = status.join(cache.select("server").distinct(), "server", "left_semi")
    both = cache.select("server", F.size(F.coalesce("tools", F.array())).alias("n"), F.lit(0).alias("d")).unionByName(status.select("server", F.lit(0).alias("n"), (F.col("status") == "degraded").cast("int").alias("d")))
    return both.agg(F.count_if(F.col("n") > 0).alias("backends"), F.coalesce(F.sum("n"), F.lit(0)).alias("tools"), F.coalesce(F.sum("d"), F.lit(0)).alias("degraded"))


def namespaced_tools(cache: DataFrame, built_in: Mapping[str, str] | None = None) -> DataFrame:
    """(tool, server, original) of every cached tool, the built-in ones first by name; a tool named twice belongs to
    the later server in order. cache: (server, tools array<string>)."""
    each = cache.select("server", F.explode("tools").alias("original")).withColumn("tool", S.namespaced(F.col("server"), F.col("original")))
    own = keep_first(each, ["tool"], [F.desc("server")])
    if not built_in:
        return own.select("tool", "server", "original")
    extra = cache.sparkSession.createDataFrame([(k, "", v) for k, v in built_in.items()], "tool string, server string, original string")
    return extra.unionByName(own.select("tool", "server", "original"))
