"""Posture of a host from its state documents: values at any depth, checks, score and grade."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyrill.functions import jsonindex
from tallyrill.functions import servers as S

# Points that a failed check costs, grades by score, and the depth to which documents are searched.
POINTS = {"critical": 20, "high": 12, "medium": 6, "low": 3}
GRADES = ((90, "A"), (75, "B"), (60, "C"), (40, "D"))
DEEPEST = 12
REDACTED = "[REDACTED]"
SECRET_TEXT_TERMS = ("sk-", "token=", "secret=", "password=", "authorization:")
#: Keys under which extensions are granted folders, that of an enabled allowlist in dotted keys, and the names of the
#: blocklist document.
FOLDER_KEYS = ("allowed_directories", "allowedDirectories")
ALLOWLIST = "dxt:allowlistenabled"
BLOCKLISTS = ("extensions-blocklist.json", "extensions_blocklist", "extensionBlocklist")
# Names of plugin folders, of files of scheduled tasks and what in them reaches far, and limits of both walks.
REMOTE_PLUGINS, CACHED_PLUGINS = ("remote_cowork_plugins", "org-plugins", "org_plugins"), ("plugins", "cowork_plugins")
TASK_FILE_NAMES, TASK_FILE_ENDS = ("scheduled", "task"), (".json", ".md")
TASK_FILE_TERMS = ("websearch", "webfetch", "browser", "bash", "run_command", "write_file", "edit_file", "network", "filesystem")
WALK_DEPTH, TASK_FILES, TASK_FILE_BYTES, SKILL_EXAMPLES = 8, 100, 512 * 1024, 30
TASK_KEYS = ("cron", "cronExpression", "schedule", "prompt")
TASK_TERMS = ("websearch", "webfetch", "browser", "bash", "run_command", "write_file", "edit_file", "network", "filesystem", "mcp")


#: Bytes of documents indexed at once; a longer one is indexed alone.
INDEX_BYTES = 1 << 20


def _plain_key(raw: bytes) -> bytes:
    return json.dumps(json.loads(raw), ensure_ascii=False)[1:-1].encode("utf-8", "surrogatepass")


def find_values(docs: DataFrame, doc_id: str, text: str, keys: Sequence[str], deepest: int = DEEPEST) -> DataFrame:
    """(doc_id, key, value) of every value that stands under one of the keys at any depth down to ``deepest`` below the
    top; value is its JSON text. All depths are read off one structural index, so documents are passed over once and
    nothing is shuffled. A null text and one that is no complete JSON have no values; repeated rows repeat theirs."""
    keys = list(dict.fromkeys(keys))
    names = [json.dumps(k, ensure_ascii=False)[1:-1].encode() for k in keys]
    kind = docs.schema[doc_id].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, texts = 0, 0, batch.column(1).to_pylist()
            for i, text in enumerate(texts):
                held += len(text)
                if held < INDEX_BYTES and i + 1 < len(texts):
                    continue
                index = jsonindex.build([t.encode() for t in texts[start : i + 1]])
                number = index.keys_in(names, _plain_key)
                rows = np.flatnonzero((number >= 0) & (index.depth <= deepest + 1))
                if len(rows):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(start + index.text[rows])), pa.array([keys[k] for k in number[rows]], pa.string()), pa.array([index.raw(r).decode("utf-8", "replace") for r in rows], pa.string())], names=["_id", "key", "value"])
                start, held = i + 1, 0

    slim = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where("_text is not null")
    return slim.mapInArrow(find, f"_id {kind}, key string, value string").withColumnRenamed("_id", doc_id)


def _under(value: object, key: str, depth: int = 0) -> list:
    """The values under a key at any depth."""
    if depth > DEEPEST:
        return []
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in ([v] if k == key else []) + _under(v, key, depth + 1)]
    return [x for v in value for x in _under(v, key, depth + 1)] if isinstance(value, list) else []


def _true(value: object) -> bool:
    return value is True or isinstance(value, str) and value.lower() == "true"


def _tri(value: object) -> bool | None:
    if isinstance(value, bool):
        return value
    return {"true": True, "false": False}.get(value.strip().lower()) if isinstance(value, str) else None


def _texts(value: object) -> list[str]:
    if isinstance(value, list):
        return [v for v in value if isinstance(v, str) and v]
    if isinstance(value, dict):
        return [k for k, v in value.items() if _true(v)]
    return [value] if isinstance(value, str) and value else []


def _first_text(value: dict, *keys: str) -> str:
    return next((value[k] for k in keys if isinstance(value.get(k), str) and value[k]), "")


def _any_term(text: str, terms: Sequence[str]) -> bool:
    return any(t in text.lower() for t in terms)


def _hooks(value: object, top: bool = True) -> tuple[int, int, set[str]]:
    """Count, risky ones and names of hooks; at the top, an object's keys are names."""
    if isinstance(value, dict) and top:
        parts = [_hooks(v, False) for v in value.values()]
        return sum(p[0] for p in parts), sum(p[1] for p in parts), set(value).union(*(p[2] for p in parts))
    if isinstance(value, list):
        parts = [_hooks(v, False) for v in value]
        return sum(p[0] for p in parts), sum(p[1] for p in parts), set().union(*(p[2] for p in parts))
    if isinstance(value, dict):
        risky = any(_any_term(v if isinstance(v, str) else json.dumps(v), S.RISKY_HOOK_TERMS) for v in value.values() if isinstance(v, (str, list, dict)))
        return 1, int(risky), {n} if (n := _first_text(value, "name", "event", "type")) else set()
    return (1, int(_any_term(value, S.RISKY_HOOK_TERMS)), set()) if isinstance(value, str) else (0, 0, set())


def _connectors(value: object) -> set[str]:
    if isinstance(value, dict):
        return {k for k, v in value.items() if _true(v) or isinstance(v, dict) and any(_true(v.get(f)) for f in ("enabled", "connected", "authenticated"))}
    if isinstance(value, list):
        return {n for v in value if (n := v if isinstance(v, str) else _first_text(v, "name", "id", "service") if isinstance(v, dict) else "")}
    return set(_texts(value))


def _extensions(value: object) -> list[dict]:
    if isinstance(value, dict):
        inner = next((value[k] for k in ("installations", "extensions") if k in value), None)
        return _extensions(inner) if inner is not None else [v for v in value.values() if isinstance(v, dict)]
    return [v for v in value if isinstance(v, dict)] if isinstance(value, list) else []


def _signature(extension: dict) -> str:
    info = extension.get("signatureInfo")
    return _first_text(extension, "signatureStatus", "signature_status") or (_first_text(info, "status", "signatureStatus") if isinstance(info, dict) else "")


def _tools(value: object) -> set[str]:
    if isinstance(value, dict):
        return set(value)
    return {n for v in value if (n := v if isinstance(v, str) else _first_text(v, "name", "tool", "id") if isinstance(v, dict) else "")} if isinstance(value, list) else set()


def _broad(folder: str, home: str = "") -> bool:
    """Whether a folder is a root, the home folder, a drive, or a documents or desktop folder."""
    clean = lambda path: "/" + p.lstrip("/") if (p := posixpath.normpath(path.replace("\\", "/"))).startswith("/") else p
    plain = clean(folder).strip()
    lower = plain.lower()
    return plain in ("/", "~", ".") or lower in (clean(home).lower(), "c:", "c:/", "%userprofile%") or lower.endswith(("/documents", "/desktop"))


def _size(value: object) -> int:
    """Items of a list, or of an object's ``items``, else its ``entries``, else its own keys."""
    if isinstance(value, dict):
        return next((_size(value[k]) for k in ("items", "entries") if k in value), len(value))
    return len(value) if isinstance(value, list) else 0


def flatten(document: object) -> Iterator[tuple[str, object]]:
    """The dotted key and value of every member of an object and of the objects in it, inner ones included, however deep;
    lists are not entered."""
    held = [("", document)]
    while held:
        prefix, value = held.pop()
        for k, v in value.items() if isinstance(value, dict) else ():
            key = f"{prefix}.{k}" if prefix else k
            yield key, v
            held.append((key, v))


def _tasks(value: object) -> tuple[int, int]:
    """Task definitions and those that reach for tools or the network."""
    if isinstance(value, list):
        parts = [_tasks(v) for v in value]
        return sum(p[0] for p in parts), sum(p[1] for p in parts)
    if isinstance(value, dict):
        own = any(k in value for k in TASK_KEYS)
        parts = [_tasks(v) for v in value.values() if isinstance(v, (list, dict))] if not own else []
        sensitive = own and _any_term(json.dumps(_redact(value)), TASK_TERMS)
        return own + sum(p[0] for p in parts), sensitive + sum(p[1] for p in parts)
    return 0, 0


FACTS = (
    "keep_awake boolean, preferences boolean, scheduled_tasks boolean, web_search boolean, browser_actions boolean, sensitive_env boolean, servers int, active_sessions int, bridge boolean, domains array<string>, wildcard boolean, "
    "installed int, unsigned int, dangerous int, broad int, governed boolean, hooks int, risky_hooks int, hook_names array<string>, plugins int, connectors int, tasks int, sensitive_tasks int, startup int, cookies int"
)


def document_facts(document: object, home: str = "") -> dict:
    """What the checks need to know of a host's state documents, given as one object of documents; ``home`` is the
    user's home folder, where it is known. Of the names of hooks the first 30 are listed, as the feature has it; the
    counts are whole."""
    doc = document if isinstance(document, dict) else {}
    prefs = doc.get("preferences") if isinstance(doc.get("preferences"), dict) else {}
    setting = lambda key: _tri(prefs[key]) if key in prefs else next((t for v in _under(doc, key)[:1] if (t := _tri(v)) is not None), None)
    either = [b for k in ("coworkScheduledTasksEnabled", "ccdScheduledTasksEnabled") if (b := setting(k)) is not None]
    servers = [v for v in doc["mcpServers"].values() if isinstance(v, dict)] if isinstance(doc.get("mcpServers"), dict) else []
    bridge = [v for b in _under(doc, "bridge_state") if isinstance(b, dict) for v in b.values() if isinstance(v, dict)]
    domains = sorted({d for v in _under(doc, "egressAllowedDomains") for d in _texts(v)})
    extensions = [e for v in _under(doc, "extensions")[:1] for e in _extensions(v)]
    hooks = [_hooks(v) for v in _under(doc, "hooks")]
    tasks = [_tasks(v) for k in ("scheduledTasks", "tasks") for v in _under(doc, k)]
    crons = len(_under(doc, "cron"))
    return {
        "keep_awake": _tri(prefs.get("keepAwakeEnabled")), "preferences": any(_tri(prefs.get(k)) is not None for k in ("keepAwakeEnabled", "menuBarEnabled")) or "sidebarMode" in prefs or bool(_first_text(prefs, "quickEntryShortcut")), "scheduled_tasks": any(either) if either else None, "web_search": setting("coworkWebSearchEnabled"), "browser_actions": setting("allowAllBrowserActions"),
        "sensitive_env": any(_any_term(k, S.SENSITIVE_KEY_TERMS) for s in servers if isinstance(s.get("env"), dict) for k in s["env"]), "servers": len(servers),
        "active_sessions": sum(map(_true, _under(doc, "hostLoopMode"))), "bridge": any(_true(b.get("enabled")) for b in bridge),
        "domains": [REDACTED if _any_term(d, SECRET_TEXT_TERMS) else d for d in domains], "wildcard": any(d.strip() in ("*", "0.0.0.0/0", "::/0") for d in domains),
        "installed": len(extensions), "unsigned": sum(_signature(e).lower() == "unsigned" for e in extensions), "dangerous": sum(len({t.lower() for v in _under(e, "tools") for t in _tools(v)} & set(S.DANGEROUS_TOOLS)) for e in extensions),
        "broad": sum(_broad(d, home) for k in FOLDER_KEYS for v in _under(doc, k) for d in _texts(v)),
        "governed": any(ALLOWLIST in k.lower() and _true(v) for k, v in flatten(doc)) or any(_size(v) for k in BLOCKLISTS for v in _under(doc, k)), "hooks": sum(h[0] for h in hooks), "risky_hooks": sum(h[1] for h in hooks), "hook_names": sorted(set().union(*(h[2] for h in hooks)))[:30],
        "plugins": len({p for v in _under(doc, "marketplaces") for p in _tools(v)}), "connectors": len({c for v in _under(doc, "connectors") for c in _connectors(v)}), "tasks": sum(t[0] for t in tasks) + crons, "sensitive_tasks": sum(t[1] for t in tasks),
        "startup": len([x for v in _under(doc, "startupEntries") for x in _texts(v)]), "cookies": len([x for v in _under(doc, "cookies") for x in _texts(v)]),
    }


def host_facts(df: DataFrame, text: str, into: str = "facts", home: str | None = None) -> DataFrame:
    """``df`` with the facts of a JSON text of state documents, read in batches; a text that is no JSON has those of an
    empty one. home: the column of each host's home folder, if there is one."""

    def load(t: str | None) -> object:
        try:
            return json.loads(t) if t else {}
        except ValueError:
            return {}

    @F.pandas_udf(FACTS)
    def facts(texts: pd.Series, homes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([document_facts(load(t), h or "") for t, h in zip(texts, homes)], columns=[f.split()[0] for f in FACTS.split(", ")])

    return df.withColumn(into, facts(text, F.col(home) if home else F.lit("")))


def _redact(value: object, key: str = "") -> object:
    if any(term in key.lower() for term in S.SENSITIVE_KEY_TERMS):
        return REDACTED
    if isinstance(value, dict):
        return {k: _redact(v, k) for k, v in sorted(value.items())}
    if isinstance(value, list):
        return [_redact(v) for v in value[:20]]
    if isinstance(value, str):
        if any(term in value.lower() for term in SECRET_TEXT_TERMS):
            return REDACTED
        raw = value.encode()
        return raw[:256].decode("utf-8", "ignore") + "..." if len(raw) > 256 else value
    return value


@F.pandas_udf(StringType())
def redacted_json(text: pd.Series) -> pd.Series:
    """A document with sensitive keys and texts blanked, lists cut to 20 and texts to 256 bytes; null if it is no JSON."""

    def one(t: str | None) -> str | None:
        try:
            return json.dumps(_redact(json.loads(t)), separators=(",", ":"), sort_keys=True) if t else None
        except ValueError:
            return None

    return text.map(one)


def check(status: str | Column, name: str, category: str, severity: str = "") -> Column:
    """A check's struct; a blank severity reads as info."""
    return F.struct((status if isinstance(status, Column) else F.lit(status)).alias("status"), F.lit(name).alias("check_name"), F.lit(category).alias("category"), F.lit(severity or "info").alias("severity"))


def flag_checks(flags: dict[str, Column]) -> Column:
    """The checks of a host's tri-state settings and counts, in order; a check with nothing to say is left out. A host
    whose platform isn't supported, or that has no data folder, has one skipped check.

    flags: supported, data_folder (bools, true where not given), keep_awake, scheduled_tasks, web_search,
    browser_actions (bools, null where unknown), sensitive_env (bool), active_sessions (int), bridge (bool), wildcard
    (bool), unsigned, dangerous, broad (ints), governed (bool), installed (int), hooks, risky_hooks, plugins, connectors,
    tasks, sensitive_tasks, startup, cookies, servers (ints), preferences (bool)."""
    n = lambda k: F.coalesce(flags.get(k, F.lit(0)), F.lit(0))
    b = lambda k, given=False: F.coalesce(flags.get(k, F.lit(None).cast("boolean")), F.lit(given))
    either = lambda bad, fail, good: F.when(bad, fail).otherwise(good)
    # names, categories and severities of the checks are fixed values
    checks = [
        F.when(b("keep_awake"), check("FAIL", "Claude Desktop Sleep Prevention", "runtime", "low")),
        F.when(b("scheduled_tasks"), check("FAIL", "Cowork Scheduled Tasks Enabled", "scheduled_tasks", "medium")),
        F.when(b("web_search"), check("FAIL", "Cowork Web Search Enabled", "egress", "low")),
        F.when(b("browser_actions"), check("FAIL", "Cowork Browser Actions", "browser", "high")).when(flags.get("browser_actions", F.lit(None).cast("boolean")).isNotNull(), check("PASS", "Cowork Browser Actions", "browser")),
        either(b("sensitive_env"), check("FAIL", "Cowork MCP Sensitive Environment", "mcp_servers", "medium"), check("PASS", "Cowork MCP Servers", "mcp_servers")),
        F.when(n("active_sessions") > 0, check("FAIL", "Cowork Active Dispatch", "dispatch", "high")).when(b("bridge"), check("FAIL", "Cowork Dispatch Bridge", "dispatch", "high")).otherwise(check("PASS", "Cowork Dispatch", "dispatch")),
        either(b("wildcard"), check("FAIL", "Cowork Egress Policy", "egress", "critical"), check("PASS", "Cowork Egress Policy", "egress")),
        F.when(n("installed") > 0, either(~b("governed"), check("FAIL", "DXT Extension Governance", "extensions", "high"), check("PASS", "DXT Extension Governance", "extensions"))),
        either(n("unsigned") + n("dangerous") + n("broad") > 0, check("FAIL", "DXT Extension Risk", "extensions", "medium"), check("PASS", "DXT Extensions", "extensions")),
        F.when(n("risky_hooks") > 0, check("FAIL", "Cowork Plugin Hooks", "plugins_hooks", "high")).when(n("hooks") > 0, check("FAIL", "Cowork Plugin Hooks", "plugins_hooks", "medium")).otherwise(check("PASS", "Cowork Plugin Hooks", "plugins_hooks")),
        either(n("plugins") > 0, check("FAIL", "Cowork Plugins And Marketplaces", "plugins", "low"), check("PASS", "Cowork Plugins", "plugins")),
        either(n("connectors") > 0, check("FAIL", "Cowork Connectors", "connectors", "low"), check("PASS", "Cowork Connectors", "connectors")),
        check("PASS", "Cowork Skills", "skills"),
        F.when(n("sensitive_tasks") > 0, check("FAIL", "Cowork Scheduled Task Definitions", "scheduled_tasks", "high")).when(n("tasks") > 0, check("FAIL", "Cowork Scheduled Task Definitions", "scheduled_tasks", "medium")).otherwise(check("PASS", "Cowork Scheduled Task Definitions", "scheduled_tasks")),
        either((n("startup") > 0) | b("keep_awake"), check("FAIL", "Claude Runtime State", "runtime", "low"), check("PASS", "Claude Runtime State", "runtime")),
        either(n("cookies") > 0, check("FAIL", "Claude Cookies Present", "cookies", "low"), check("PASS", "Claude Cookies Present", "cookies")),
        F.when(b("preferences"), check("PASS", "Claude Desktop Preferences", "claude_desktop_cowork")),
    ]
    skipped = F.when(~b("supported", True), check("SKIPPED", "Claude Desktop & Cowork Support", "claude_desktop_cowork")).when(~b("data_folder", True), check("SKIPPED", "Claude Desktop Data Directory", "claude_desktop_cowork"))
    return F.when(skipped.isNotNull(), F.array(skipped)).otherwise(F.filter(F.array(*checks), lambda x: x.isNotNull()))


def plugin_folders(folders: DataFrame, host: str, below: str, remote: Sequence[str] = REMOTE_PLUGINS, cached: Sequence[str] = CACHED_PLUGINS, deepest: int = WALK_DEPTH) -> DataFrame:
    """(host, remote_folders, cached_folders) from a row for each folder, by its path below the app's folder: those of
    plugins, by their names without case, down to ``deepest`` separators."""
    name = F.lower(F.element_at(F.split(below, "/"), -1))
    near = folders.where(F.size(F.split(below, "/")) - 1 <= deepest)
    return near.groupBy(host).agg(F.count_if(name.isin(list(remote))).alias("remote_folders"), F.count_if(name.isin(list(cached))).alias("cached_folders"))


def task_files(files: DataFrame, host: str, below: str, content: str, names: Sequence[str] = TASK_FILE_NAMES, ends: Sequence[str] = TASK_FILE_ENDS, most: int = TASK_FILES) -> DataFrame:
    """(host, task_files, sensitive_files) from a row for each file: those of scheduled tasks, by name, and how many of
    them hold a term that reaches far. Of a host the first ``most`` by path count, none over 512 KiB is read and none
    deeper than 8 separators is seen; these limits are the feature's."""
    name = F.lower(F.element_at(F.split(below, "/"), -1))
    own = files.where(F.size(F.split(below, "/")) - 1 <= WALK_DEPTH).where(F.exists(F.array(*map(F.lit, names)), lambda t: name.contains(t)) & F.exists(F.array(*map(F.lit, ends)), lambda t: name.endswith(t)))
    first = own.withColumn("__tr_n", F.row_number().over(Window.partitionBy(host).orderBy(below, content))).where(F.col("__tr_n") <= most)
    sensitive = (F.octet_length(content) <= TASK_FILE_BYTES) & S.holds_term(F.col(content), TASK_FILE_TERMS)
    return first.groupBy(host).agg(F.count(F.lit(1)).alias("task_files"), F.count_if(sensitive).alias("sensitive_files"))


def points(severity: Column) -> Column:
    lower = F.lower(F.coalesce(severity, F.lit("")))
    cost = F.lit(0)
    for name, value in POINTS.items():
        cost = F.when(lower == name, value).otherwise(cost)
    return cost


def grade(score: Column) -> Column:
    out = F.lit("F")
    for least, letter in reversed(GRADES):
        out = F.when(score >= least, letter).otherwise(out)
    return out


def score(checks: DataFrame, host: str) -> DataFrame:
    """(host, score, grade, passed, failed, skipped, fixed) from a row for each check (host, status, check_name,
    category, severity): of each category the costliest failure counts, down to 0. Statuses compare by their case."""
    failed = F.col("status") == "FAIL"
    category = F.coalesce(F.nullif("category", F.lit("")), F.col("check_name"))
    named = checks.select(F.col(host).alias("_host"), "status", category.alias("_category"), F.when(failed, points(F.col("severity"))).otherwise(0).alias("_points"))
    by_category = named.groupBy("_host", "_category").agg(F.max("_points").alias("_points"), *(F.count_if(F.col("status") == s).alias(n) for s, n in (("PASS", "passed"), ("FAIL", "failed"), ("SKIPPED", "skipped"), ("FIXED", "fixed"))))
    total = by_category.groupBy("_host").agg(F.greatest(F.lit(100) - F.sum("_points"), F.lit(0)).alias("score"), *(F.sum(n).alias(n) for n in ("passed", "failed", "skipped", "fixed")))
    return total.select(F.col("_host").alias(host), "score", grade(F.col("score")).alias("grade"), "passed", "failed", "skipped", "fixed")


def collection_size(text: Column) -> Column:
    """Items of a JSON text: a list's length; of an object its ``items``, else its ``entries``, else its own keys; 0 of
    anything else."""

    def plain(t: Column) -> Column:
        return F.coalesce(F.json_array_length(t), F.size(F.json_object_keys(t)))

    inner = [F.get_json_object(text, f"$.{k}") for k in ("items", "entries")]
    named = F.coalesce(F.array_contains(F.json_object_keys(text), "items"), F.lit(False)), F.coalesce(F.array_contains(F.json_object_keys(text), "entries"), F.lit(False))
    size = F.when(named[0], F.coalesce(plain(inner[0]), F.lit(0))).when(named[1], F.coalesce(plain(inner[1]), F.lit(0))).otherwise(F.coalesce(plain(text), F.lit(0)))
    return F.when(text.isNull(), 0).otherwise(F.greatest(size, F.lit(0)))


def bridge_counts(text: Column) -> Column:
    """(entries, consented, configured) of a bridge state: its object-valued members, those a user consented to, and
    whether one is enabled."""
    members = F.filter(F.map_values(F.from_json(text, "map<string,string>")), lambda v: F.coalesce(F.schema_of_variant(F.try_parse_json(v)).startswith("OBJECT"), F.lit(False)))
    true = lambda v, key: F.lower(F.coalesce(F.get_json_object(v, f"$.{key}"), F.lit(""))) == "true"
    members = F.coalesce(members, F.array().cast("array<string>"))
    return F.struct(F.size(members).alias("entries"), F.size(F.filter(members, lambda v: true(v, "userConsented"))).alias("consented"), F.exists(members, lambda v: true(v, "enabled")).alias("configured"))


def text_list(text: Column) -> Column:
    """The texts of a JSON value: of a list its non-empty strings, of an object the keys that are true, of a string
    itself; else none. Null where the text is no JSON."""
    value = F.try_parse_json(text)
    kind = F.schema_of_variant(value)
    none = F.array().cast("array<string>")
    items = F.from_json(text, "array<variant>")
    strings = F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))
    members = F.map_filter(F.from_json(text, "map<string,string>"), lambda _, v: F.lower(F.coalesce(v, F.lit(""))) == "true")
    single = F.try_variant_get(value, "$", "string")
    return F.when(kind.startswith("ARRAY"), F.filter(strings, lambda s: s != "")).when(kind.startswith("OBJECT"), F.array_sort(F.map_keys(members))).when((kind == "STRING") & (single != ""), F.array(single)).when(value.isNotNull(), none)
