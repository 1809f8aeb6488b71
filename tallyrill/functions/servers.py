"""Scalar functions over server entries: transports, routes, names, hashes, headers, keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CREDENTIAL_HEADERS = ("authorization", "proxy-authorization", "cookie", "x-api-key", "api-key", "x-auth-token", "x-access-token")
OAUTH_HOSTS = ("mcp.notion.com", "mcp.raindrop.ai", "mcp.linear.app")
SENSITIVE_KEY_TERMS = ("token", "secret", "password", "passwd", "api_key", "apikey", "authorization", "cookie", "oauth", "private_key", "privatekey", "client_secret", "access_key", "refresh")
RISKY_HOOK_TERMS = ("bash", "sh ", "zsh", "powershell", "cmd.exe", "curl", "wget", "invoke-webrequest", "net.webclient", "nc ", "ncat", "socat", "python -c", "node -e")
DANGEROUS_TOOLS = ("execute_javascript", "write_file", "edit_file", "run_command", "execute_sql", "bash", "shell")


def text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def transport_exact(transport: Column, url: Column) -> Column:
    """Discovery's transport: sse and streamable-http are http, other names stay as they are, case included."""
    given = text(transport)
    return F.when(given.isin("streamable-http", "sse"), "http").when(given != "", given).when(text(url) != "", "http").otherwise("stdio")


def transport_loose(transport: Column, url: Column) -> Column:
    """The health report's transport: trimmed and in lower case first."""
    given = F.lower(F.trim(text(transport)))
    return F.when(given.isin("http", "sse", "streamable-http"), "http").when(given != "", given).when(F.trim(text(url)) != "", "http").otherwise("stdio")


def has_header(headers: Column, names: Sequence[str]) -> Column:
    """Whether one of the named headers, without case, has a value that isn't blank."""
    return F.size(F.map_filter(F.coalesce(headers, F.create_map().cast("map<string,string>")), lambda k, v: F.lower(F.trim(k)).isin(list(names)) & (F.trim(text(v)) != ""))) > 0


def needs_native_auth(transport: Column, url: Column, headers: Column) -> Column:
    """Whether a remote server relies on its client's own sign-in: reached over http and without a credential header."""
    remote = (F.trim(text(url)) != "") & F.lower(F.trim(text(transport))).isin("", "http", "sse", "streamable-http")
    return remote & ~has_header(headers, CREDENTIAL_HEADERS)


def routeability(transport: Column, url: Column, command: Column, headers: Column, default: str = "local_routable") -> Column:
    """(label, routable) of an entry."""
    outcome = lambda label, routable: F.struct(F.lit(label).alias("label"), F.lit(routable).alias("routable"))
    if default == "cowork_remote_connector_not_local_routable":
        return outcome(default, False)
    kind = transport_exact(transport, url)
    blank_url, blank_command = F.trim(text(url)) == "", F.trim(text(command)) == ""
    review = F.when(kind == "http", blank_url).when(kind.isin("stdio", "local"), blank_command).otherwise(blank_url & blank_command)
    return F.when(review, outcome("cowork_unknown_requires_review", False)).when((kind == "http") & needs_native_auth(transport, url, headers), outcome("native_client_auth_required", False)).otherwise(outcome(default, True))


def clean_name(name: Column) -> Column:
    """Letters, digits, dash, underscore and dot; every other character a dash; no dashes at the ends."""
    return F.regexp_replace(F.regexp_replace(text(name), "(?s)[^A-Za-z0-9_.-]", "-"), "^-+|-+$", "")


def backup_name(name: Column) -> Column:
    """As ``clean_name`` with underscores and nothing trimmed."""
    return F.regexp_replace(text(name), "(?s)[^A-Za-z0-9_.-]", "_")


def short_hash(value: Column, digits: int = 12) -> Column:
    """The first hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text(value), 256), 1, digits)


def stable_hash(value: Column) -> Column:
    """16 digits; the empty text has an empty hash."""
    return F.when(text(value) == "", "").otherwise(short_hash(value, 16))


def remote_name(name: Column, url: Column, uuid: Column) -> Column:
    """A remote server's name: its own, else its host, else one made of its id, else a constant."""
    own = F.lower(clean_name(F.replace(F.trim(text(name)), F.lit(" "), F.lit("-"))))
    host = F.lower(clean_name(F.substring_index(F.regexp_replace(F.regexp_replace(text(url), "^https://", ""), "^http://", ""), "/", 1)))
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(filled(own), filled(host), F.when(F.trim(text(uuid)) != "", F.concat(F.lit("remote-"), short_hash(uuid))), F.lit("remote-mcp"))


def sorted_keys(mapping: Column) -> Column:
    """A map's keys in order, without its values; null where it has none."""
    keys = F.array_sort(F.map_keys(mapping))
    return F.when(F.size(keys) > 0, keys)


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(F.trim(text(path)), "/+$", ""), "/"), -1)


def starts_gateway(command: Column, args: Column, gateway: str) -> Column:
    """Whether an entry starts the gateway or another copy of it: by its base name, with ``server`` as the first argument."""
    return (basename(command) == gateway.rpartition("/")[2]) & (text(F.try_element_at(args, F.lit(1))) == "server")


def is_gateway(command: Column, args: Column, gateway: str) -> Column:
    """Whether an entry starts the gateway itself: by its path where that is known, else by its base name."""
    exact = (F.trim(text(command)) == gateway) if "/" in gateway else F.lit(True)
    return starts_gateway(command, args, gateway) & exact


def render_command(url: Column, command: Column, args: Column) -> Column:
    """The address, or the command with its arguments, or a mark for neither."""
    line = F.concat_ws(" ", F.array(F.trim(text(command))), F.coalesce(args, F.array().cast("array<string>")))
    return F.when(F.trim(text(url)) != "", text(url)).when(F.trim(text(command)) == "", "(empty command)").otherwise(line)


def inventory_command(command: Column, args: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.array(text(command)), F.coalesce(args, F.array().cast("array<string>"))))


def holds_term(value: Column, terms: Sequence[str]) -> Column:
    """Whether a text holds one of the terms, without case."""
    lower = F.lower(text(value))
    condition = F.lit(False)
    for term in terms:
        condition |= lower.contains(term)
    return condition


def has_wildcard(values: Column) -> Column:
    return F.exists(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(text(v)).isin("*", "0.0.0.0/0", "::/0"))


def preview(content: Column, most: int = 300) -> Column:
    """The first bytes of a file's content, as binary: a character may be cut."""
    return F.substring(content.cast("binary"), 1, most)


def truncated(value: Column, most: int) -> Column:
    """A text cut to so many bytes with ``...`` behind, if it is longer."""
    return F.when(F.octet_length(value) > most, F.concat(F.substring(value.cast("binary"), 1, most).cast("string"), F.lit("..."))).otherwise(value)


def display_name(value: Column, terms: Sequence[str], most: int = 80) -> Column:
    """A name as a report shows it: blanked where it holds one of the terms, else its first bytes."""
    return F.when(holds_term(value, terms), "[REDACTED]").otherwise(F.substring(text(value).cast("binary"), 1, most).cast("string"))


def redacted_domains(domains: Column, terms: Sequence[str]) -> Column:
    return F.transform(domains, lambda d: F.when(holds_term(d, terms), "[REDACTED]").otherwise(d))


def expand_home(path: Column, home: Column) -> Column:
    """``~`` alone or before a slash as the home folder."""
    return F.when(path == "~", home).when(path.startswith("~/"), F.concat(home, F.substr(path, F.lit(2)))).otherwise(path)


def server_type(kind: Column, url: Column) -> Column:
    """A server's own type, else http where it has an address, else stdio."""
    return F.when(text(kind) != "", text(kind)).when(text(url) != "", "http").otherwise("stdio")


def file_hash(content: Column) -> Column:
    """The whole SHA-256 of a file's bytes; null for a file that can't be read."""
    return F.when(content.isNotNull(), F.sha2(content.cast("binary"), 256))


def log_text(value: Column, most: int) -> Column:
    return truncated(F.translate(value, "\n\r", "  "), most)


def tri_bool(value: Column) -> Column:
    """True, false or null of a bool or of the texts true and false, trimmed and without case."""
    lower = F.lower(F.trim(value.cast("string")))
    return F.when(lower == "true", True).when(lower == "false", False)


def namespaced(server: Column, tool: Column) -> Column:
    return F.concat_ws("__", text(server), text(tool))


def original_tool(server: Column, tool: Column) -> Column:
    """The tool's own name: without the server's prefix, if it has it."""
    prefix = F.concat(text(server), F.lit("__"))
    return F.when(tool.startswith(prefix), F.substr(tool, F.length(prefix) + 1)).otherwise(tool)


# Serial numbers that stand for none.
HOLLOW_SERIALS = ("", "tobefilledbyo.e.m.", "defaultstring", "systemserialnumber", "none", "unknown", "notspecified")


def machine_key(raw: Column) -> Column:
    """A machine id in lower case without white space."""
    return F.lower(F.regexp_replace(text(raw), r"\s+", ""))


def platform_uuid(report: Column) -> Column:
    """The platform UUID of a hardware registry report, as a machine key; empty where there is none."""
    return machine_key(F.regexp_extract(text(report), r'"IOPlatformUUID"\s*=\s*"([^"]+)"', 1))


def device_id(report: Column) -> Column:
    return F.lower(F.regexp_extract(text(report), r"(?im)^\s*(?:DeviceId|Device\s+Id)\s*:\s*([0-9a-fA-F-]{36})\s*$", 1))


def registry_guid(report: Column) -> Column:
    return F.lower(F.regexp_extract(text(report), r"(?im)\bMachineGuid\b\s+REG_SZ\s+([0-9a-fA-F-]{8,})\s*$", 1))


def firmware_uuid(report: Column) -> Column:
    """A firmware UUID; those of only zeros or only f stand for none."""
    key = machine_key(report)
    return F.when(key.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$") & ~key.rlike("^[0-]+$|^[f-]+$"), key).otherwise("")


def firmware_serial(report: Column) -> Column:
    """A serial number; zeros and factory texts stand for none."""
    key = machine_key(report)
    return F.when(key.isin(list(HOLLOW_SERIALS)) | key.rlike("^0+$"), "").otherwise(key)


def clean_targets(csv: Column) -> Column:
    """A comma list as trimmed lower-case names, blanks and repeats dropped."""
    return F.array_distinct(F.filter(F.transform(F.split(text(csv), ","), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def unique_texts(values: Column) -> Column:
    """Distinct texts in the order first seen, without empty ones."""
    return F.array_distinct(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))


def broad_folders(paths: Column, home: str = "") -> Column:
    """How many paths are a root, the home folder, a drive, or a documents or desktop folder."""

    def broad(path: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(F.trim(F.replace(text(path), F.lit("\\"), F.lit("/"))), "/+", "/"), "(?<=.)/$", "")
        lower = F.lower(plain)
        return plain.isin("/", "~", ".", "") | lower.isin("c:", "c:/", "%userprofile%") | lower.endswith("/documents") | lower.endswith("/desktop") | ((lower == home.lower()) & F.lit(home != ""))

    return F.size(F.filter(F.coalesce(paths, F.array().cast("array<string>")), broad))
