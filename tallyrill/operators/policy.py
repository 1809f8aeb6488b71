"""Policy evaluation, verdict merging and enforcement as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyrill.operators.detection import result

#: Keys that stand for no key.
PLACEHOLDER_KEYS = ("", "ak_live_YOURKEY", "ak_live_YOUR_KEY", "YOUR_API_KEY", "YOURKEY")


@dataclass(frozen=True)
class Policy:
    """A synced policy; an empty one allows everything."""

    blocked_servers: Sequence[str] = ()
    blocked_tools: Mapping[str, Sequence[str]] = field(default_factory=dict)
    custom_keywords: Sequence[str] = ()
    detection: Mapping[str, str] = field(default_factory=dict)


def policy_result(verdict: str | Column, reason: Column | str = "", rule: str = "") -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(as_column(verdict).alias("verdict"), as_column(reason).alias("reason"), F.lit(rule).alias("rule"))


def evaluate(policy: Policy, server: Column, tool: Column, arguments: Column) -> Column:
    """The policy's result for a call: blocked server, then blocked tool, then the first keyword in list order.

    arguments: canonical JSON, null where a call has none (then no keyword is looked for). Names compare without case;
    an empty keyword is in every text.
    """
    server, tool = F.coalesce(server, F.lit("")), F.coalesce(tool, F.lit(""))
    chain = F.when(F.lower(server).isin([s.lower() for s in policy.blocked_servers]), policy_result("block", F.concat(F.lit("Server '"), server, F.lit("' is blocked by organization policy")), "blocked_server"))
    pairs = [(s.lower(), [t.lower() for t in tools]) for s, tools in policy.blocked_tools.items()]
    blocked = F.lit(False)
    for name, tools in pairs:
        blocked |= (F.lower(server) == name) & F.lower(tool).isin(tools)
    chain = chain.when(blocked, policy_result("block", F.concat(F.lit("Tool '"), server, F.lit("/"), tool, F.lit("' is blocked by organization policy")), "blocked_tool"))
    strict = "block" if policy.detection.get("sensitive_data") == "block" else "warn"
    for word in policy.custom_keywords:
        chain = chain.when(F.lower(arguments).contains(word.lower()), policy_result(strict, f"Custom keyword '{word}' detected in tool arguments", "custom_keyword"))
    return chain.otherwise(policy_result("allow"))


def rank(verdict: Column) -> Column:
    """block 3, warn 2, everything else 1."""
    return F.when(verdict == "block", 3).when(verdict == "warn", 2).otherwise(1)


def policy_detection(policy: Column) -> Column:
    """A policy result as a detection: blocks are high, warnings medium, the rest passes."""
    made = lambda verdict, severity: F.struct(F.lit(verdict).alias("verdict"), policy["rule"].alias("pattern_name"), F.lit(severity).alias("severity"), policy["reason"].alias("description"), F.lit("policy").alias("category"))
    return F.when(policy["verdict"] == "block", made("block", "high")).when(policy["verdict"] == "warn", made("warn", "medium")).otherwise(result("pass"))


def merge(*results: Column) -> Column:
    """Of several detections the strictest; of equally strict ones the earliest. Null ones are passed over."""
    merged = results[0]
    for other in results[1:]:
        merged = F.when(other.isNotNull() & (rank(other["verdict"]) > rank(merged["verdict"])), other).otherwise(merged)
    return merged


def action(verdict: Column, enforce: bool) -> Column:
    """What happens to a call or response: withheld only where a block is enforced."""
    return F.when((verdict == "block") & F.lit(enforce), "blocked").otherwise("forwarded")


def stricter_mode(one: Column, other: Column) -> Column:
    """The stricter of two detection modes: block, warn, monitor, none."""
    order = lambda m: F.when(m == "block", 3).when(m == "warn", 2).when(m == "monitor", 1).otherwise(0)
    return F.when(order(other) > order(one), other).otherwise(one)


def merged_keywords(one: Column, other: Column) -> Column:
    """The keywords of two policies, each once, those of the first in front; blank ones are dropped."""
    both = F.concat(F.coalesce(one, F.array().cast("array<string>")), F.coalesce(other, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(both, lambda k: F.trim(F.coalesce(k, F.lit(""))) != ""))


def usable_key(key: Column, placeholders: Sequence[str] = PLACEHOLDER_KEYS) -> Column:
    """Whether an API key is more than a placeholder."""
    return ~F.trim(F.coalesce(key, F.lit(""))).isin(list(placeholders))
