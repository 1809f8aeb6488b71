"""Classification of tool calls, responses and tool descriptions by ordered rules, as one narrow projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrill.functions.gojson import flatten_json
from tallyrill.functions.rules import POISON, SENSITIVE, THREAT, Rule, fold_case, holds

#: Fields of a detection result.
RESULT = ("verdict", "pattern_name", "severity", "description", "category")


def result(verdict: str, pattern_name: str = "", severity: str = "", description: str = "", category: str = "") -> Column:
    return F.struct(*(F.lit(v).alias(n) for n, v in zip(RESULT, (verdict, pattern_name, severity, description, category))))


def _outcome(rule: Rule) -> Column:
    return result("warn", rule.name, rule.severity, rule.description, rule.category)


def first_rule(text: Column, lower: Column, sensitive: Sequence[Rule] = SENSITIVE, threat: Sequence[Rule] = THREAT) -> Column:
    """The number of the first rule that holds, from 1, sensitive data before threats; 0 where none does. One lazy CASE,
    so later rules aren't tried."""
    chain = F
    for number, (rule, folded) in enumerate([(r, False) for r in sensitive] + [(r, True) for r in threat], 1):
        chain = chain.when(holds(rule, text, lower, folded), number)
    return chain.otherwise(0) if sensitive or threat else F.lit(0)


def detect_text(df: DataFrame, text: str, into: str = "detection", sensitive: Sequence[Rule] = SENSITIVE, threat: Sequence[Rule] = THREAT) -> DataFrame:
    """``df`` with a detection struct for a text column; null reads as empty and passes. The lower-case text and the
    rule's number are projections of their own, so neither is computed once for each field that is read."""
    named = df.withColumn("__tr_text", F.coalesce(F.col(text), F.lit(""))).withColumn("__tr_lower", fold_case(F.col("__tr_text")))
    numbered = named.withColumn("__tr_rule", first_rule(F.col("__tr_text"), F.col("__tr_lower"), sensitive, threat))
    outcomes = F.array(result("pass"), *(_outcome(r) for r in (*sensitive, *threat)))
    return numbered.withColumn(into, F.get(outcomes, F.col("__tr_rule"))).drop("__tr_text", "__tr_lower", "__tr_rule")


def detect_calls(df: DataFrame, arguments: str, into: str = "detection") -> DataFrame:
    """As ``detect_text`` for a JSON object of arguments, flattened first; what is no object passes."""
    return detect_text(df.withColumn("__tr_flat", flatten_json(arguments)), "__tr_flat", into).drop("__tr_flat")


def tool_text(name: str = "tool_name", description: str = "description", parameters: str = "parameters") -> Column:
    """Name, description and each parameter's name and description, joined by spaces, in lower case."""
    empty = F.lit("")
    parts = F.transform(F.coalesce(F.col(parameters), F.array()), lambda p: F.concat(F.lit(" "), F.coalesce(p["name"], empty), F.lit(" "), F.coalesce(p["description"], empty)))
    return fold_case(F.concat(F.coalesce(F.col(name), empty), F.lit(" "), F.coalesce(F.col(description), empty), F.array_join(parts, "")))


def detect_descriptions(df: DataFrame, text: Column, rules: Sequence[Rule] = POISON) -> DataFrame:
    """A row for each tool and each rule that its description text breaks, with the detection's fields."""
    named = df.withColumn("__tr_text", text)
    hits = F.filter(F.array(*(F.when(holds(r, F.col("__tr_text"), F.col("__tr_text"), True), _outcome(r)) for r in rules)), lambda x: x.isNotNull())
    return named.withColumn("__tr_hit", F.explode(hits)).select(*df.columns, *(F.col(f"__tr_hit.{f}").alias(f"hit_{f}") for f in RESULT))


def manifest_tools(df: DataFrame, manifest: str) -> DataFrame:
    """``df``'s rows for each tool of a manifest, a JSON array: (*columns, tool_name, description, parameters). Entries
    that are no objects are skipped; a missing name or description reads as ``<nil>``; parameters are the object-valued
    properties of the input schema, by name."""
    read = lambda text, path: F.coalesce(F.get_json_object(text, path), F.lit("<nil>"))
    each = df.withColumn("__tr_tool", F.explode(F.from_json(manifest, "array<string>"))).where(F.schema_of_variant(F.try_parse_json("__tr_tool")).startswith("OBJECT"))
    properties = F.from_json(F.get_json_object("__tr_tool", "$.inputSchema.properties"), "map<string,string>")
    objects = F.map_filter(properties, lambda _, v: F.coalesce(F.schema_of_variant(F.try_parse_json(v)).startswith("OBJECT"), F.lit(False)))
    parameters = F.transform(F.array_sort(F.map_entries(objects)), lambda e: F.struct(e["key"].alias("name"), read(e["value"], "$.description").alias("description")))
    return each.select(*df.columns, read("__tr_tool", "$.name").alias("tool_name"), read("__tr_tool", "$.description").alias("description"), F.coalesce(parameters, F.array().cast("array<struct<name:string,description:string>>")).alias("parameters"))


def escalate(detection: Column, policy_mode: dict[str, str], local_mode: dict[str, str]) -> Column:
    """A warning of sensitive data or of a threat becomes a block where the policy or the local mode says so."""
    strict = [c for c in ("sensitive_data", "threat") if "block" in (policy_mode.get(c, "").lower(), local_mode.get(c, "").lower())]
    lifted = (detection["verdict"] == "warn") & detection["category"].isin(strict) if strict else F.lit(False)
    return detection.withField("verdict", F.when(lifted, "block").otherwise(detection["verdict"]))
