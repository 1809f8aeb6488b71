"""JSON-RPC lines, results and server-sent events as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGE = "jsonrpc string, id string, method string, params string, result string, error struct<code:int,message:string,data:string>"

#: Seconds that a call of a method may take.
TIMEOUTS = {"initialize": 20, "tools/list": 20, "resources/list": 20, "prompts/list": 20, "tools/call": 60}
DEFAULT_TIMEOUT = 8


def read_messages(lines: DataFrame, column: str) -> DataFrame:
    """Adds ``message`` to lines that hold a JSON object and ``passthrough`` to others; blank lines are dropped."""
    kept = lines.where(F.trim(F.coalesce(column, F.lit(""))) != "").withColumn("_v", F.try_parse_json(column))
    is_message = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    return kept.withColumn("message", F.when(is_message, F.from_json(column, MESSAGE))).withColumn("passthrough", ~is_message).drop("_v")


def method_branch(message: Column) -> Column:
    """Which branch a message takes by its method; notifications and unknown methods are forwarded."""
    method = F.coalesce(message["method"], F.lit(""))
    known = ("initialize", "tools/list", "tools/call", "resources/list", "resources/read", "prompts/list", "prompts/get", "ping")
    return F.when(method.isin(list(known)), method).when(method.startswith("notifications/"), "notification").when(method == "", "response").otherwise("unknown")


def parse_result(body: Column, wanted_id: Column) -> Column:
    """(result, error) of a JSON-RPC response: another id and an error object are errors, an empty body and a missing
    result are {}."""
    blank = F.trim(F.coalesce(body, F.lit(""))) == ""
    read = F.from_json(body, MESSAGE)
    refused = F.coalesce(F.nullif(read["error"]["message"], F.lit("")), F.lit("error"))
    error = (
        F.when(blank, "").when(~F.coalesce(F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), F.lit(False)), "unparsable response")
        .when(read["id"].isNotNull() & (read["id"] != wanted_id.cast("string")), "unexpected response id").when(read["error"].isNotNull(), refused).otherwise("")
    )
    return F.struct(F.when(error == "", F.when(blank, "{}").otherwise(F.coalesce(read["result"], F.lit("{}")))).alias("result"), error.alias("error"))


def sse_payloads(stream: Column) -> Column:
    """The data payloads of a server-sent stream, without empty ones and the closing mark."""
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(stream, F.lit("")), "\r", ""), "\n"), F.trim)
    data = F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: F.trim(F.substring(x, 6, 1 << 30)))
    return F.filter(data, lambda x: (x != "") & (x != "[DONE]"))


def sse_result(stream: Column, wanted_id: Column) -> Column:
    """The result of the first payload that reads as a response to the id; null where none does."""
    read = F.filter(F.transform(sse_payloads(stream), lambda p: parse_result(p, wanted_id)), lambda r: r["error"] == "")
    return F.try_element_at(read, F.lit(1))["result"]


def http_outcome(status: Column, content_type: Column, body: Column, wanted_id: Column) -> Column:
    """The result of an HTTP answer: 202 is {}, a stream's first result, else the JSON body's; of a failed status only
    a readable JSON body's. Null where there is none."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    parsed = parse_result(body, wanted_id)
    own = F.when(parsed["error"] == "", parsed["result"])
    return F.when(status == 202, "{}").when(~status.between(200, 299), F.when(kind.contains("application/json"), own)).when(kind.contains("text/event-stream"), sse_result(body, wanted_id)).otherwise(own)


def correlate(requests: DataFrame, responses: DataFrame, at: str = "at") -> DataFrame:
    """Each request with its response, if that came within the method's time: (server, id, method, result, timed_out).

    Works on streams too where both sides carry watermarks on ``at``; responses without an id are dropped.
    """
    limit = F.lit(DEFAULT_TIMEOUT)
    for method, seconds in TIMEOUTS.items():
        limit = F.when(F.col("q.method") == method, seconds).otherwise(limit)
    q, a = requests.alias("q"), responses.where("id is not null").alias("a")
    condition = (F.col("q.server") == F.col("a.server")) & (F.col("q.id") == F.col("a.id")) & (F.col(f"a.{at}") >= F.col(f"q.{at}")) & (F.col(f"a.{at}") <= F.col(f"q.{at}") + F.make_dt_interval(secs=limit))
    return q.join(a, condition, "left").select("q.server", "q.id", "q.method", "a.result", F.col("a.id").isNull().alias("timed_out"))
