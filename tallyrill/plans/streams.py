"""Queries that run as streams over all that is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrill.functions import keys as K
from tallyrill.plans.detection import LOCAL, POLICY, first_rule
from tallyrill.plans.literals import Literal
from tallyrill.session import table
from tallyrill.streaming.gateway import event_windows, judge, latest_status, refresh_cache, run_available

FRESH = Literal("server string, tools string, seen int", [("a", "x,y", 1), ("a", "y,x", 2), ("b", "", 3), ("c", "z", 1), ("c", "z,w", 2), ("d", "q", 5)])
KEPT = Literal("server string, tools string, seen int", [("a", "x,y", 0), ("b", "m", 0), ("c", "z,w", 0)])
REPORTS = Literal("server string, status string, seen int", [("a", "ready", 1), ("a", "degraded", 2), ("b", "ready", 3), ("b", "degraded", 1)])


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of them."""
    reader = spark.readStream.schema(table(spark, folder, name).schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").option("recursiveFileLookup", "true").parquet(folder)


def stream_judge(spark: SparkSession, folder: str) -> DataFrame:
    """Every logged call judged as it streams in: what the policy and the rules say of it."""
    calls = _stream(spark, folder, "gateway_log").where(K.event_type() == "tool_call").select("log_id", K.text("server_name").alias("server_name"), F.substring_index(K.text("tool_name"), "__", -1).alias("tool_name"), K.text("description").alias("text"))
    return run_available(judge(calls, POLICY, LOCAL, True)).select("log_id", "verdict", "pattern_name", "action")


def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Extension: events of the event stream by hour and type. A window comes out once its hour has passed the
    watermark, so the last ones of the stream stay open."""
    return run_available(event_windows(_stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type"))


def tool_cache_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """The tool cache after a refresh: empty lists are ignored, changes marked."""
    lists = lambda t: t.frame(spark).select("server", F.filter(F.split("tools", ","), lambda x: x != "").alias("tools"), F.timestamp_seconds("seen").alias("updated_at"))
    old = lists(KEPT).withColumn("digest", F.sha2(F.to_json(F.array_sort("tools")), 256))
    return refresh_cache(old, lists(FRESH)).select("server", F.array_join(F.array_sort("tools"), ",").alias("tools"), "changed")


def catalogue_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """The whole catalogue as a cache, refreshed with lists from which some servers' later tools are gone."""
    tools = table(spark, folder, "tool_catalog").select(K.server_key().alias("server"), F.substring_index("tool_name", "__", -1).alias("tool")).where("server <> '' and tool is not null")
    lists = lambda t, seen: t.groupBy("server").agg(F.array_sort(F.collect_set("tool")).alias("tools")).withColumn("updated_at", F.timestamp_seconds(F.lit(seen)))
    old = lists(tools, 1).withColumn("digest", F.sha2(F.to_json("tools"), 256))
    fresh = lists(tools.where("length(server) % 3 = 0 or tool < 'm'"), 2)
    return refresh_cache(old, fresh).select("server", F.size("tools").alias("n_tools"), "changed")


def refresh_status(spark: SparkSession, folder: str) -> DataFrame:
    return latest_status(REPORTS.frame(spark).withColumn("updated_at", F.timestamp_seconds("seen"))).select("server", "status")


QUERIES = {f.__name__: f for f in (stream_judge, stream_windows, tool_cache_refresh, catalogue_refresh, refresh_status)}

_SERVER, _TOOL = "lower(coalesce(server_name, ''))", "lower(regexp_replace(coalesce(tool_name, ''), '^.*__', ''))"

SQL = {
    "stream_judge": f"""WITH calls AS (SELECT log_id, {_SERVER} AS server, {_TOOL} AS tool, coalesce(description, '') AS t FROM gateway_log WHERE regexp_replace(lower(coalesce(event_type, '')), '^.*[.]', '') = 'tool_call'),
        judged AS (SELECT log_id, CASE WHEN server IN ('audio_kiln', 'graph_mill') THEN 'blocked_server' WHEN (server = 'stock_bridge' AND tool IN ('read_table', 'fetch_rows')) OR (server = 'sheet_quarry' AND tool = 'send_thread') THEN 'blocked_tool' ELSE '' END AS p,
          CASE WHEN contains(lower(t), 'docker run') OR contains(lower(t), 'a&b') OR contains(lower(t), 'uvx') THEN 'custom_keyword' ELSE '' END AS k, {first_rule('t', 'pattern_name')} AS d, {first_rule('t', 'category')} AS c FROM calls),
        merged AS (SELECT log_id, CASE WHEN p <> '' OR k <> '' OR c = 'sensitive_data' THEN 'block' WHEN d <> '' THEN 'warn' ELSE 'pass' END AS verdict, CASE WHEN p <> '' THEN p WHEN k <> '' THEN k ELSE d END AS pattern_name FROM judged)
      SELECT *, CASE WHEN verdict = 'block' THEN 'blocked' ELSE 'forwarded' END AS action FROM merged""",
    "stream_windows": """SELECT * FROM (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n_events FROM events GROUP BY ALL) WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 15 MINUTE""",
    "tool_cache_refresh": f"""WITH l AS (SELECT server, array_to_string(list_sort(list_filter(string_split(tools, ','), lambda x: x <> '')), ',') AS tools, seen FROM {FRESH.sql()}), f AS (SELECT server, arg_max(tools, seen) AS tools FROM l WHERE tools <> '' GROUP BY ALL),
      k AS (SELECT server, array_to_string(list_sort(string_split(tools, ',')), ',') AS tools FROM {KEPT.sql()}) SELECT coalesce(f.server, k.server) AS server, coalesce(f.tools, k.tools) AS tools, f.tools IS NOT NULL AND f.tools IS DISTINCT FROM k.tools AS changed FROM k FULL JOIN f ON f.server = k.server""",
    "catalogue_refresh": """WITH t AS (SELECT regexp_replace(lower(coalesce(server_name, '')), '[^a-z0-9]', '', 'g') AS server, regexp_replace(tool_name, '^.*__', '') AS tool FROM tool_catalog WHERE tool_name IS NOT NULL),
      o AS (SELECT server, count(DISTINCT tool) AS n FROM t WHERE server <> '' GROUP BY ALL), f AS (SELECT server, count(DISTINCT tool) FILTER (len(server) % 3 = 0 OR tool < 'm') AS n FROM t WHERE server <> '' GROUP BY ALL)
      SELECT server, CAST(CASE WHEN f.n > 0 THEN f.n ELSE o.n END AS INTEGER) AS n_tools, f.n > 0 AND f.n <> o.n AS changed FROM o JOIN f USING (server)""",
    "refresh_status": f"SELECT server, max_by(status, seen) AS status FROM {REPORTS.sql()} GROUP BY ALL",
}
