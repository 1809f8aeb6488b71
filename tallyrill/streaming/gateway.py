"""Continuous runs: the same functions over streams of messages and events."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrill.operators.detection import detect_text, escalate
from tallyrill.operators.inventory import keep_first
from tallyrill.operators.policy import Policy, action, evaluate, merge, policy_detection
from tallyrill.session import checkpoint_dir
from tallyrill.sources.eventlog import uploadable
from tallyrill.sources.sinks import upload_batches

#: Seconds between uploads and between policy reads.
UPLOAD_S, POLICY_S = 5, 30


def judge(calls: DataFrame, policy: Policy, local: dict[str, str], enforce: bool) -> DataFrame:
    """Calls (server_name, tool_name, text) with ``verdict``, ``pattern_name``, ``category`` and ``action``: policy,
    rules and escalation in one narrow step, for batches and streams alike."""
    found = detect_text(calls, "text")
    ruled = found.withColumn("_policy", policy_detection(evaluate(policy, F.col("server_name"), F.col("tool_name"), F.col("text"))))
    merged = ruled.withColumn("_final", merge(F.col("_policy"), escalate(F.col("detection"), dict(policy.detection), local)))
    return merged.select(*calls.columns, *(F.col(f"_final.{f}").alias(f) for f in ("verdict", "pattern_name", "category")), action(F.col("_final.verdict"), enforce).alias("action"))


def judge_batches(policy: Callable[[], Policy], write: Callable[[DataFrame], None], local: dict[str, str], enforce: bool) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that reads the policy anew for each micro-batch; while it can't be read, the last good
    one holds, and before the first an empty one, which allows everything."""
    kept = {"policy": Policy()}

    def batch(df: DataFrame, _: int) -> None:
        try:
            kept["policy"] = policy()
        except Exception:  # any failure of the reader leaves the last good policy in force
            pass
        write(judge(df, kept["policy"], local, enforce))

    return batch


def upload(events: DataFrame, send: Callable[[list[dict]], bool], checkpoint: str):
    """Starts the upload of events that name a server and a tool: at least once, by micro-batches of 5 seconds."""
    return uploadable(events).writeStream.foreachBatch(upload_batches(send)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{UPLOAD_S} seconds").start()


def refresh_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The tool cache (server, tools array, digest, updated_at) after refreshed lists (server, tools, updated_at), with
    ``changed``: an empty list leaves the last known good one; of several lists of a server the latest counts."""
    latest = keep_first(fresh.where(F.size(F.coalesce("tools", F.array().cast("array<string>"))) > 0), ["server"], [F.desc("updated_at"), "tools"])
    new = latest.select("server", "tools", F.sha2(F.to_json(F.array_sort("tools")), 256).alias("digest"), "updated_at")
    both = cache.select("server", *(F.col(c).alias(f"_{c}") for c in ("tools", "digest", "updated_at"))).join(new, "server", "full")
    return both.select("server", F.coalesce("tools", "_tools").alias("tools"), F.coalesce("digest", "_digest").alias("digest"), F.coalesce("updated_at", "_updated_at").alias("updated_at"), (F.col("digest").isNotNull() & ~F.col("digest").eqNullSafe(F.col("_digest"))).alias("changed"))


def cache_batches(path: str, notify: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the tool cache as a table of versions under ``path`` and notifies once a
    micro-batch of the servers whose tools changed. A batch that is run again writes the same version."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        try:
            old = spark.read.parquet(f"{path}/v={number - 1}")
        except AnalysisException:
            old = spark.createDataFrame([], "server string, tools array<string>, digest string, updated_at timestamp, changed boolean")
        refresh_cache(old, df).write.mode("overwrite").parquet(f"{path}/v={number}")
        changed = spark.read.parquet(f"{path}/v={number}").where("changed")
        if not changed.isEmpty():
            notify(changed.select("server"))

    return batch


def latest_status(reports: DataFrame) -> DataFrame:
    """Of each server its last reported status: (server, status, updated_at)."""
    last = reports.groupBy("server").agg(F.max(F.struct("updated_at", "status")).alias("s"))
    return last.select("server", "s.status", "s.updated_at")


def event_windows(events: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "15 minutes") -> DataFrame:
    """An extension: events counted by key in tumbling windows, late ones accepted for a while."""
    counted = events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("n_events"))
    return counted.select(F.col("window.start").alias("window_start"), key, "n_events")


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream yields from all that is there now, written to the shared checkpoint folder and read again."""
    spark: SparkSession = stream.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
