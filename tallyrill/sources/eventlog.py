"""Reading the append-only event log: strictly, leniently, its tail, and as a stream."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrill.functions.keys import epoch_nanos

FIELDS = ("timestamp", "event_type", "server_name", "tool_name", "verdict", "severity", "pattern_name", "category", "description")
SCHEMA = ", ".join(f"{f} string" for f in FIELDS) + ", context string"

#: Bytes of a line from which on the lenient reader passes it over.
LONGEST_LINE = 1 << 20


def _blank(df: DataFrame) -> DataFrame:
    """Absent fields read as empty strings."""
    return df.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) if c in FIELDS else F.col(c) for c in df.columns))


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path).limit(0).collect()
    except AnalysisException:
        return False
    return True


def read_strict(spark: SparkSession, path: str) -> DataFrame:
    """Every event of a JSONL log; a malformed line fails the read, a missing log is empty."""
    if not _exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    return _blank(spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path))


def read_lenient(spark: SparkSession, path: str) -> DataFrame:
    """Every readable event of a JSONL log; malformed lines are passed over, and a line over 1 MiB ends its file."""
    if not _exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), place.alias("_at"))
    ends = lines.where(F.octet_length("value") > LONGEST_LINE).groupBy("_file").agg(F.min("_at").alias("_end"))
    if not ends.isEmpty():
        lines = lines.join(ends, "_file", "left").where(F.col("_end").isNull() | (F.col("_at") < F.col("_end")))
    return parse_lines(lines, "value")


def parse_lines(lines: DataFrame, column: str, *keep: str) -> DataFrame:
    """Events of a text column; also of a stream."""
    parsed = lines.where(F.octet_length(column) <= LONGEST_LINE).select(*keep, F.from_json(column, SCHEMA + ", _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("e"))
    return _blank(parsed.where("e is not null and e._broken is null").select(*keep, "e.*").drop("_broken"))


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A log folder as a stream of events; files that come later are followed."""
    return parse_lines(spark.readStream.format("text").load(folder), "value")


def since(events: DataFrame, date: str, column: str = "timestamp") -> DataFrame:
    """Events from the start of a day on (UTC), inclusive; times that can't be read are dropped only here, where a day
    is asked for. The day is checked on the driver: a malformed one raises ValueError."""
    from datetime import UTC, datetime

    start = datetime.strptime(date, "%Y-%m-%d").replace(tzinfo=UTC)
    if start.strftime("%Y-%m-%d") != date:
        raise ValueError(f"{date!r} is no YYYY-MM-DD day")
    return events.where(epoch_nanos(column) >= int(start.timestamp()) * 10**9)


def tail(events: DataFrame, n: int, order: str) -> DataFrame:
    """The last ``n`` events by an order column, in order; ``n`` is the feature, so the limit is kept."""
    return events.orderBy(F.desc(order)).limit(n).orderBy(order)


def last_per_server(events: DataFrame, order: str, kind: str = "mcp.tool_call") -> DataFrame:
    """Of each named server its last call by ``order``: (server_name, last_call_at, last_tool_name)."""
    calls = events.where((F.col("event_type") == kind) & (F.coalesce("server_name", F.lit("")) != ""))
    last = calls.groupBy("server_name").agg(F.max_by(F.struct("timestamp", "tool_name"), order).alias("e"))
    return last.select("server_name", F.col("e.timestamp").alias("last_call_at"), F.col("e.tool_name").alias("last_tool_name"))


def uploadable(events: DataFrame) -> DataFrame:
    """Events that go to the remote side: those that name a server and a tool."""
    return events.where((F.coalesce("server_name", F.lit("")) != "") & (F.coalesce("tool_name", F.lit("")) != ""))


def make_event(kind: str, at, server, tool, detection):
    """The event struct of a call (``tool_call``), a finding (``threat_detected``) or a session (``session_start``);
    an empty verdict reads as pass."""
    text = lambda c: F.coalesce(c, F.lit(""))
    verdict = text(detection["verdict"])
    return F.struct(
        at.alias("timestamp"), F.lit(f"mcp.{kind}").alias("event_type"), text(server).alias("server_name"), text(tool).alias("tool_name"), F.when(verdict == "", "pass").otherwise(verdict).alias("verdict"),
        *(text(detection[f]).alias(f) for f in ("severity", "pattern_name", "category", "description")),
    )


def numbered(lines: DataFrame, path: str, order: str) -> DataFrame:
    """``line_no`` from 1 in each file, by an order column that grows along the file."""
    return lines.withColumn("line_no", F.row_number().over(Window.partitionBy(path).orderBy(order)))
