"""Queries of the operators for training data, with their SQL where whole tables can be done in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrill.functions import keys as K
from tallyrill.llm.bpe import encode_texts
from tallyrill.llm.credentials import find_in_files, find_in_values
from tallyrill.llm.leakage import find_leaks
from tallyrill.llm.readability import reading_levels
from tallyrill.llm.runs import collapse_runs
from tallyrill.session import spread, table

#: Most nanoseconds from one line of a run to the next.
RUN_GAP_NS = 15 * 60 * 10**9


def _runs(spark: SparkSession, folder: str, least: int) -> DataFrame:
    log = table(spark, folder, "gateway_log").select(
        "session_id", "line_no", K.epoch_nanos("timestamp").alias("at"), K.event_type().alias("event_type"), K.server_key().alias("server_key"), K.tool_key().alias("tool_key"), K.verdict().alias("verdict")
    )
    return collapse_runs(log, "session_id", "line_no", "at", ["event_type", "server_key", "tool_key", "verdict"], RUN_GAP_NS, least)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every longest run of two or more log lines."""
    return _runs(spark, folder, 2).select("session_id", F.col("first_pos").alias("first_line"), F.col("last_pos").alias("last_line"))


def p1_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """Every session's log with each run as one event: its lines, count and duration in nanoseconds."""
    return _runs(spark, folder, 1).select("session_id", F.col("first_pos").alias("first_line"), F.col("last_pos").alias("last_line"), "n_events", F.col("duration").alias("duration_ns"))


def _entry_values(spark: SparkSession, folder: str) -> DataFrame:
    """The named values of server entries: each env and header by its key, and the command without a name."""
    entries = table(spark, folder, "server_entries")
    maps = [entries.select("entry_id", F.lit(field).alias("field"), F.explode(field).alias("item", "value")) for field in ("env", "headers")]
    return maps[0].unionByName(maps[1]).unionByName(entries.select("entry_id", F.lit("command").alias("field"), F.lit("").alias("item"), F.col("command").alias("value")))


def p2_redacted_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Each value of a server entry that holds secrets, with these blanked."""
    return find_in_values(_entry_values(spark, folder), ["entry_id", "field", "item"], "item", "value")


def p2_redacted_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each config file that holds secrets: the lines where they begin, and the file with them blanked."""
    return find_in_files(spread(table(spark, folder, "config_files").select("file_id", "kind", "path", "content")), "file_id", "kind", "path", "content")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every place of a server entry or config file that holds a literal secret."""
    entries = p2_redacted_entries(spark, folder).select(F.lit("server_entry").alias("record_kind"), F.col("entry_id").alias("record_id"), "field", "item")
    files = p2_redacted_files(spark, folder).select(F.lit("config_file").alias("record_kind"), F.col("file_id").alias("record_id"), F.lit("content").alias("field"), F.explode(F.transform(F.array_distinct("lines"), lambda x: x.cast("string"))).alias("item"))
    return entries.unionByName(files)


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document."""
    return encode_texts(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that holds a passage of an evaluation item, with the item."""
    return find_leaks(spread(table(spark, folder, "documents").select("doc_id", "text")), table(spark, folder, "eval_items"), "doc_id", "text", "item_id", "text")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The reading level of every document whose running text is mainly English."""
    return reading_levels(spread(table(spark, folder, "documents").select("doc_id", "text")), table(spark, folder, "reading_labels"), "doc_id", "text", "level")


_P1 = """WITH lines AS (SELECT DISTINCT session_id, line_no,
  concat_ws('|', regexp_replace(lower(coalesce(event_type, '')), '^.*[.]', ''), regexp_replace(lower(coalesce(server_name, '')), '[^a-z0-9]', '', 'g'),
    regexp_replace(lower(regexp_replace(coalesce(tool_name, ''), '^.*__', '')), '[^a-z0-9]', '', 'g'),
    coalesce(nullif(lower(trim(verdict)), ''), 'pass')) AS sig,
  epoch_us(CAST(regexp_replace(timestamp, '([.][0-9]{6})[0-9]+', '\\1') AS TIMESTAMPTZ)) * 1000
    + CAST(rpad(substring(regexp_extract(timestamp, '[.]([0-9]+)', 1), 7, 3), 3, '0') AS BIGINT) AS ns
  FROM gateway_log WHERE session_id IS NOT NULL AND line_no IS NOT NULL),
marked AS (SELECT *, CASE WHEN lag(sig) OVER w = sig AND ns - lag(ns) OVER w <= 900000000000 THEN 0 ELSE 1 END AS starts FROM lines WINDOW w AS (PARTITION BY session_id ORDER BY line_no)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY session_id ORDER BY line_no) AS run FROM marked),
runs AS (SELECT session_id, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_events, max_by(ns, line_no) - min_by(ns, line_no) AS duration_ns FROM numbered GROUP BY session_id, run)
"""

QUERIES = {"p1_found": p1_found, "p1_collapsed": p1_collapsed, "p2_found": p2_found, "p2_redacted_entries": p2_redacted_entries, "p2_redacted_files": p2_redacted_files, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found}

SQL = {
    "p1_found": _P1 + "SELECT session_id, first_line, last_line FROM runs WHERE n_events > 1",
    "p1_collapsed": _P1 + "SELECT * FROM runs",
}
