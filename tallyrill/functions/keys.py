"""Readings of the gateway log's loosely spelled values, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text(value: Column | str) -> Column:
    """The string, or the empty string for null."""
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))


def plain_key(value: Column | str) -> Column:
    """Lower case with only a-z and 0-9 kept; null and empty give the empty key."""
    return F.regexp_replace(F.lower(text(value)), "[^a-z0-9]+", "")


def server_key(value: Column | str = "server_name") -> Column:
    return plain_key(value)


def tool_key(value: Column | str = "tool_name") -> Column:
    """The key of what stands after the last double underscore."""
    return plain_key(F.substring_index(text(value), "__", -1))


def event_type(value: Column | str = "event_type") -> Column:
    """Lower case, after the last dot."""
    return F.substring_index(F.lower(text(value)), ".", -1)


def label(value: Column | str) -> Column:
    """Trimmed and lower case, the empty string for null: severities and pattern names."""
    return F.lower(F.trim(text(value)))


def verdict(value: Column | str = "verdict") -> Column:
    """As ``label``; null and empty read as pass."""
    read = label(value)
    return F.when(read == "", F.lit("pass")).otherwise(read)


def epoch_nanos(value: Column | str) -> Column:
    """Nanoseconds since 1970 of an RFC 3339 text with any number of fraction digits; null where it is no such time.

    Spark's timestamps hold microseconds, so the digits after the sixth are read apart.
    """
    raw = F.trim(text(value))
    fraction = F.regexp_extract(raw, r"\.(\d+)", 1)
    micros = F.unix_micros(F.try_to_timestamp(F.regexp_replace(raw, r"(\.\d{6})\d+", "$1")))
    return micros * 1000 + F.rpad(F.substring(fraction, 7, 3), 3, "0").cast("bigint")


def log_lines(log: DataFrame, **columns: Column) -> DataFrame:
    """One row for each (session_id, line_no) of a log delivered with copies, with the given computed columns.

    Copies agree in all but their delivery columns, so rows equal in the computed columns are one line; hashing the
    grouping keys lets every task fold its copies before the shuffle, however many copies a line has. Rows without
    session or line number are no log lines and are dropped.
    """
    lines = log.where(F.col("session_id").isNotNull() & F.col("line_no").isNotNull())
    return lines.select("session_id", "line_no", *(c.alias(n) for n, c in columns.items())).distinct()
