"""All queries of the core, gathered from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyrill.plans import checkins, detection, events, feeds, gateway, inventory, posture, reports, rpc, scans, streams

MODULES = (gateway, checkins, feeds, scans, detection, events, inventory, reports, posture, rpc, streams)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return detection.detect_documents(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in getattr(module, "SQL", {}).items()}
