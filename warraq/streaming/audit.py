"""Streaming forms. The rules look at one unit at a time, so a stream is audited as it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rules
from ..operators.rules import RepairOptions


def audit_stream(units: DataFrame, options: RepairOptions | None = None, rule_ids=None) -> DataFrame:
    """Findings of a stream of units, in append mode; no state is kept."""
    return rules.diagnostics(units, options, rule_ids)


def tumbling_counts(events: DataFrame, time: str, key: str, width: str, late: str | None) -> DataFrame:
    """Events by key and window; on a stream, rows later than ``late`` behind the newest are dropped."""
    d = events.withWatermark(time, late) if late else events
    return d.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), key, "events")


def session_counts(events: DataFrame, time: str, key: str, gap: str, late: str | None) -> DataFrame:
    """Events by key and session, a session ending after a gap without events."""
    d = events.withWatermark(time, late) if late else events
    return d.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("events")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "events")
