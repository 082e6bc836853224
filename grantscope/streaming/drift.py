"""Deployment drift as a stream: grants by agent and window, late events beyond the watermark dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grant_events(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events (event_id, ts, agent, role, conditional) without repeats within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def windowed_drift(stream: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window, agent, grants, roles, conditional) per tumbling window, emitted once the watermark has passed it."""
    rows = grant_events(stream, late).groupBy(F.window("ts", width), "agent")
    return rows.agg(F.count("*").alias("grants"), F.array_sort(F.collect_set("role")).alias("roles"), F.count_if("conditional").alias("conditional"))
