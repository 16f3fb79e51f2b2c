"""Freshness of sessions from an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_windows(events: DataFrame, user: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, start, end, n): runs of a user's events with no pause of ``gap``; works on batches and on streams, where events up to ``late`` late count."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    found = rows.groupBy(F.col(user).alias("user"), F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select("user", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def seen_sessions(events: DataFrame, key: list[str], time: str = "ts", late: str = "1 day") -> DataFrame:
    """Each session (key) once within the time that late events are waited for."""
    if not events.isStreaming:
        return events.dropDuplicates(key)
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def history_delta(history: DataFrame, by: str = "collected") -> DataFrame:
    """``history`` (by, value) with change: the difference from the collection before, null for the first."""
    from pyspark.sql import Window

    return history.withColumn("change", F.col("value") - F.lag("value").over(Window.orderBy(by)))  # a row for each collection
