"""Event-time windows over a stream or a table: sliding and session windows, and follow-ups by an outer interval join.

On a stream, rows behind the watermark are dropped and state is given up as it passes; a
table has no late rows, and the same functions give what a stream without late rows would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _marked(events: DataFrame, late: str, ts: str = "ts") -> DataFrame:
    return events.withWatermark(ts, late) if events.isStreaming else events


def sliding(events: DataFrame, width: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """``window_start, event_type, n, total`` of every window of ``width`` that begins at a multiple of ``slide``: a row counts in each window that holds it. One shuffle with map-side combine; Spark expands a row width / slide times."""
    out = _marked(events, late).groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str | Column = "30 minutes", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """``key, session_start, session_end, n, total``: runs of rows of one key that follow one another in less than ``gap``; the end is that of the last row plus the gap.

    ``gap`` may be a column, so that kinds of rows keep a session open for longer or shorter.
    Partial sessions are merged before the shuffle.
    """
    window = F.session_window(F.col("ts"), gap)
    out = _marked(events, late).groupBy(F.col(key), window.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")


def follow_ups(opened: DataFrame, closed: DataFrame, within: str = "1 hour", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """``key, event_id, ts, followed_by, followed_at``: every row of ``opened`` with each row of ``closed`` of its key that comes after it ``within`` the time; nulls where none does.

    A left outer interval join. On streams both sides keep a row only as long as the other
    side's watermark allows a partner, and an unmatched row comes out once that has passed;
    partners that come later are dropped.
    """
    a = _marked(opened.select(F.col(key), "event_id", "ts"), late)
    b = closed.select(F.col(key).alias("__key"), F.col("event_id").alias("followed_by"), F.col("ts").alias("followed_at"))
    b = _marked(b, late, "followed_at")
    near = (F.col(key) == F.col("__key")) & (F.col("followed_at") > F.col("ts")) & (F.col("followed_at") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near, "left_outer").drop("__key")
