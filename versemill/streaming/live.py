"""Streaming forms of the batch aggregates: running totals, and gap sessions on event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.operators.analytics import combined_wer


def running_wer(chunks: DataFrame, keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Error rate so far of each group of a stream of chunks; write it in complete or update mode."""
    return chunks.groupBy(*keys).agg(F.count("*").alias("chunks"), combined_wer().alias("wer"))


def windowed_wer(chunks: DataFrame, time: str = "ts", width: str = "5 minutes", late: str = "10 minutes", keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Error rate of each time window; windows close, and their state goes, once the watermark has passed them."""
    return chunks.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("chunks"), combined_wer().alias("wer"))


def live_sessions(events: DataFrame, user: str = "user_id", time: str = "ts", gap: str = "7 seconds", late: str = "1 minute") -> DataFrame:
    """Sessions of events no more than ``gap`` apart: (user, start, end, events)."""
    sessions = events.withWatermark(time, late).groupBy(user, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("events"))
    return sessions.select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")
