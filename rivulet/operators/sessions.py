"""Sessions, abandonment, funnels and deduplication over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, last, n, ...) of each run of a user's events (user_id, ts, type, step) without a longer pause."""
    g = events.groupBy("user_id", F.session_window("ts", gap).alias("w"))
    is_ = lambda *t: F.max(F.col("type").isin(*t))
    return g.agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.max("step").alias("max_step"),
        is_("application-started").alias("started"), is_("application-submitted", "application-draft-saved").alias("ended"),
    ).drop("w")


def abandoned(found: DataFrame, gap_seconds: int, watermark) -> DataFrame:
    """Sessions that started an application, neither submitted nor saved it, and closed before the watermark."""
    return found.where(F.col("started") & ~F.col("ended") & (F.unix_timestamp(F.col("last_ts").cast("timestamp")) + gap_seconds < watermark))


def funnel(found: DataFrame, steps: int) -> DataFrame:
    """(step, reached): sessions whose highest step is at least each step."""
    s = found.select(F.explode(F.sequence(F.lit(1), F.least(F.col("max_step").cast("int"), F.lit(steps)))).alias("step"))
    return s.groupBy("step").agg(F.count("*").alias("reached"))


def deduplicated(events: DataFrame) -> DataFrame:
    """One row per (source, id)."""
    return events.dropDuplicates(["source", "id"])
