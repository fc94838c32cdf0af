"""Weeks from Sunday 00:00 UTC, as half-open intervals of milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEEK = 604_800_000
#: The epoch was a Thursday; the first Sunday after it.
SUNDAY = 259_200_000


def millis(ts: Column) -> Column:
    """Of a timestamp with or without a zone (then UTC); the session's zone has to be UTC."""
    return F.unix_millis(ts.cast("timestamp"))


def week_start(ms: Column) -> Column:
    return ms - F.pmod(ms - SUNDAY, F.lit(WEEK))


def week_intervals(times: DataFrame, ms: str) -> DataFrame:
    """(idx, start_ms, end_ms) of all weeks from the first time to the last, those without times included."""
    ends = times.agg(F.min(week_start(F.col(ms))).alias("a"), F.max(week_start(F.col(ms))).alias("b")).where("a IS NOT NULL")
    weeks = F.sequence(F.col("a"), F.col("b"), F.lit(WEEK))
    return ends.select(F.posexplode(weeks).alias("idx", "start_ms")).withColumn("end_ms", F.col("start_ms") + WEEK)
