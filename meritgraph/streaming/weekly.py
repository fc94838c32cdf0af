"""Streams of contributions: weekly sums, keyed upserts, scoring against configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritgraph.operators.asof import asof_join


def weekly_sums(events: DataFrame, delay: str | None = "1 day") -> DataFrame:
    """(start, event_type, n, value) of events (ts timestamp, event_type, value), a week at a time from Sunday UTC. In
    append mode a week comes out once the watermark has passed its end: complete weeks only. ``delay`` is None for events that have a watermark already."""
    week = F.window("ts", "7 days", "7 days", "3 days")
    events = events.withWatermark("ts", delay) if delay else events
    return events.groupBy(week.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def once(events: DataFrame, key: str, delay: str = "1 day") -> DataFrame:
    """Without events that an overlapping read brought again."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def scored(events: DataFrame, configs: DataFrame, ts: str = "timestamp_ms") -> DataFrame:
    """Events with the weight in force (strictly before their time); a stream against a static table, without state."""
    return asof_join(events, configs, ts, "start_ms", "weight", strict=True).where("weight IS NOT NULL")


def upsert_to(path: str, key: str, version: str):
    """A foreachBatch function that keeps the newest version of each key in a Parquet table, by writing the merged
    table beside the old one."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        rows = batch
        done = [s.getPath() for s in fs.listStatus(where)] if fs.exists(where) else []
        # a write that broke off has no marker: its batch comes again and writes over it
        done = sorted(p.getName() for p in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
        if done:
            current = done[-1]
            if current >= f"v{batch_id:012d}":
                return  # this batch was written before
            rows = spark.read.parquet(f"{path}/{current}").unionByName(batch)
        columns = [c for c in rows.columns if c != key]
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*columns), version).alias("r")).select(key, "r.*")
        newest.write.mode("overwrite").parquet(f"{path}/v{batch_id:012d}")

    return write
