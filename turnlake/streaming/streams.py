"""Structured Streaming over the event stream: finished periods and first-seen keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none and has one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.conf.get("spark.master", "local").startswith("local["):
        raise ValueError("on a cluster, streams need spark.checkpoint.dir")
    return named.rstrip("/") if named else tempfile.mkdtemp(prefix="turnlake-")


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a Parquet table; as a pattern, the path may also name a single file."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


#: Tiers of R4: length, step and offset of their windows; weeks begin on Mondays, the epoch was a Thursday.
TIERS = {"day": ("1 day", "1 day", "0 days"), "week": ("7 days", "7 days", "4 days")}


def tier_counts(events: DataFrame, tier: str, delay: str) -> DataFrame:
    """Events by day or ISO week and type; a period is emitted once, when the watermark has passed its end."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", *TIERS[tier]).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("period_start"), "event_type", "n")


def finished_sessions(events: DataFrame, key: str, quiet: str, delay: str) -> DataFrame:
    """R2: key, started, n of each session, emitted once when the watermark has passed the quiet time behind its last event."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.session_window("ts", quiet).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("started"), "n")


def first_seen(events: DataFrame, keys: list[str], within: str) -> DataFrame:
    """One row a key; repeats that come within a time of it are dropped, and its state goes after that time."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", within)
    return timed.dropDuplicatesWithinWatermark(keys).select(*keys)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Runs the stream over what is there and reads its sink; state and sink are in the cluster's shared folder."""
    spark = stream.sparkSession
    base = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
