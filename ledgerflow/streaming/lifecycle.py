"""Structured Streaming over the lifecycle events: windows, sessions, deduplication, live latency.

Watermarks need timestamps with a time zone, so ``ts`` is cast under a UTC session.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerflow.session import shared_folder

SCHEMA = "event_id string, type string, ts timestamp_ntz, topic string, elapsed_ms bigint"


def read(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The event stream as Parquet files arrive in a folder."""
    reader = spark.readStream.schema(SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def timed(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    rows = timed(events, late).groupBy(F.window("ts", width), "type").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), "type", "n")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    rows = timed(events, late).groupBy(F.window("ts", width, step), "type").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), "type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    rows = timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "topic").agg(F.count("*").alias("n"))
    return rows.select("topic", F.col("w.start").alias("began"), "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, if its copies come within the watermark."""
    return timed(events, late).dropDuplicatesWithinWatermark(["event_id"])


def counters(events: DataFrame) -> DataFrame:
    return events.groupBy("type").agg(F.count("*").alias("n"))


def latency(events: DataFrame, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(topic, started, completed): starts joined with completions of the same topic that follow in time."""
    rows = timed(events, late)
    begun = rows.where("type = 'job.started'").select(F.col("topic"), F.col("ts").alias("started"))
    ended = rows.where("type = 'job.completed'").select(F.col("topic").alias("t"), F.col("ts").alias("completed"))
    return begun.join(ended, F.expr(f"topic = t AND completed >= started AND completed <= started + INTERVAL {within}")).select("topic", "started", "completed")


def in_batches(frames: list[DataFrame], files: int = 4) -> str:
    """A folder in which a stream with ``files`` files a trigger finds each frame as a batch, in order."""
    path = f"{shared_folder(frames[0].sparkSession)}/stream_{uuid.uuid4().hex}"
    for frame in frames:
        frame.repartition(files).write.mode("append").parquet(path)
    return path


def finished(rows: DataFrame) -> DataFrame:
    """All that a stream gives, run to its end into the shared folder, with its state there, and read back."""
    path = f"{shared_folder(rows.sparkSession)}/stream_{uuid.uuid4().hex}"
    run_now(rows, f"q_{uuid.uuid4().hex}", "append", f"{path}/state", "parquet", path=f"{path}/rows")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")


def run_now(rows: DataFrame, name: str, mode: str, checkpoint: str, sink: str = "memory", **options: str) -> StreamingQuery:
    """Process what is there and stop."""
    writer = rows.writeStream.outputMode(mode).format(sink).queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    for key, value in options.items():
        writer = writer.option(key, value)
    query = writer.start()
    query.awaitTermination()
    return query
