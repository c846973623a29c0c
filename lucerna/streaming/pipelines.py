"""Structured Streaming forms of the batch behaviour (R1-R4), and event-time windows over the event table.

Every pipeline runs with ``availableNow`` on files, so it can be resumed from its checkpoint and tested in a batch run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1, glob: str | None = None) -> DataFrame:
    """New parquet files in micro-batches."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (r.option("pathGlobFilter", glob) if glob else r).parquet(path)


def event_stream(spark: SparkSession, path: str, glob: str = "events.parquet") -> DataFrame:
    """Events with ``ts`` as an instant (the session is in UTC); watermarks need that type."""
    return file_stream(spark, path, EVENTS, glob=glob).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Tumbling or sliding counts and sums; works on a stream (append after the watermark) and on a batch."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Session windows per user."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    s = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def deduplicated(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """R2: each key once within the watermark; state is dropped behind it."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if stream.isStreaming else stream.dropDuplicates(keys)


def run_batches(stream: DataFrame, work: Callable[[DataFrame], DataFrame], key: str, out: str, checkpoint: str, event_time: str | None = None, late: str = "1 day") -> StreamingQuery:
    """Micro-batches through ``work``, written to ``out``, each into a folder of its own.

    Keys done before are known to the query's state, so no earlier output is read again; a batch that is replayed after
    a failure overwrites its own folder, so it adds nothing.  Without ``event_time`` every key is remembered for
    ever; with it a repeat is looked for within ``late`` only and the state is dropped behind the watermark.
    """

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    once = stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key]) if event_time else stream.dropDuplicates([key])
    return once.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_per_key(stream: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The latest record per key as a running aggregate (update or complete mode)."""
    return stream.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("x")).select(key, "x.*")
