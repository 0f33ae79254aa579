"""Structured Streaming: the progress log, and indexing of bundles as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlbrook.sources.checkpoint import SCHEMA, latest
from marlbrook.sources.sinks import upsert


def follow_log(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the last record of each identifier of a growing JSON-lines log as a versioned table."""
    rows = spark.readStream.schema(SCHEMA).json(source)

    def apply(batch: DataFrame, _: int) -> None:
        upsert(batch.sparkSession, target, latest(batch.withColumn("_t", F.coalesce("timestamp", F.lit(""))), "identifier", ["_t"]).drop("_t"))

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()


def follow_bundles(spark: SparkSession, source: str, target: str, checkpoint: str, shape) -> StreamingQuery:
    """Index new archives of a folder; ``shape(files)`` makes catalogue rows of binary files. A failed batch is repeated as a whole, and an upsert repeats safely."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.zip").schema("path string, modificationTime timestamp, length long, content binary").load(source)

    def apply(batch: DataFrame, _: int) -> None:
        rows = shape(batch)
        upsert(batch.sparkSession, target, rows)

    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()


def event_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts of events by type in windows of event time, for a stream with a watermark or a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
