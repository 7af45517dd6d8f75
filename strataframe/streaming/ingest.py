"""Incremental ingest as Structured Streaming (an extension: the work itself is the batch operators')."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataframe.operators.aggregates import rounded_sum
from strataframe.operators.quality import validate
from strataframe.operators.schema import normalized_rows
from strataframe.sources.readers import tables


def landing(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files that arrive below ``path``."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(path)
    return stream.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Records and findings of each batch of new files, written below ``out`` by batch number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        found = tables(batch).persist()
        normalized_rows(found).write.mode("overwrite").parquet(f"{out}/records/batch={number}")
        validate(found).write.mode("overwrite").parquet(f"{out}/findings/batch={number}")
        found.unpersist()

    return landing(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) by tumbling window of ``events(ts, event_type, value)``; works on streams, where later rows than ``late`` are left out."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    out = marked.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), rounded_sum(F.col("value")).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")
