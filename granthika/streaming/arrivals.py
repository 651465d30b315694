"""Books and checks that arrive over time, as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from granthika.sources.epub import read_epub_binary


def epub_arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs of EPUB files that come into ``folder``, each file once."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.epub").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return read_epub_binary(files)


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand what has arrived to ``handle`` batch by batch and stop; what was handled is remembered in ``checkpoint``."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events of each type in each window of event time; rows later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "events", "value")
