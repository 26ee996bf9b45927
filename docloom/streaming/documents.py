"""Streams of documents and events. Every function takes batch and streaming tables alike.

Reading and converting keep no state. Windows, sessions and de-duplication are bounded by a watermark: rows that come
later than it are left out, and state older than it is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.functions.text import format_of_path
from docloom.plans.documents import convert


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """(doc_id, format, content) of the files that appear under path; see plans.documents.scan() for the batch form."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return raw.select(F.col("path").alias("doc_id"), format_of_path(F.col("path")).alias("format"), "content")


def convert_files(stream: DataFrame, source: str, target: str) -> DataFrame:
    """(doc_id, output, error) of the files of one format."""
    return convert(stream.where(F.col("format") == source), source, target)


def write(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends a stream to Parquet at path; with once, what is there now, else every minute. checkpoint makes it restartable."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def _timed(events: DataFrame, late: str) -> DataFrame:
    """events with a watermark on ts if they are a stream; watermarks need a time with a zone, the session's if it has none."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def window_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """(start, keys, n) of tumbling windows, or sliding ones."""
    kind = events.schema["ts"].dataType
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return _timed(events, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").cast(kind).alias("start"), *keys, "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """(key, start, n) of runs of events of a key that are less than gap apart."""
    kind = events.schema["ts"].dataType
    return _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").cast(kind).alias("start"), "n")


def deduplicated(events: DataFrame, keys: tuple[str, ...], late: str = "1 hour") -> DataFrame:
    """One row per keys; a stream forgets keys older than the watermark."""
    if events.isStreaming:
        return _timed(events, late).dropDuplicatesWithinWatermark(list(keys))
    return events.dropDuplicates(list(keys))
